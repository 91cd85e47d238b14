"""A run-length index: the run-compressed Burrows-Wheeler transform with sampled run ends.

The transform of a text is kept as its runs; for each run the suffix-array
values of its first and last row are sampled. Matching statistics of a pattern
are streamed from right to left: while the pattern agrees with the text that the
current suffix stands in, the match just grows (agreeing stretches are skipped
eight bytes at a time); at a disagreement the walk jumps to the nearest row above
or below whose preceding byte is the wanted one. That row is an end of a run of
that byte, so its sample gives the suffix to go on with, and the longer common
extension decides between the two.

One object holds the indexes of many texts side by side: the rows of a text are
together, and its runs are told from those of others by its number, so no match
leaves its text. Patterns are walked in step, each through its own text.
"""

from __future__ import annotations

import numpy as np

#: Never occurs in UTF-8; ends each piece of the text.
BORDER = 0xFF
#: Never occurs in UTF-8 either; comes before each pattern, so no comparison leaves it.
FENCE = 0xFE
#: Longer patterns are walked in parts of as many windows.
PART = 256
_PAD = bytes([BORDER]) * 8
_BYTES = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def suffix_array(text: np.ndarray, slot: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their text's number, then at least their first ``depth`` bytes; prefix doubling of those that still tie."""
    n = len(text)
    step = (64 - int(slot[-1]).bit_length()) // 8
    key, padded = slot.astype(np.uint64), np.concatenate([text, np.zeros(8, np.uint8)])
    for j in range(step):
        key <<= np.uint64(8)
        key |= padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    rows = np.arange(n)
    rank = np.zeros(n + 1, np.int64)  # the first row of the suffixes that tie with this one, plus 1; 0: past the end
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[rows]] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))] + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = rows[tied]
        if step >= depth or not len(rows):
            return order
        own = order[rows]
        key = (rank[own] << 32) | rank[np.minimum(own + step, n)]
        by = np.argsort(key)
        order[rows], key = own[by], key[by]
        step *= 2


class RunLengthIndex:
    """Indexes of some pieces of text; ``long_matches`` tells where strings of ``length`` bytes of a pattern occur in them.

    ``of`` has the number of the text of each piece, ascending from 0; without it all are one.
    """

    def __init__(self, pieces: list[bytes], length: int, of: np.ndarray | None = None):
        border = bytes([BORDER])
        self.length = length
        raw = border.join([*pieces, b""])
        text = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        of = np.zeros(len(pieces), np.int64) if of is None else of
        slot = np.repeat(of, sizes)
        #: the last border of each text
        self.last = np.searchsorted(slot, np.arange(int(of[-1]) + 1), "right") - 1
        sa = suffix_array(text, slot, length)
        self.row_of = np.empty(len(sa), np.int64)
        self.row_of[sa] = np.arange(len(sa))
        # a text's number and the byte before the suffix; before the first one a border, as between pieces
        symbol = (slot[sa] << 8) | text[sa - 1]
        heads = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        tails = np.concatenate([heads[1:], [len(sa)]]) - 1
        by = np.argsort(symbol[heads], kind="stable")
        heads, tails = heads[by], tails[by]
        #: runs by symbol, then row: the symbol, both with the last row, the suffixes sampled at the first and last row
        self.symbols, self.first, self.final = symbol[heads], sa[heads], sa[tails]
        self.places = (self.symbols << 32) | tails
        self.n_runs = len(heads)
        buffer = _PAD + raw + _PAD * (length // 8 + 2)  # no byte of a pattern stands beyond the text
        self._before, self._after = _words(buffer, "<u8", 0), _words(buffer, ">u8", 8)

    def long_matches(self, pattern: bytes) -> np.ndarray:
        """For each start in ``pattern`` that leaves ``length`` bytes: does that string occur in the pieces?"""
        return self.all_matches([pattern], np.zeros(1, np.int64))

    def all_matches(self, patterns: list[bytes], of: np.ndarray) -> np.ndarray:
        """``long_matches`` of each pattern in the text of its number, one after the other."""
        need = self.length
        counts = np.maximum(np.fromiter(map(len, patterns), np.int64, len(patterns)) - need + 1, 0)
        parts = -(-counts // PART)
        which = np.repeat(np.arange(len(patterns)), parts)
        cut = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART
        width = np.minimum(counts[which] - cut, PART)
        fence = bytes([FENCE])
        raw = fence.join([b"", *(patterns[p][c : c + w] for p, c, w in zip(which.tolist(), cut.tolist(), (width + need - 1).tolist(), strict=True))])
        low = np.cumsum(width + need) - (width + need) + 1
        found = self._walk(raw, low, width, of[which])
        # the windows of the parts, one after the other, are those of the patterns
        at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        return found[at]

    def _walk(self, raw: bytes, low: np.ndarray, width: np.ndarray, of: np.ndarray) -> np.ndarray:
        """By byte of ``raw``: does a string that occurs in the text start there? Patterns start at ``low``, with ``width`` windows."""
        need, steps = self.length, np.zeros(len(raw) + 2, np.int32)
        data, before = np.frombuffer(raw, np.uint8), _words(_PAD + raw, "<u8", 0)
        end = self.last[of]
        i, pos, size = low + width + need - 1, end, np.zeros(len(low), np.int64)  # raw[i:i + size] == text[pos:pos + size]
        while len(i):
            same = _agree(before, i, self._before, pos)
            # a start s in [i - same, i) now matches size + i - s bytes
            first, until = i - same, np.minimum(i, size + i - need + 1)
            some = until > first
            steps[first[some]] += 1
            steps[until[some]] -= 1
            i, pos, size = first, pos - same, size + same
            # else no string of that length can begin further left
            on = (i > low) & (i - low + size >= need)
            if not on.all():
                i, pos, size, low, of, end = (x[on] for x in (i, pos, size, low, of, end))
            if not len(i):
                break
            i, pos, size = i - 1, *self._jump(pos, (of << 8) | data[i - 1], np.minimum(size, need), end)
            some = size >= need
            steps[i[some]] += 1
            steps[i[some] + 1] -= 1
        return np.cumsum(steps) > 0

    def _jump(self, pos: np.ndarray, symbol: np.ndarray, size: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix that begins with the symbol and keeps most of the ``size`` bytes, and its match; the text's end if it lacks the symbol.

        The suffixes at ``pos`` follow other symbols, so their rows lie between runs of the wanted ones.
        """
        k = np.searchsorted(self.places, (symbol << 32) | self.row_of[pos])
        below, above = np.minimum(k, self.n_runs - 1), np.maximum(k - 1, 0)
        is_below, is_above = self.symbols[below] == symbol, (k > 0) & (self.symbols[above] == symbol)
        down, up = self.first[below], self.final[above]
        keep_down, keep_up = np.full(len(pos), -1), np.full(len(pos), -1)
        keep_down[is_below] = self._common(down[is_below], pos[is_below], size[is_below])
        keep_up[is_above] = self._common(up[is_above], pos[is_above], size[is_above])
        kept = np.maximum(keep_down, keep_up)
        to = np.where(keep_up > keep_down, up, down) - 1
        return np.where(kept < 0, end, to), kept + 1

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of two suffixes, up to ``most``."""
        out = _equal(self._after[a], self._after[b])
        more = np.flatnonzero((out == 8) & (most > 8))
        at = 8
        while len(more):
            same = _equal(self._after[a[more] + at], self._after[b[more] + at])
            out[more] += same
            at += 8
            more = more[(same == 8) & (most[more] > at)]
        return np.minimum(out, most)


def _words(buffer: bytes, kind: str, start: int) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray((len(buffer) - start - 7,), kind, buffer, start, (1,))


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes, the highest ones first, agree."""
    return 8 - np.searchsorted(_BYTES, (x ^ y).astype(np.uint64), "right")


def _agree(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common suffix of what ends at ``i`` and at ``j``."""
    out = _equal(x[i], y[j])
    more = np.flatnonzero(out == 8)
    while len(more):
        same = _equal(x[i[more] - out[more]], y[j[more] - out[more]])
        out[more] += same
        more = more[same == 8]
    return out
