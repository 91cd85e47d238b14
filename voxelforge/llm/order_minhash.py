"""Near-duplicate documents by Order MinHash, verified by banded alignment.

The k-mers of a document are its runs of two words (lower case, punctuation
dropped), labelled by occurrence so that repeats count. For each of ``SKETCH``
hash functions the ``PER_ENTRY`` labelled k-mers of least hash are taken in the
order in which they stand in the text; an entry agrees for two documents with a
probability that falls with their edit similarity, order included. Texts of at
most ``SHORT`` words have ``SHORT_SKETCH`` entries of one k-mer besides. Documents
that agree in an entry are candidates.

Verification aligns the words of both texts (bit-parallel edit distance within
the band that the threshold leaves): similar are texts with
1 - distance / longer length >= ``THRESHOLD``. Before that the words they have
in common bound the distance from below.

Groups of any size are handled without emitting all pairs: identical texts are
one node; within a bucket (the nodes that agree in an entry) every node is
compared with the least one, so that a cluster has the same lead in all its
buckets. Buckets whose nodes the links so far leave in different components are
then searched whole. Tasks look at all pairs of such a bucket, each pair in the
first bucket that its texts share, and name the texts of those of different
components that lengths and bags of words allow to be similar; these texts come
to tasks that align them and let out only links that join components. So no two
similar texts that agree in an entry end in different classes, and what tasks let
out grows with the texts, not with their pairs. Links
go to connected components; a class is named by its least id.

Null texts count as empty; all texts without words are verified as equal only if
they are identical. Texts with fewer than two words have one k-mer of all their
words. Rows with equal id and text are one document. Null ids are allowed: a
class is named by its least id that is not null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, buffers, lowered, materialize, mix, new_path, release, shingle_hashes, shuffle_partitions, slices, word_hashes
from ..operators.components import connected_components

K = 2
SKETCH = 36
PER_ENTRY = 3
SHORT, SHORT_SKETCH = 16, 24
THRESHOLD = 0.8
#: Links that later rounds may bring and one task joins up; more are joined by all.
FEW_LINKS = 10_000
#: Nodes of a bucket that one row of a task holds; a larger bucket is cut into parts, and each part meets each.
PART = 1024
#: Pairs for each node that a task aligns in its first round; the next takes four times as many, without those that links have joined meanwhile.
OPEN = 8
#: Words of all pairs, and of all texts, that a task aligns as one group; beyond either the group is cut into blocks of TILE texts, and each block meets each.
WORK, TEXTS, TILE = 1 << 22, 1 << 20, 128
#: Pairs whose fine bags a task compares at once.
GAPS = 2048
#: Counters of words by hash, which bound the edit distance before texts are brought together: few for all pairs, then more for those left.
BINS, FINE_BINS = 64, (256, 1024)
#: Texts with more words than this have the larger number of fine bins, which fold to the smaller.
LONG = 1024
#: Comparisons with one lead that a task makes, about.
SPLIT = 256

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TOP = np.uint64((1 << 64) - 1)


def labelled(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their number of occurrence within their text."""
    key = mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(h), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return mix(h)
    at = np.arange(len(h))
    begin = np.maximum.accumulate(np.where(same, 0, at))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = (at - begin).astype(np.uint64)
    return mix(h + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def sketches(words: np.ndarray, woff: np.ndarray, size: int = SKETCH, per_entry: int = PER_ENTRY) -> np.ndarray:
    """Entries (texts x size) of the texts whose words are given; texts without words have none (all 0)."""
    texts = len(woff) - 1
    out = np.zeros((texts, size), np.uint64)
    h, at = shingle_hashes(words, woff, K)
    owner = np.searchsorted(woff, at, "right") - 1
    short = np.flatnonzero((np.diff(woff) > 0) & (np.diff(woff) < K))
    if len(short):
        whole = [int(shingle_hashes(words[woff[t] : woff[t + 1]], np.array([0, woff[t + 1] - woff[t]]), woff[t + 1] - woff[t])[0][0]) for t in short]
        h, at, owner = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([at, woff[short]]), np.concatenate([owner, short])
        order = np.argsort(at, kind="stable")
        h, at, owner = h[order], at[order], owner[order]
    if not len(h):
        return out
    hv = labelled(h, owner)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    count = np.diff(np.concatenate([first, [len(h)]]))
    rows = owner[first]
    for j in range(size):
        g = (hv ^ _XOR[j]) * _MUL[j]
        picks = []
        for _ in range(per_entry):
            low = np.minimum.reduceat(g, first)
            pos = np.flatnonzero(g == np.repeat(low, count))
            if len(pos) != len(first):  # equal hashes, or no k-mer left: the first of each text
                pos = pos[np.concatenate([[True], owner[pos[1:]] != owner[pos[:-1]]])]
            picks.append(pos)
            g[pos] = _TOP
        entry = np.full(len(first), j, np.uint64)
        for pos in np.sort(np.stack(picks), 0):
            entry = mix(entry * np.uint64(0x9FB21C651E98DF25) + hv[pos])
        out[rows, j] = entry
    return out


def word_bags(words: np.ndarray, woff: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of the words of each text in ``bins`` bins, at most 255 (which keeps differences lower bounds)."""
    owner = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    at = (words >> np.uint64(40)) % np.uint64(bins)
    return np.minimum(np.bincount(owner * bins + at.astype(np.int64), minlength=(len(woff) - 1) * bins), 255).astype(np.uint8).reshape(-1, bins)


def fine_bags(words: np.ndarray, woff: np.ndarray) -> list[bytes]:
    """As word_bags, with more bins for texts of more than LONG words."""
    few, many = FINE_BINS
    long = np.diff(woff) > LONG
    out = [x.tobytes() for x in word_bags(words, woff, few)]
    for i in np.flatnonzero(long):
        out[i] = word_bags(words[woff[i] : woff[i + 1]], np.array([0, woff[i + 1] - woff[i]]), many).tobytes()
    return out


def sketch_documents(docs: DataFrame, *, size: int = SKETCH) -> DataFrame:
    """(doc, node, keys, n, bag, fine) from (doc, node, t): entries, number of words and counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words, _, _, woff = word_hashes(*buffers(lowered(part.column("t"))))
                n = np.diff(woff)
                keys = np.zeros((len(n), size + SHORT_SKETCH), np.uint64)
                keys[:, :size] = sketches(words, woff, size)
                short = np.flatnonzero((n > 0) & (n <= SHORT))
                if len(short):
                    own = np.concatenate([words[woff[i] : woff[i + 1]] for i in short])
                    keys[short, size:] = mix(sketches(own, np.concatenate([[0], np.cumsum(n[short])]), SHORT_SKETCH, 1))
                many = np.where(n == 0, 0, np.where(n <= SHORT, size + SHORT_SKETCH, size))
                offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                flat = keys[np.arange(size + SHORT_SKETCH) < many[:, None]].view(np.int64)
                bags = pa.array([x.tobytes() for x in word_bags(words, woff)], pa.binary())
                cols = [part.column("doc"), part.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n.astype(np.int64)), bags, pa.array(fine_bags(words, woff), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "node", "keys", "n", "bag", "fine"])

    return docs.select("doc", "node", "t").mapInArrow(run, "doc long, node long, keys array<long>, n long, bag binary, fine binary")


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences of words, or ``most`` + 1 if it is larger.

    Hyyro's banded form of Myers' bit-parallel algorithm on Python integers:
    column by column, over the rows within ``most`` of the diagonal.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    differ = np.flatnonzero(a[:m] != b)
    head = int(differ[0]) if len(differ) else m
    a, b = a[head:], b[head:]
    n, m = n - head, m - head
    if m:
        differ = np.flatnonzero(a[n - m :][::-1] != b[::-1])
        tail = int(differ[0]) if len(differ) else m
        a, b, n, m = a[: n - tail], b[: m - tail], n - tail, m - tail
    if not m:
        return n
    places: dict[int, list[int]] = {}
    for i, w in enumerate(b.tolist()):
        places.setdefault(w, []).append(i)
    return _banded(a.tolist(), places, n, m, most)


def _banded(a: list[int], places: dict[int, list[int]], n: int, m: int, most: int) -> int:
    """Columns are the words of the longer sequence; rows those of the shorter one, by their places."""
    if 2 * most + 1 >= m:
        masks = {w: sum(1 << i for i in at) for w, at in places.items()}
        return _full(a, masks, m, most)
    # place lists are ascending, and the window of rows moves down: pointers only advance
    lowest = dict.fromkeys(places, 0)
    pv, mv, base, height = (1 << (most + 1)) - 1, 0, 0, most + 1
    score = height  # distance at the window's last row, column 0
    for j, w in enumerate(a):
        # rows base .. base + height - 1 are within the band of column j
        at = places.get(w)
        eq = 0
        if at is not None:
            k = lowest[w]
            while k < len(at) and at[k] < base:
                k += 1
            lowest[w] = k
            while k < len(at) and at[k] < base + height:
                eq |= 1 << (at[k] - base)
                k += 1
        mask = (1 << height) - 1
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        top = 1 << (height - 1)
        score += 1 if ph & top else -1 if mh & top else 0
        ph = ((ph << 1) | 1) & mask
        mh = (mh << 1) & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
        if base + height < m:  # one more row below, one less above if the band has its full width
            pv |= 1 << height
            height += 1
            score += 1
        if j + 1 > most and height > 1 and j + 1 - most > base:
            pv, mv, base, height = pv >> 1, mv >> 1, base + 1, height - 1
    return min(score, most + 1)


def _full(a: list[int], masks: dict[int, int], m: int, most: int) -> int:
    """Myers' algorithm over all rows."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for w in a:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & mask, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ((ph << 1) | 1) & mask, (mh << 1) & mask
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv
    return min(score, most + 1)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two bags of words."""
    both = np.concatenate([a, b])
    values, where = np.unique(both, return_inverse=True)
    left = np.bincount(where[: len(a)], minlength=len(values))
    right = np.bincount(where[len(a) :], minlength=len(values))
    return int(np.minimum(left, right).sum())


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Edit similarity of two sequences of words, or -1 if it is below the threshold."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - threshold) * longer + 1e-9)
    if abs(len(a) - len(b)) > most or longer - common_words(a, b) > most:
        return -1.0
    d = edit_distance(a, b, most)
    return 1 - d / longer if d <= most else -1.0


def verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, lead, similarity) from (node, lead, a, b); similarity is -1 below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "a"):
                wa, _, _, oa = word_hashes(*buffers(lowered(part.column("a"))))
                wb, _, _, ob = word_hashes(*buffers(lowered(part.column("b"))))
                sims = [similar(wa[oa[i] : oa[i + 1]], wb[ob[i] : ob[i + 1]], threshold) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("lead"), pa.array(sims, pa.float64())], names=["node", "lead", "similarity"])

    return pairs.select("node", "lead", "a", "b").mapInArrow(run, "node long, lead long, similarity double")


def possible(pairs: DataFrame, info: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (node, lead) whose lengths and bags of words, the small ones first, do not rule out that they are similar."""
    return _bounded(_bounded(pairs, info, "bag", threshold), info, "fine", threshold)


def _bounded(pairs: DataFrame, info: DataFrame, bag: str, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longer = np.maximum(batch.column("n").to_numpy(), batch.column("n2").to_numpy())
            least = bag_gaps(batch.column("bag").to_pylist(), batch.column("bag2").to_pylist())
            yield batch.select(["node", "lead"]).filter(pa.array(least <= ((1 - threshold) * longer + 1e-9).astype(np.int64)))

    own = info.select(F.col("node").alias("lead"), F.col("n").alias("n2"), F.col(bag).alias("bag2"))
    near = pairs.join(info.select("node", "n", F.col(bag).alias("bag")), "node").join(own, "lead").where(_lengths("n", "n2", threshold))
    return near.select("node", "lead", "n", "n2", "bag", "bag2").mapInArrow(run, "node long, lead long")


def bag_gaps(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each pair of bags a lower bound of the edit distance: the words that either has more of. Bins of larger bags are added up to the smaller size."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for p, q in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (p, q)).all(1))
        # a word's bin among few bins is its bin among many, modulo their number
        few = [np.frombuffer(b"".join(x[i] for i in at), np.uint8).reshape(len(at), -1, min(p, q)).sum(1, dtype=np.int32) for x in (a, b)]
        few = [np.minimum(x, 255) for x in few]  # as counts among few bins end there
        gap = few[0] - few[1]
        out[at] = np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1))
    return out


def _lengths(a: str, b: str, threshold: float):
    return F.greatest(a, b) - F.least(a, b) <= F.floor(F.greatest(a, b) * (1 - threshold) + 1e-9)


def _cells(rows: DataFrame, labels: DataFrame, part: int) -> DataFrame:
    """(key, p, q, own, node) of the buckets whose nodes have different labels, a cell (key, p, q) for each two parts of a bucket."""
    rows = rows.select("node", "key").join(labels, "node")
    mixed = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.ceil(F.count("*") / part).cast("int").alias("parts")).where("a != b").select("key", "parts")
    dealt = rows.join(mixed, "key").select("key", "node", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return materialize(dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node"), "omh-cells")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple[int, ...], list[pa.RecordBatch]]]:
    """The rows of each run of equal values of ``by``, across batches; they stay in parts, as one Arrow array holds 2 GB of text at most."""
    held, of = [], ()
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in by], 1)
        edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
        for s, e in zip(edges, edges[1:]):
            if held and of != tuple(ids[s].tolist()):
                yield of, held
                held = []
            of = tuple(ids[s].tolist())
            held.append(batch.slice(s, e - s))
    if held:
        yield of, held


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows with equal ``by`` after each other, in as many tasks as a shuffle has: few bytes are much work here."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)


def _known(rows: list[pa.RecordBatch]) -> tuple[list, np.ndarray]:
    """The arguments of ``open_pairs`` that tell what is known of the rows' nodes; and their keys, filled up with numbers that no two share."""
    node, label, n, own = [np.concatenate([x.column(c).to_numpy() for x in rows]) for c in ("node", "label", "n", "own")]
    bags = np.frombuffer(b"".join(b for x in rows for b in x.column("bag").to_pylist()), np.uint8).reshape(len(node), -1)
    many = np.concatenate([np.diff(x.column("keys").offsets.to_numpy()) for x in rows])
    keys = np.repeat(np.arange(len(node))[:, None], many.max(), 1)
    keys[np.arange(many.max()) < many[:, None]] = np.concatenate([x.column("keys").flatten().to_numpy() for x in rows])
    return [node, label, n, own, bags, [b for x in rows for b in x.column("fine").to_pylist()]], keys


def own_pairs(key: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first that the nodes of the pairs (a, b) share, so that each pair is looked at in one bucket."""
    out = np.ones(len(a), bool)
    for s in range(0, len(a), GAPS):
        left, right = keys[a[s : s + GAPS]], keys[b[s : s + GAPS]]
        same = left == right
        first = same.argmax(1)[:, None]
        out[s : s + GAPS] = ~same.any(1) | (np.take_along_axis(left, first, 1)[:, 0] == key)
    return out


def _at(node: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(node)
    return [order[np.searchsorted(node, x, sorter=order)] for x in ends]


def tiles(n: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray, work: int = WORK, texts: int = TEXTS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile, place, own) of the nodes that take part in the pairs (a, b) of places.

    One tile takes all if that is little; else there is one for each two blocks of
    nodes that have pairs. A tile's pairs are those of different ``own``, or all if
    it has one ``own`` only.
    """
    part = np.unique(np.concatenate([a, b]))
    if np.maximum(n[a], n[b]).sum() <= work and n[part].sum() <= texts:
        return np.zeros(len(part), np.int64), part, own[part].astype(np.int64)
    part = part[np.lexsort([n[part], own[part]])]
    first = np.concatenate([[True], own[part][1:] != own[part][:-1]])
    at = np.arange(len(part))
    # blocks end where ``own`` changes, so that blocks of different ``own`` have no pairs within
    block = np.zeros(len(n), np.int64)
    block[part] = np.cumsum(first | ((at - np.maximum.accumulate(np.where(first, at, 0))) % tile == 0)) - 1
    many = block[part[-1]] + 1
    of = np.minimum(block[a], block[b]) * many + np.maximum(block[a], block[b])
    rows = np.unique(np.concatenate([of * len(n) + a, of * len(n) + b]))
    return rows // len(n), rows % len(n), block[rows % len(n)]


def _apart(cells: DataFrame, labels: DataFrame, info: DataFrame, threshold: float) -> DataFrame:
    """(key, p, q, tile, node, own) of the nodes of a cell that have a partner of another label whose length and bags allow that they are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, p, q), rows in _groups(batches, ["key", "p", "q"]):
            known, keys = _known(rows)
            node, label, n, own = known[:4]
            if (label == label[0]).all():
                continue
            a, b = _at(node, *open_pairs(*known, p == q, None, len(node) ** 2, threshold)[:2])
            ours = own_pairs(key, keys, a, b)
            if ours.any():
                tile, place, block = tiles(n, own, a[ours], b[ours])
                same = [pa.array(np.full(len(tile), x), t) for x, t in ((key, pa.int64()), (p, pa.int32()), (q, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(tile), pa.array(node[place]), pa.array(block.astype(np.int32))], names=["key", "p", "q", "tile", "node", "own"])

    known = cells.join(labels, "node").join(info.select("node", "n", "bag", "fine", "keys"), "node")
    return _dealt(known, "key", "p", "q").mapInArrow(run, "key long, p int, q int, tile long, node long, own int")


def _met_links(met: DataFrame, labels: DataFrame, info: DataFrame, threshold: float) -> DataFrame:
    """(node, lead) of similar nodes of different labels: of each tile of ``_apart`` as many as join the labels that its similar pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, *_), rows in _groups(batches, ["key", "p", "q", "tile"]):
            (node, label, *known), keys = _known(rows)
            words = []
            for part in (x for batch in rows for x in slices(batch, "t")):
                w, _, _, off = word_hashes(*buffers(lowered(part.column("t"))))
                words += [w[s:e] for s, e in zip(off, off[1:])]
            links = joining_links(key, keys, node, label, known, words, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["node", "lead"])

    known = met.join(labels, "node").join(info.select("node", "n", "bag", "fine", "keys", "t"), "node")
    return _dealt(known, "key", "p", "q", "tile").mapInArrow(run, "node long, lead long")


def joining_links(key: int, keys: np.ndarray, node: np.ndarray, label: np.ndarray, known: list, words: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links (larger node, smaller node) between nodes of a tile that are similar; pairs that links join already are not aligned."""
    label, after, most, out = label.copy(), None, OPEN * len(node), []
    within = bool((known[1] == known[1][0]).all())
    while True:
        big, small, after = open_pairs(node, label, *known, within, after, most, threshold)
        a, b = _at(node, big, small)
        ours = own_pairs(key, keys, a, b)
        for i, j in zip(a[ours].tolist(), b[ours].tolist()):
            if label[i] != label[j] and similar(words[i], words[j], threshold) >= 0:
                out.append((int(node[i]), int(node[j])))
                label[label == label[i]] = label[j]
        if after is None:
            return out
        most *= 4


def open_pairs(node: np.ndarray, label: np.ndarray, n: np.ndarray, own: np.ndarray, bags: np.ndarray, fine: list[bytes], within: bool, after: int | None, most: int, threshold: float) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Larger and smaller node of the open pairs of a cell, those of least hash above ``after``, and the last one's hash if there are more than ``most``."""
    order = np.argsort(n, kind="stable")
    node, label, n, own, bags = node[order], label[order], n[order], own[order], bags[order].astype(np.int16)
    found_i, found_j = [], []
    sums = bags.sum(1, dtype=np.int32)
    # the longer text decides how much may differ: partners of i are those that follow, up to the length at which i is too short
    longest = np.floor(n / threshold + 1) + 1
    to = np.searchsorted(n, longest, "right")
    for i in range(len(node)):
        j = np.arange(i + 1, to[i])
        j = j[(label[j] != label[i]) & (within | (own[j] != own[i]))]
        room = ((1 - threshold) * n[j] + 1e-9).astype(np.int64)
        j = j[n[j] - n[i] <= room]
        if len(j):
            gap = (np.abs(bags[j] - bags[i]).sum(1, dtype=np.int32) + np.abs(sums[j] - sums[i])) // 2
            j = j[gap <= ((1 - threshold) * n[j] + 1e-9).astype(np.int64)]
            found_i.append(np.full(len(j), i))
            found_j.append(j)
    if not sum(map(len, found_i)):
        return node[:0], node[:0], None
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    keep = []
    for s in range(0, len(i), GAPS):
        a, b = order[i[s : s + GAPS]], order[j[s : s + GAPS]]
        keep.append(bag_gaps([fine[x] for x in a], [fine[x] for x in b]) <= ((1 - threshold) * n[j[s : s + GAPS]] + 1e-9).astype(np.int64))
    keep = np.concatenate(keep)
    u, v = node[i[keep]], node[j[keep]]
    big, small = np.maximum(u, v), np.minimum(u, v)
    rank = mix(big.view(np.uint64) + mix(small.view(np.uint64))).view(np.int64)
    if after is not None:
        big, small, rank = big[rank > after], small[rank > after], rank[rank > after]
    if len(rank) <= most:
        return big, small, None
    last = int(np.partition(rank, most - 1)[most - 1])
    return big[rank <= last], small[rank <= last], last


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after the links (node, lead); nodes of a component have the least label."""
    ends = links.join(labels, "node").withColumnRenamed("label", "u").join(labels.select(F.col("node").alias("lead"), F.col("label").alias("v")), "lead")
    new = connected_components(ends.select("u", "v"), one_task=FEW_LINKS).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return materialize(labels.join(new, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "omh-labels")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SKETCH, part: int = PART) -> DataFrame:
    """(doc, node, class_id) for each row: ``node`` is the xxhash64 of its text, ``class_id`` the least id of its class."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("node", F.xxhash64("t"))
    prints = materialize(sketch_documents(base, size=size), "omh-sketches")
    reps = prints.groupBy("node").agg(F.min("doc").alias("rep"))
    nodes = prints.alias("p").join(reps.alias("r"), (F.col("p.node") == F.col("r.node")) & F.col("doc").eqNullSafe(F.col("rep")), "left_semi")
    rows = materialize(_shared(nodes.select("node", F.explode("keys").alias("key"))), "omh-buckets")
    involved = nodes.join(rows.select("node").distinct(), "node", "left_semi")
    info, drop_info = _node_table(base, involved)
    labels = info.select("node", F.col("node").alias("label"))
    tried = materialize(rows.where("node != lead").select("node", "lead").distinct(), "omh-pairs")
    good = _links(materialize(possible(tried, info, threshold), "omh-possible"), info, threshold)
    if not good.isEmpty():
        labels = _joined(labels, good)
    cells = _cells(rows, labels, part)
    release(rows)
    met = materialize(_apart(cells, labels, info, threshold), "omh-met")
    release(cells)
    good = materialize(_met_links(met, labels, info, threshold), "omh-links")
    if not good.isEmpty():
        labels = _joined(labels, good)
    labels = materialize(labels, "omh-labels")  # without the table of nodes
    drop_info()
    release(met, good)
    marked = prints.select("doc", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = marked.groupBy("label").agg(F.min("doc").alias("class_id"))
    return marked.join(names, "label").select("doc", "node", "class_id")


def _shared(entries: DataFrame) -> DataFrame:
    """(key, node, lead) of the buckets of two nodes or more; the lead is the least node."""
    leads = entries.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead != last").drop("last")
    return entries.select("key", "node").join(leads, "key")


def _links(pairs: DataFrame, info: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (node, lead) that are similar."""
    sims = materialize(_compare(pairs, info.select("node", "t"), threshold), "omh-verified")
    return sims.where("similarity >= 0").select("node", "lead")


def _node_table(base: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """(node, n, bag, fine, keys, t): what is known of each node, bucketed by node, so that rounds move pairs and what they need; and a way to drop it."""
    spark = base.sparkSession
    path, name, parts = new_path(spark, "omh-nodes"), f"vf_omh_nodes_{uuid.uuid4().hex}", shuffle_partitions(spark)
    own = nodes.select(F.col("node").alias("n2"), F.col("doc").alias("rep"), "n", "bag", "fine", "keys")
    rows = base.join(own, (F.col("node") == F.col("n2")) & F.col("doc").eqNullSafe(F.col("rep"))).select("node", "n", "bag", "fine", "keys", "t")
    rows = rows.repartition(parts, "node").dropDuplicates(["node"])
    rows.write.bucketBy(parts, "node").sortBy("node").option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)

    def drop() -> None:
        release(table)
        spark.sql(f"DROP TABLE {name}")

    return table, drop


def _compare(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Bring the texts of both sides together and verify; the comparisons with one lead are dealt to parts of SPLIT, about."""
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / SPLIT).cast("long").alias("parts"))
    dealt = pairs.join(parts, "lead").select("node", "lead", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    left = dealt.join(texts.withColumnRenamed("t", "a"), "node")
    right = parts.join(texts.select(F.col("node").alias("lead"), F.col("t").alias("b")), "lead")
    right = right.select("lead", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return verify(left.join(right, ["lead", "part"]), threshold)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("doc").alias("doc_id"), "class_id", F.col("doc").eqNullSafe(F.col("class_id")).alias("kept"))
