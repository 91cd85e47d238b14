"""Removal of long repeats across documents, byte by byte, with run-length indexes.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in
a document with a smaller id. Nearly all strings occur in one document only, and
no machine can index all documents at once, so:

1. Every string (window) of ``LENGTH`` bytes has an anchor, the least hash of its
   substrings of ``ANCHOR`` bytes; equal windows have equal anchors. Documents
   hand in their distinct anchors, packed, by shards of the hash. The owner of
   an anchor is the least document that has it.
2. Windows whose anchor two documents share are cut out as regions: those of the
   owner are indexed, those of others are streamed against their owner's index.
3. A run-length index of the owner's regions gives matching statistics; windows
   that match ``LENGTH`` bytes are marked.
4. A window that its anchor's owner lacks can still be in a third document with
   the same anchor (texts that differ just beside a shared passage). Those
   windows are compared by their 128-bit hashes, least document first, which
   completes the result exactly.

Identical texts are one: all but the least id are covered whole, if they have
``LENGTH`` bytes. A hot anchor is pre-aggregated within each task, the regions that
are streamed against a hot owner are dealt to several tasks; no group is collected.

Null texts are empty. Rows with equal id never remove bytes from each other. A
null id sorts last. Kept bytes may split characters, so they are binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _power_table, bounded_batches, buffers, materialize, mix, release, shuffle_partitions, slices
from .run_length_index import RunLengthIndex

LENGTH = 50
ANCHOR = 32
LAST_ID = (1 << 63) - 1
#: Anchors that a task gathers before it packs them; bounds its memory.
FLUSH = 500_000
#: Positions that are hashed at once.
BLOCK = 1 << 14
#: An owner's index goes to a further task for each so many bytes that are streamed against it (or as many as it has
#: itself, if more); the owners that have most are looked at, the others stay with one task.
HOT_BYTES, HOT_OWNERS = 256 << 10, 10_000
#: Bytes of regions that are indexed and matched at once; bounds the memory of a Python worker.
MATCH_BYTES = 2 << 20
_KEY_BYTES = 6
_NONE = np.uint64((1 << 64) - 1)


def window_anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> np.ndarray:
    """The anchor of the window that starts at each byte; all ones where no window of the same text starts."""
    n, span = len(data), length - k + 1
    out = np.full(n, _NONE)
    for at in range(0, n - length + 1, BLOCK):
        low, have = rolling_hashes(data[at : at + BLOCK + length - 1], k), 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        rest = span - have
        np.minimum(low[: len(low) - rest], low[rest:], out=out[at : at + len(low) - rest])
    for start, end in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        out[max(start, end - length + 1) : end] = _NONE
    return out


def rolling_hashes(data: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position on."""
    out = np.empty(max(0, len(data) - k + 1), np.uint64)
    power, inverse = _power_table(BLOCK + k)
    values = np.arange(1, 257, dtype=np.uint64)
    values = mix(values + np.uint64(salt * 256)) if salt else values
    # blocks stay in the processor's cache
    for at in range(0, len(out), BLOCK):
        own = values[data[at : at + BLOCK + k - 1]]
        own *= power[: len(own)]
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own, out=total[1:])
        h = total[k:] - total[:-k]
        h *= inverse[: len(h)]
        out[at : at + len(h)] = mix(h)
    return out


def keys_of(anchors: np.ndarray) -> np.ndarray:
    return anchors & np.uint64((1 << (8 * _KEY_BYTES)) - 1)


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _KEY_BYTES, 8), np.uint8)
    out[:, :_KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _KEY_BYTES)
    return out.view("<u8").ravel()


PACKED = "gid long, shard int, keys binary, counts binary, docs array<long>, lengths array<int>"


def pack_anchors(base: DataFrame, shards: int) -> DataFrame:
    """From (doc, t): per task flush and shard the anchors with their least document and local count.

    The further local documents of an anchor are listed apart (shard -1, with
    whole anchors): they wait until the owner is known, so a hot anchor reaches
    its shard once per flush only.
    """

    def flush(gid: int, anchors: list[np.ndarray], rows: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, rank = np.unique(np.concatenate(docs), return_inverse=True)
        a, d = np.concatenate(anchors), rank[np.concatenate(rows)]
        order = np.argsort(a)
        a, d = a[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        size = np.diff(np.concatenate([first, [len(a)]]))
        least, last = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
        count = np.where(least == last, 1, np.minimum(size, 3)).astype(np.uint8)
        rest = d != np.repeat(least, size)
        others, rest = a[rest], d[rest]
        order = np.argsort(rest, kind="stable")
        yield _packed(gid, -1, others[order].tobytes(), b"", *_runs(ids[rest[order]]))
        a = a[first]
        shard = ((a >> np.uint64(48)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort((shard << 32) | least)
        shard, key, count, least = shard[order], keys_of(a[order]), count[order], least[order]
        edges = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[s], edges[s + 1]
            yield _packed(gid, s, _pack(key[lo:hi]), count[lo:hi].tobytes(), *_runs(ids[least[lo:hi]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, anchors, rows, docs, size, n = TaskContext.get().partitionId() << 24, [], [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "t"):
                data, off = buffers(part.column("t"))
                a = window_anchors(data, off)
                begins = a != _NONE
                begins[1:] &= a[1:] != a[:-1]
                starts = off[:-1][off[:-1] < len(a)]
                begins[starts] = a[starts] != _NONE
                at = np.flatnonzero(begins)
                anchors.append(a[at])
                rows.append(np.searchsorted(off, at, "right") - 1 + n)
                docs.append(part.column("doc").to_numpy())
                size, n = size + len(at), n + part.num_rows
                if size >= FLUSH:
                    yield from flush(gid, anchors, rows, docs)
                    gid, anchors, rows, docs, size, n = gid + 1, [], [], [], 0, 0
        if size:
            yield from flush(gid, anchors, rows, docs)

    return base.select("doc", "t").mapInArrow(run, PACKED)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal values: the value and length of each."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    return values[heads], np.diff(np.concatenate([heads, [len(values)]]))


def _packed(gid, shard, keys, counts, docs, lengths) -> pa.RecordBatch:
    cols = [pa.array([gid], pa.int64()), pa.array([shard], pa.int32()), pa.array([keys], pa.binary()), pa.array([counts], pa.binary())]
    for values, kind in ((docs, pa.int64()), (lengths, pa.int32())):
        cols.append(_lists(1, np.zeros(len(values), np.int64), values, kind))
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PACKED.split(", ")])


OWNERS = "gid long, shard int, keys binary, docs array<long>, lengths array<int>, owners binary, more binary"


def find_owners(packed: DataFrame, shards: int) -> DataFrame:
    """By flush and shard the keys that two documents have, with the flush's least document and the owner; ``more``: a third one has it too."""

    def solve(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([_unpack(r[1]) for r in rows])
        local = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows]).astype(np.int64)
        doc = np.concatenate([np.repeat(r[3], r[4]) for r in rows])
        gid = np.repeat(np.array([r[0] for r in rows]), [len(r[2]) for r in rows])
        order = np.lexsort((doc, key))
        key, local, doc, gid = key[order], local[order], doc[order], gid[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        total = np.add.reduceat(local, first)
        owner, shared, more = np.repeat(doc[first], size), np.repeat(total > 1, size), np.repeat(total > 2, size)
        key, doc, gid, owner, more = (x[shared] for x in (key, doc, gid, owner, more))
        order = np.lexsort((owner, doc, gid))
        key, doc, gid, owner, more = (x[order] for x in (key, doc, gid, owner, more))
        out, edges = [], [0, *np.cumsum(_runs(gid)[1]).tolist()]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            docs, lengths = _runs(doc[lo:hi])
            out.append((int(gid[lo]), shard, _pack(key[lo:hi]), docs, lengths, owner[lo:hi].tobytes(), more[lo:hi].tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=[c.split()[0] for c in OWNERS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("docs", "lengths")]
                rows.setdefault(batch.column("shard")[i].as_py(), []).append((batch.column("gid")[i].as_py(), batch.column("keys")[i].as_py(), batch.column("counts")[i].as_py(), *lists))
        for shard in list(rows):
            yield from solve(shard, rows.pop(shard))

    blobs = packed.where("shard >= 0").select("gid", "shard", "keys", "counts", "docs", "lengths").repartition(shards, "shard")
    return blobs.mapInArrow(run, OWNERS)


LISTS = "doc long, keys binary, owners binary, more binary"


def list_owners(packed: DataFrame, owners: DataFrame, shards: int) -> DataFrame:
    """By flush and document its shared keys with their owners; a flush's anchors are resolved in one task, no anchor is a row."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        known, others = [r for r in rows if r[0] >= 0], [r for r in rows if r[0] < 0]
        if not known:
            return
        mask = np.uint64((1 << 48) - 1)
        code = np.concatenate([_unpack(r[1]) | np.uint64(r[0] << 48) for r in known])
        owner, more = (np.concatenate([np.frombuffer(r[j], kind) for r in known]) for j, kind in ((4, np.int64), (5, np.bool_)))
        doc = np.concatenate([np.repeat(r[2], r[3]) for r in known])
        order = np.argsort(code)
        code, owner, more, doc = code[order], owner[order], more[order], doc[order]
        if others:
            a = np.concatenate([np.frombuffer(r[1], np.uint64) for r in others])
            which = np.concatenate([np.repeat(r[2], r[3]) for r in others])
            asked = (((a >> np.uint64(48)) % np.uint64(shards)) << np.uint64(48)) | (a & mask)
            at = np.minimum(np.searchsorted(code, asked), len(code) - 1)
            hit = code[at] == asked
            at, which = at[hit], which[hit]
            code, owner, more, doc = np.concatenate([code, code[at]]), np.concatenate([owner, owner[at]]), np.concatenate([more, more[at]]), np.concatenate([doc, which])
        order = np.lexsort((owner, doc))
        docs, lengths = _runs(doc[order])
        edges = np.concatenate([[0], np.cumsum(lengths)])
        cols = [_binaries(raw, edges * width) for raw, width in ((_pack(code[order] & mask), _KEY_BYTES), (owner[order].tobytes(), 8), (more[order].tobytes(), 1))]
        yield pa.RecordBatch.from_arrays([pa.array(docs), *cols], names=[c.split()[0] for c in LISTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for i, gid in enumerate(batch.column("gid").to_pylist()):
                if gid != last and rows:
                    yield from solve(rows)
                    rows = []
                last = gid
                lists = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("docs", "lengths")]
                rows.append((batch.column("shard")[i].as_py(), batch.column("keys")[i].as_py(), *lists, batch.column("owners")[i].as_py(), batch.column("more")[i].as_py()))
        if rows:
            yield from solve(rows)

    none = F.lit(None).cast("binary")
    others = packed.where("shard < 0").select("gid", "shard", "keys", "docs", "lengths", none.alias("owners"), none.alias("more"))
    return owners.unionByName(others).repartition("gid").sortWithinPartitions("gid").mapInArrow(run, LISTS)


def _binaries(raw: bytes, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])


REGIONS = "owner long, doc long, h long, size long, starts array<int>, more array<boolean>, pieces array<binary>"


def cut_regions(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """From (doc, h, t, keys, owners, more): a row per document and owner with its maximal runs of windows of that owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                data, off = buffers(part.column("t"))
                anchors = window_anchors(data, off)
                # windows in a row with one anchor are looked up once; the end of a text has none
                heads = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])[: len(anchors)])
                none = anchors[heads] == _NONE
                heads, ends = heads[~none], np.concatenate([heads[1:], [len(anchors)]])[~none]
                if not len(heads):
                    continue
                row = np.searchsorted(off, heads, "right") - 1
                code, owners, more = _listed(part)
                asked = (row.astype(np.uint64) << np.uint64(48)) | keys_of(anchors[heads])
                at = np.minimum(np.searchsorted(code, asked), len(code) - 1)
                hit = code[at] == asked
                heads, ends, row, at = heads[hit], ends[hit], row[hit], at[hit]
                if not len(heads):
                    continue
                who, rest = owners[at], more[at]
                new = np.concatenate([[True], (heads[1:] != ends[:-1]) | (who[1:] != who[:-1]) | (rest[1:] != rest[:-1])])
                last = np.concatenate([new[1:], [True]])
                begin, until, row, who, rest = heads[new], ends[last] + length - 1, row[new], who[new], rest[new]
                order = np.lexsort((begin, who, row))
                begin, until, row, who, rest = (x[order] for x in (begin, until, row, who, rest))
                raw = data.tobytes()
                pieces = pa.array([raw[s:e] for s, e in zip(begin.tolist(), until.tolist(), strict=True)], pa.binary())
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (who[1:] != who[:-1])]))
                edges = pa.array(np.concatenate([first, [len(row)]]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, x) for x in (pa.array((begin - off[row]).astype(np.int32)), pa.array(rest), pieces)]
                take = pa.array(row[first])
                cols = [pa.array(who[first]), part.column("doc").take(take), part.column("h").take(take), pa.array(np.add.reduceat(until - begin, first))]
                yield pa.RecordBatch.from_arrays([*cols, *lists], names=[c.split()[0] for c in REGIONS.split(", ")])

    return docs.mapInArrow(run, REGIONS)


def _listed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists of all rows by row number and key: both in 64 bits, the owner, whether a third document has the key."""
    keys, owners, more = (b"".join(part.column(c).flatten().to_pylist()) for c in ("keys", "owners", "more"))
    sizes = np.array([sum(map(len, x)) for x in part.column("more").to_pylist()])
    code = (np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(48)) | _unpack(keys)
    order = np.argsort(code, kind="stable")
    return code[order], np.frombuffer(owners, np.int64)[order], np.frombuffer(more, np.bool_)[order]


MARKS = "doc long, h long, begins array<int>, ends array<int>, w1 array<long>, w2 array<long>, at array<int>"


def match_regions(regions: DataFrame, length: int = LENGTH) -> DataFrame:
    """Regions of others against their owner's: removed bytes [begin, end) and the windows left to compare.

    A task gets an owner's regions once, before those that are streamed against
    them; the index of a hot owner goes to several tasks.
    """
    own = F.col("owner") == F.col("doc")
    hot = regions.groupBy("owner").agg(F.sum(F.when(~own, F.col("size"))).alias("asked"), F.sum(F.when(own, F.col("size")).otherwise(0)).alias("size"))
    hot = hot.where(F.col("asked") > HOT_BYTES).orderBy(F.desc("asked")).limit(HOT_OWNERS)
    hot = hot.select("owner", F.ceil(F.col("asked") / F.greatest("size", F.lit(HOT_BYTES))).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    place = F.when(own, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.hash("doc", "h"), parts)))
    dealt = regions.join(F.broadcast(hot), "owner", "left").select("owner", F.explode(place).alias("part"), own.alias("own"), "doc", "h", "size", "starts", "more", "pieces")
    dealt = dealt.repartition("owner", "part").sortWithinPartitions("owner", "part", F.desc("own"))
    return dealt.mapInArrow(lambda batches: match_batches(batches, length), MARKS)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``MATCH_BYTES`` of regions, one row at least."""
    for batch in batches:
        total, at = np.cumsum(batch.column("size").to_numpy()), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MATCH_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def match_batches(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """(owner, own, doc, h, size, starts, more, pieces), an owner's own rows before those of others: one index for all owners that begin in a portion."""
    index, owner, owned, carried = None, None, False, []
    for batch in _portions(batches):
        owners, own = batch.column("owner").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
        # an owner's rows that follow on those of the last portion are text 0
        new = np.concatenate([[owner is None or owners[0] != owner], owners[1:] != owners[:-1]])
        new |= own & ~np.concatenate([[owned], own[:-1]])
        text = np.cumsum(new)
        pieces = batch.column("pieces").to_pylist()
        texts: list[list[bytes]] = [[] for _ in range(int(text[-1]) + 1)]
        texts[0] = carried
        for i in np.flatnonzero(own).tolist():
            texts[text[i]] += pieces[i]
        owner, owned, carried = owners[-1], bool(own[-1]), texts[-1] if own[-1] else []
        rows = np.flatnonzero(~own)
        if not len(rows):
            continue
        counts = np.array([len(pieces[i]) for i in rows.tolist()])
        patterns = [p for i in rows.tolist() for p in pieces[i]]
        of = np.repeat(text[rows], counts)
        windows = np.fromiter(map(len, patterns), np.int64, len(patterns)) - length + 1
        old = 0
        if index is not None and not texts[0]:
            old = int(np.searchsorted(of, 1))
        found = [index.all_matches(patterns[:old], np.full(old, slot))] if old else []
        if old < len(patterns):
            # a text without pieces is one border
            texts = [t or [b""] for t in texts[: int(of[-1]) + 1]]
            index = RunLengthIndex([p for t in texts for p in t], length, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
            slot = len(texts) - 1
            found.append(index.all_matches(patterns[old:], of[old:]))
        starts, more = (_flat(batch.column(c), rows) for c in ("starts", "more"))
        marks = _marks(np.concatenate(found), windows, np.repeat(np.arange(len(rows)), counts), starts, more, patterns, length)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        cols = [_lists(len(rows), *x, kind) for x, kind in zip(marks, kinds, strict=True)]
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("h").take(take), *cols], names=[c.split()[0] for c in MARKS.split(", ")])


def _flat(lists: pa.ListArray, rows: np.ndarray) -> np.ndarray:
    return lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)


def _marks(found: np.ndarray, windows: np.ndarray, rows: np.ndarray, starts: np.ndarray, more: np.ndarray, patterns: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For patterns with so many windows: begin and end of the removed runs, and both hashes and the place of each window left to compare, with their rows."""
    edge = np.cumsum(windows) - windows
    head = np.zeros(len(found) + 1, bool)
    head[edge] = head[-1] = True
    begins = np.flatnonzero(found & (head[:-1] | ~np.concatenate([[False], found[:-1]])))
    ends = np.flatnonzero(found & (head[1:] | ~np.concatenate([found[1:], [False]])))
    piece = np.searchsorted(edge, begins, "right") - 1
    shift = starts - edge
    left = np.flatnonzero(~found & np.repeat(more, windows))
    of = np.searchsorted(edge, left, "right") - 1
    asked, of_asked = np.unique(of, return_inverse=True)
    data = np.frombuffer(b"".join([patterns[p] for p in asked.tolist()]), np.uint8)
    sizes = windows[asked] + length - 1
    at = left - edge[of] + (np.cumsum(sizes) - sizes)[of_asked]
    hashes = [(rows[of], rolling_hashes(data, length, salt)[at].view(np.int64)) for salt in (0, 1)]
    return [(rows[piece], begins + shift[piece]), (rows[piece], ends + shift[piece] + length), *hashes, (rows[of], left + shift[of])]


def _lists(n: int, rows: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values by row, rows ascending, as one list for each of n rows."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype())))


def covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a range."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, np.minimum(ends, n), -1)
    return np.cumsum(step[:n]) > 0


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), text.alias("t"))
    base = base.withColumn("h", F.xxhash64("t"))
    shards = 2 * shuffle_partitions(spark)

    prints = materialize(base.select("doc", "h", F.xxhash64(F.lit(1), "t").alias("h2")), "repeat-texts")
    leasts = prints.groupBy("h", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least != last")
    copies = materialize(prints.join(leasts, ["h", "h2"]).where("doc != least").select("doc", "h").distinct(), "repeat-copies")

    packed = materialize(pack_anchors(base, shards), "repeat-anchors")
    owners = materialize(find_owners(packed, shards), "repeat-owners")
    listed = list_owners(packed, owners, shards).groupBy("doc").agg(F.collect_list(F.struct("keys", "owners", "more")).alias("a"))
    by_doc = materialize(listed.select("doc", F.col("a.keys").alias("keys"), F.col("a.owners").alias("owners"), F.col("a.more").alias("more")), "repeat-lists")
    release(packed, owners, prints)

    asked = base.select("doc", "h", "t").join(by_doc.hint("shuffle_hash"), "doc").join(copies, ["doc", "h"], "left_anti")
    regions = materialize(cut_regions(asked, length), "repeat-regions")
    release(by_doc)
    marks = materialize(match_regions(regions, length), "repeat-marks")
    release(regions)

    left = marks.select("doc", "h", F.explode(F.arrays_zip("w1", "w2", "at")).alias("w")).select("doc", "h", "w.w1", "w.w2", "w.at")
    firsts = left.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least != last").drop("last")
    late = left.join(firsts, ["w1", "w2"]).where("doc != least").groupBy("doc", "h").agg(F.collect_list("at").alias("begins"))
    late = late.select("doc", "h", "begins", F.transform("begins", lambda x: x + length).alias("ends"))
    ranges = marks.where("size(begins) > 0").select("doc", "h", "begins", "ends").unionByName(late)
    gone = ranges.groupBy("doc", "h").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"), F.lit(False).alias("whole"))
    empty = F.array().cast("array<int>")
    gone = materialize(gone.unionByName(copies.select("doc", "h", empty.alias("begins"), empty.alias("ends"), F.lit(True).alias("whole"))), "repeat-gone")
    release(marks)
    return _apply(base.join(gone.hint("shuffle_hash"), ["doc", "h"], "left"), length).withColumnRenamed("id", id_col)


def _apply(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                data, off = buffers(part.column("t"))
                begins, ends, whole = (part.column(c) for c in ("begins", "ends", "whole"))
                out: list[tuple] = []
                for i in range(part.num_rows):
                    own = data[off[i] : off[i + 1]]
                    n, removed, spans = len(own), 0, 0
                    if whole[i].is_valid and whole[i].as_py():
                        if n >= length:
                            own, removed, spans = own[:0], n, 1
                    elif whole[i].is_valid:
                        mask = covered(n, begins[i].values.to_numpy(), ends[i].values.to_numpy())
                        removed, spans = int(mask.sum()), int((np.diff(np.concatenate([[False], mask]).astype(np.int8)) == 1).sum())
                        own = own[~mask]
                    kept = own.tobytes()
                    out.append((kept, n, removed, spans, hashlib.sha256(kept).hexdigest()))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]], names=["id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("id", "t", "begins", "ends", "whole").mapInArrow(run, "id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, p, x[p + 1:p + 50] AS s FROM (SELECT doc_id, x, unnest(range(octet_length(x) - 49)) AS p FROM d WHERE octet_length(x) >= 50)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, p + o AS b FROM r, (SELECT unnest(range(50)) AS o)),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before <> b - 1) AS n_spans FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM c) GROUP BY doc_id),
a AS (SELECT doc_id, x, unnest(range(octet_length(x))) AS b FROM d WHERE doc_id IN (SELECT doc_id FROM n)),
k AS (SELECT a.doc_id, string_agg(hex(x[a.b + 1:a.b + 1]), '' ORDER BY a.b) AS kept FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.b = c.b WHERE c.b IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN n_removed IS NULL THEN sha256(text) ELSE sha256(unhex(coalesce(kept, ''))) END AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
