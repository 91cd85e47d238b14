"""Benchmark decontamination: MinHash containment search with exact verification.

An item is contained in a document if at least ``threshold`` of its distinct
shingles of five words (lower-cased; punctuation and space separate words) occur
there. Each item is sketched by its minimum hashes. An item of n shingles that
is contained misses at most m = floor((1 - threshold) n) of them, so of its
m + 1 smallest hashes one occurs in the document for sure: items are partitioned
by size, each size with a sketch as long as needed and no longer. Looking a
sketch up among the hashes of a document does not depend on the document's
length, so short items are found in very long texts. Candidates are verified on
the words themselves.

Items are the stated query set: they are streamed to the executors in blocks of
at most ``BLOCK_BYTES`` of text, each block running over all documents, so the
broadcast is bounded however large the benchmark grows.

Items with fewer than five words have one shingle of all their words; items
without words, and null texts, never match. Null and repeated ids pass through:
each row is compared for itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, WORD_SQL, bounded_batches, buffers, lowered, shingle_hashes, slices, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8 << 20
_BITS = 20


@dataclass
class ItemBlock:
    """Sketches of a block of items by length of shingle, and the shingles of each item."""

    ids: list[int | None] = field(default_factory=list)
    shingles: list[frozenset[tuple[bytes, ...]]] = field(default_factory=list)
    #: shingle length -> sorted hashes, item of each, filter by low bits
    sketch: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def item_shingles(text: str | None, k: int = SHINGLE) -> tuple[int, frozenset[tuple[bytes, ...]]]:
    """Shingle length used (less than ``k`` for short items) and the distinct shingles."""
    return _shingles(lowered(pa.array([text], pa.string()))[0].as_py().encode(), k)  # the rule that documents are lower-cased by


def _shingles(text: bytes, k: int = SHINGLE) -> tuple[int, frozenset[tuple[bytes, ...]]]:
    words = WORD.findall(text)
    k = min(k, len(words))
    return k, frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def sketch_length(n: int, threshold: float) -> int:
    """One more than the shingles that a contained item of ``n`` may miss."""
    return n - needed(n, threshold) + 1


def needed(n: int, threshold: float) -> int:
    """Fewest shared shingles that make up ``threshold`` of ``n``."""
    k = int(threshold * n)
    while k / n < threshold:
        k += 1
    return max(1, k)


def build_block(items: list[tuple[int | None, str | None]], threshold: float) -> ItemBlock:
    """The block of some items; shingles are hashed for many items at once, as those of documents are."""
    out = ItemBlock()
    entries: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
    table = pa.RecordBatch.from_arrays([pa.array([i for i, _ in items], pa.int64()), pa.array([t for _, t in items], pa.string())], names=["i", "t"])
    for part in slices(table, "t"):
        data, off = buffers(lowered(part.column("t")))
        words, _, _, woff = word_hashes(data, off)
        size = np.minimum(np.diff(woff), SHINGLE)
        spans = {}
        for k in np.unique(size[size > 0]).tolist():
            h, at = shingle_hashes(words, woff, k)
            spans[k] = h, np.searchsorted(at, woff)
        for n, item_id in enumerate(part.column("i").to_pylist()):
            k, own = _shingles(data[off[n] : off[n + 1]].tobytes())
            if not own:
                continue
            h, ends = spans[k]
            entries[k].append((np.unique(h[ends[n] : ends[n + 1]])[: sketch_length(len(own), threshold)], len(out.ids)))
            out.ids.append(item_id)
            out.shingles.append(own)
    for k, sketches in entries.items():
        hashes = np.concatenate([h for h, _ in sketches])
        owners = np.repeat([a for _, a in sketches], [len(h) for h, _ in sketches])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        seen = np.zeros(1 << _BITS, bool)
        seen[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        out.sketch[k] = hashes, owners[order], seen
    return out


def _candidates(block: ItemBlock, words: np.ndarray, woff: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) pairs that share a sketched shingle."""
    found: set[tuple[int, int]] = set()
    for k, (hashes, items, seen) in block.sketch.items():
        h, at = shingle_hashes(words, woff, k)
        hit = np.flatnonzero(seen[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(hashes, h[hit], "left"), np.searchsorted(hashes, h[hit], "right")
        sure = hi > lo
        texts = np.searchsorted(woff, at[hit[sure]], "right") - 1
        for t, a, b in zip(texts.tolist(), lo[sure].tolist(), hi[sure].tolist(), strict=True):
            found.update((t, int(i)) for i in items[a:b])
    return found


def contained_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, item_shingles, shared_shingles, containment) for each document and item contained in it."""
    bounded_batches(docs.sparkSession)
    inner = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    id_type = inner.schema["__id"].dataType.simpleString()
    out = None
    for shared in _blocks(items, item_col, item_text_col, threshold, block_bytes):
        part = inner.mapInArrow(_searcher(shared, threshold), f"__id {id_type}, item long, n long, shared long")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("__id").alias(id_col), F.col("item").alias(item_col), F.col("n").alias("item_shingles"), F.col("shared").alias("shared_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def _blocks(items: DataFrame, item_col: str, item_text_col: str, threshold: float, block_bytes: int) -> list[Broadcast[ItemBlock]]:
    """The items as broadcast blocks, one at least."""
    sc = items.sparkSession.sparkContext
    asked = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    blocks, now, size = [], [], 0
    for r in asked.toLocalIterator():  # block by block, never more than one block of texts at a time
        now.append((r["i"], r["t"]))
        size += len((r["t"] or "").encode())
        if size >= block_bytes:
            blocks.append(sc.broadcast(build_block(now, threshold)))
            now, size = [], 0
    if now or not blocks:
        blocks.append(sc.broadcast(build_block(now, threshold)))
    return blocks


def _contained(texts: pa.Array, block: ItemBlock, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, its shingles, those shared), texts and items by their place."""
    data, off = buffers(lowered(texts))
    words, _, _, woff = word_hashes(data, off)
    by_text = defaultdict(list)
    for t, i in _candidates(block, words, woff):
        by_text[t].append(i)
    for t, cands in sorted(by_text.items()):
        own = WORD.findall(data[off[t] : off[t + 1]].tobytes())
        sets: dict[int, set] = {}
        for i in sorted(cands):
            want = block.shingles[i]
            k = len(next(iter(want)))
            if k not in sets:
                sets[k] = set(zip(*[own[j:] for j in range(k)], strict=False))
            both = len(want & sets[k])
            if both >= needed(len(want), threshold):
                yield t, i, len(want), both


def _searcher(shared: Broadcast[ItemBlock], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in slices(batch, "__t"):
                found = list(_contained(part.column("__t"), block, threshold))
                if found:
                    rows, at, sizes, counts = (pa.array(c, pa.int64()) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("__id").take(rows), pa.array(block.ids, pa.int64()).take(at), sizes, counts], names=["__id", "item", "n", "shared"])

    return run


def _sieve(shared: Broadcast[ItemBlock], threshold: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                clean = np.ones(part.num_rows, bool)
                clean[[t for t, *_ in _contained(part.column(text), shared.value, threshold)]] = False
                yield part.filter(pa.array(clean))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Rows are judged as they pass, block of items by block, so nothing is
    shuffled and no id is needed. ``text_col`` must be a string.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    text = f"__c{[c.lower() for c in names].index(text_col.lower())}"
    rest = docs.toDF(*[f"__c{n}" for n in range(len(names))])
    schema = rest.schema
    for shared in _blocks(items, item_col, item_text_col, threshold, block_bytes):
        rest = rest.mapInArrow(_sieve(shared, threshold, text), schema)
    return rest.toDF(*names)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}') AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[u.i:u.i + k - 1], ' ') AS s FROM k, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) u),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM k),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[u.i:u.i + ks.k - 1], ' ') AS s FROM w, ks, LATERAL (SELECT unnest(range(1, len(w) - ks.k + 2)) AS i) u),
c AS (SELECT ds.doc_id, bs.item_id, count(*) AS shared FROM ds JOIN bs ON ds.s = bs.s GROUP BY ds.doc_id, bs.item_id)
SELECT c.doc_id, c.item_id, CAST(n.n AS BIGINT) AS item_shingles, CAST(c.shared AS BIGINT) AS shared_shingles,
       CAST(c.shared AS DOUBLE) / CAST(n.n AS DOUBLE) AS containment
FROM c JOIN n ON c.item_id = n.item_id WHERE CAST(c.shared AS DOUBLE) / CAST(n.n AS DOUBLE) >= CAST(0.8 AS DOUBLE)
"""
