"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches (here: ascending ranges of doc_id, so that "seen
before" means "in a document with a smaller id"). A run is a table of line
hashes, bucketed and sorted by hash, each with the document that owns the line.
A batch is reduced to its distinct hashes, merge-anti-joined with the runs, and
what is new becomes a run of level 0; ``fanout`` runs of a level are compacted
into one of the next. Runs are bucketed alike, so joins and compactions of runs
move no data.

Lines are split at \\n; a key is a line stripped of ``[\\x20\\x09-\\x0D]`` and
ASCII-lower-cased. Keys shorter than ``min_chars`` code points are never
touched. Null and empty texts are one empty line. Rows with the same id count as
one document: they never remove lines from each other. A null id sorts last.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, buffers, materialize, new_path, shuffle_partitions, slices

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
#: A key is hot in a batch if at least one in this many of the batch's (document, key) rows has it; so there are fewer hot keys than this.
HOT_SHARE = 1_000
LAST_ID = (1 << 63) - 1


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line of a UTF-8 text."""
    return [line.strip() for line in text.lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    """At least ``min_chars`` code points, without decoding where bytes decide."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _texts(batch: pa.RecordBatch, col: str) -> list[bytes]:
    data, off = buffers(batch.column(col))
    raw = data.tobytes()
    return [raw[off[i] : off[i + 1]] for i in range(batch.num_rows)]


def line_hashes(docs: DataFrame, *, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2) for each distinct long key of each document row."""
    inner = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                digests, counts = [], []
                for text in _texts(part, "t"):
                    own = {key_hash(k) for k in line_keys(text) if long_enough(k, min_chars)}
                    digests += own
                    counts.append(len(own))
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                docs_ = np.repeat(part.column("doc").to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(docs_), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc", "h1", "h2"])

    return inner.mapInArrow(run, "doc long, h1 long, h2 long")


class RunStore:
    """Levelled runs of (h1, h2, owner), bucketed by hash; each hash is in one run only."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def bucketed(self, df: DataFrame, name: str) -> str:
        table = f"vf_{name}_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", new_path(self.spark, name)).format("parquet").saveAsTable(table)
        self.tables.append(table)
        return table

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t).where("fresh").select("h1", "h2", "owner") for level in self.levels for t in level]

    def resolve(self, keys: DataFrame) -> str:
        """Merge the batch's (h1, h2, owner, last, n) with the runs, keep what is new as a run, and compact.

        Returns the table of the batch's hashes with their owners: ``fresh`` for
        new ones, ``shared`` where some document of the batch loses the line.
        """
        owners = []
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.withColumnRenamed("owner", f"o{i}"), ["h1", "h2"], "left")
            owners.append(f"o{i}")
        prior = F.coalesce(*owners) if owners else F.lit(None).cast("long")
        keys = keys.withColumn("prior", prior)
        table = self.bucketed(keys.select("h1", "h2", F.coalesce("prior", "owner").alias("owner"), F.col("prior").isNull().alias("fresh"), (F.col("prior").isNotNull() | (F.col("last") > F.col("owner"))).alias("shared"), "n"), "run")
        self._add(table, 0)
        return table

    def _add(self, table: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            merged = None
            for t in self.levels[level]:
                run = self.spark.table(t).where("fresh").select("h1", "h2", "owner", "fresh")
                merged = run if merged is None else merged.unionByName(run)
            self.levels[level] = []
            self._add(self.bucketed(merged, f"level{level + 1}"), level + 1)


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, drop): for each document, the hashes of the keys whose lines it loses, as array<struct<h1, h2>>."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"))
    cuts = ids.agg(F.percentile_approx("doc", F.array(*[F.lit((i + 1) / batches) for i in range(batches - 1)]), 1000)).first()[0] if batches > 1 else []
    batch = F.lit(0)
    for c in sorted(set(cuts or [])):
        batch = batch + (F.col("doc") > F.lit(c)).cast("int")
    hashes = line_hashes(docs, id_col=id_col, text_col=text_col, min_chars=min_chars).withColumn("batch", batch)
    path = new_path(spark, "lines")
    hashes.write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema("doc long, h1 long, h2 long, batch int").parquet(path)
    store = RunStore(spark, shuffle_partitions(spark), fanout)
    drops = None
    for b in range(len(set(cuts or [])) + 1):
        own = hashes.where(F.col("batch") == b)
        table = store.resolve(own.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("*").alias("n")))
        lost = _lost(own, spark.table(table).where("shared").select("h1", "h2", "owner", "n"))
        drops = lost if drops is None else drops.unionByName(lost)
    return drops.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def _lost(own: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc, h1, h2) of the batch's rows whose key is owned by another document.

    The rows of a hot key stay where they are: hot keys, fewer than HOT_SHARE,
    are broadcast; all others meet in a merge join.
    """
    rows = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = F.lit(rows / HOT_SHARE)
    hot = shared.where(F.col("n") > limit).select("h1", "h2", F.col("owner").alias("hot_owner"))
    marked = own.select("doc", "h1", "h2").join(F.broadcast(hot), ["h1", "h2"], "left")
    here = marked.where("hot_owner is not null and doc != hot_owner")
    rest = marked.where("hot_owner is null").join(shared.where(F.col("n") <= limit).select("h1", "h2", "owner"), ["h1", "h2"]).where("doc != owner")
    return here.select("doc", "h1", "h2").unionByName(rest.select("doc", "h1", "h2"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, keep: list[str] | None = None) -> DataFrame:
    """All rows with ``keep`` columns (all by default but for those of the result's names), then kept_text, n_lines and n_dropped."""
    keep = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")] if keep is None else keep
    drops = repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, batches=batches, fanout=fanout)
    drops = materialize(drops.select("doc", F.col("drop.h1").alias("d1"), F.col("drop.h2").alias("d2")), "line-drops")
    inner = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("__t"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"))
    joined = inner.join(drops.hint("shuffle_hash"), "doc", "left").drop("doc")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(keep)]), "`__kept` string", "`__n` long", "`__d` long"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in slices(whole, "__t"):
                d1, d2 = part.column("d1"), part.column("d2")
                kept, n, gone = [], [], []
                for i, text in enumerate(_texts(part, "__t")):
                    lines = text.split(b"\n")
                    n.append(len(lines))
                    if d1[i].is_valid:
                        drop = set(map(bytes, np.stack([d1[i].values.to_numpy(), d2[i].values.to_numpy()], 1).view(np.uint8)))
                        lines = [line for line, k in zip(lines, line_keys(text), strict=True) if not (long_enough(k, min_chars) and key_hash(k) in drop)]
                        text = b"\n".join(lines)
                    gone.append(n[-1] - len(lines))
                    kept.append(text)
                cols = [part.column(j) for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*part.schema.names[: len(keep)], "__kept", "__n", "__d"])

    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)], F.col("__kept").alias("kept_text"), F.col("__n").alias("n_lines"), F.col("__d").alias("n_dropped"))


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_zip(range(1, len(p) + 1), p)) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)) d,
       LATERAL (SELECT z[1] AS i, z[2] AS line) u),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.doc_id, l.i, l.line, (o.owner IS NOT NULL AND o.owner <> l.doc_id) AS gone FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
