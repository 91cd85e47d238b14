"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in shuffled (hashed) order; a queue
that must give more than it holds is read a second time. A document's virtual
finish time is the cumulative tokens of its source over the source's target.
Merging all queues by finish time and truncating at the total budget gives each
source its target: the queues advance at rates that are proportional to it.

Running sums are distributed: a source's documents fall into hash ranges of
about ``RANGE_ROWS`` rows, sums of ranges are added up over the small table of
ranges, and a window adds up within a range; the merge is cut the same way, on
ranges of the finish time. So no task holds a whole source, however hot.

A document that straddles the cut is taken if its middle lies before it, so a
source misses its target by half a document at most. Documents are taken whole.

Null text counts as size 0 (never taken); a null source is a source of its own,
last in order; null and repeated ids are ordered by hash, then id, then size,
and rows equal in these are interchangeable. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize

RANGE_ROWS = 2_000
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 42


def word_count(col):
    """Number of runs without ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_key(col):
    """Never null, and in the order of sources: code points, null last."""
    return F.when(col.isNull(), "1").otherwise(F.concat(F.lit("0"), col.cast("string")))


def shuffle_key(id_col, seed: int):
    """40 bits of the MD5 of id and seed: the place in the shuffled order, the same in any SQL engine."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long")


def _parts(rows):
    """Ranges of about RANGE_ROWS rows each, or as many ranges as rows in a range where there are more."""
    return F.ceil(rows / F.greatest(F.lit(float(RANGE_ROWS)), F.sqrt(rows)))


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """Water-filling over the table of sources (source_key, source_size): target = min(weight * level, repeats * size).

    The level is where the targets add up to ``share`` times all sizes. Sources
    reach their limit in the order of limit over weight, so running sums over
    that order give it. The table has a row for each source.
    """
    order = W.orderBy("source_key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", w)
    cap = (F.col("source_size") * repeats).cast("double")
    full = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    filled = (
        ranked.withColumn("cap", cap)
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
    )
    # the first source, in that order, that does not reach its limit fixes the level for all after it
    level = F.min(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)
    out = filled.withColumn("at", level).withColumn("target", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("at")["level"])))
    return out.select("source_key", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each document: id, size, source_size, target, taken, copies and virtual finish of its first copy.

    ``carry`` names further columns to keep. The text itself is read once, to
    be counted, unless it is carried.
    """
    sized = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source_key"), word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"__x_{c}") for c in carry])
    sized = materialize(sized.withColumn("h", shuffle_key(F.col("id"), seed)), "mix-sized")
    by_source = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = source_targets(by_source, weights=weights, share=share, repeats=repeats)
    sources = materialize(by_source.select("source_key", "source_rows").join(targets, "source_key"), "mix-sources")
    keyed = sized.join(sources, "source_key").withColumn("range", F.floor(F.col("h") / F.lit(float(1 << 40)) * _parts(F.col("source_rows"))))
    ranges = keyed.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"))
    before = W.partitionBy("source_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("source_key", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("source_key", "range").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = keyed.join(ranges, ["source_key", "range"], "left").withColumn("cum", F.col("before") + F.sum("size").over(within))
    # one row for each document and reading of its queue; sizes of 0 and sources without a target never enter
    copies = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch")
    finish = lambda cum, epoch: (cum + epoch * F.col("source_size")) / F.col("target")
    queued = materialize(queued.drop("before", "range", "source_rows"), "mix-queued")
    middle = (F.col("cum") - F.col("size") / 2 + F.col("epoch") * F.col("source_size")) / F.col("target")
    stops = queued.where("size > 0 and target > 0").select("id", "h", "size", "cum", "source_key", "source_size", "target", copies).select("id", "h", "size", "epoch", middle.alias("middle"), "source_key")
    cut = _cut(stops, queued, share)
    taken = F.lit(0).cast("long")
    for epoch in range(repeats):
        m = (F.col("cum") - F.col("size") / 2 + epoch * F.col("source_size")) / F.col("target")
        taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & (m <= F.lit(cut)), 1).otherwise(0)
    out = queued.withColumn("copies", taken)
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("int").alias("copies"),
        F.when(F.col("target") > 0, finish(F.col("cum"), F.lit(0))).alias("virtual_finish"), *[F.col(f"__x_{c}").alias(c) for c in carry],
    )


def _cut(stops: DataFrame, queued: DataFrame, share: float) -> float:
    """The virtual time at which the merged queues have given the total budget.

    Tokens fall evenly over the virtual times 0..1, so ranges of equal width are
    a range sort with balanced parts. The range that holds the cut is found from
    the sums of the ranges; only its rows are then sorted.
    """
    total, rows = queued.agg(F.sum("size"), F.count("*")).first()
    if not total:
        return 0.0
    budget, n = share * total, max(1, int(rows / max(RANGE_ROWS, rows**0.5)))
    part = F.least(F.floor(F.col("middle") * n), F.lit(4 * n)).cast("long")
    sums = stops.groupBy(part.alias("part")).agg(F.sum("size").alias("tokens"))
    running = sums.withColumn("cum", F.sum("tokens").over(W.orderBy("part")))
    hit = running.where(F.col("cum") >= budget).orderBy("part").limit(1).first()
    if hit is None:  # every queue is given out in full
        return float("inf")
    inside = stops.where(part == hit["part"]).withColumn("cum", F.sum("size").over(W.orderBy("middle", "h", "source_key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) + (hit["cum"] - hit["tokens"]))
    # nearest document: the one that crosses the budget is in if its middle is
    last = inside.where(F.col("cum") - F.col("size") / 2 <= budget).agg(F.max("middle")).first()[0]
    if last is None:
        last = stops.where(part < hit["part"]).agg(F.max("middle")).first()[0] or 0.0
    return max(float(last), 0.0)


def mixed_documents(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with its columns; ``mixed`` must carry the text's xxhash64 as ``text_hash``.

    Rows that are equal in id and text share the larger of their numbers of copies.
    Columns of ``docs`` that the mix has too are the mix's.
    """
    cols = [c for c in mixed.columns if c not in (id_col, "text_hash")]
    chosen = mixed.where("copies > 0").groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__h")).agg(*[F.max(c).alias(f"__m_{c}") for c in cols])
    out = docs.withColumn("__t", F.xxhash64(F.col(text_col))).join(chosen, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h")))
    return out.select(*[c for c in docs.columns if c not in cols], *[F.col(f"__m_{c}").alias(c) for c in cols])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':42'), 1, 10))::BIGINT AS h FROM documents),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk),
r AS (SELECT *, [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS INTEGER)] AS weight, 2e0 * source_size AS cap FROM s),
f AS (SELECT *, 1.5e0 * CAST(sum(source_size) OVER () AS DOUBLE) AS budget, coalesce(sum(cap) OVER w, 0e0) AS spent, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0e0) AS rest
      FROM r WINDOW w AS (ORDER BY cap / weight, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min_by((budget - spent) / rest, cap / weight) FILTER (WHERE cap > weight * ((budget - spent) / rest)) AS level FROM f),
t AS (SELECT sk, source_size, coalesce(CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END, 0e0) AS target FROM f, v),
q AS (SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY sk ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM d JOIN t USING (sk)),
c AS (SELECT *, (cum - size / 2e0 + epoch * source_size) / target AS middle FROM q, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0 AND target > 0),
o AS (SELECT *, CAST(sum(size) OVER (ORDER BY middle, h, sk, doc_id, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM c),
x AS (SELECT max(middle) AS cut FROM o WHERE total - size / 2e0 <= (SELECT max(budget) FROM f)),
k AS (SELECT doc_id, sk, size, count(*) AS copies FROM c, x WHERE middle <= cut GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.copies, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id = k.doc_id AND q.sk = k.sk AND q.size = k.size
"""
