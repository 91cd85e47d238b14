"""SimHash fingerprints and their Hamming search, in DataFrame functions only.

Terms are runs of ``SHINGLE`` words (shorter at the end of a text), weighted by
their number of occurrences: every occurrence votes with the signed bits of its
64-bit hash. Votes are counted without a loop over bits: four counters of 16
bits share a long, so 16 masked additions take a term's 64 votes; counters are
unpacked after each ``CHUNK`` terms, before any can overflow. A bit is set if
more than half of the votes are for it. Null, empty and blank texts have
fingerprint 0.

The Hamming search follows the pigeonhole principle: 64 bits are cut into six
blocks, and fingerprints within radius 3 agree in three blocks at least. Each of
the 20 tables holds every distinct fingerprint under one choice of three blocks
(about 32 bits), so candidates meet by equality; a pair is counted in the first
table where it meets only.

Rows with null ids come last in the order of documents; rows with equal ids are
ordered by text hash, and equal rows are interchangeable. With one document the
next document is itself; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import SPACES, materialize, shuffle_partitions

SHINGLE = 3
CHUNK = 1 << 15
RADIUS = 3
BLOCKS = 6
#: Rows of a range of ids; the table of ranges is what gets broadcast.
RANGE_ROWS = 2_000
MAX_RANGES = 65_536
QUERY_STEP = 50

_LANES = 16
_MASK = 0x0001000100010001


def words_of(text: Column) -> Column:
    """The words of the lower-cased text; an empty array if there are none."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def terms(words: str) -> Column:
    """For each word in an array column, a struct of it and the up to two words behind it."""
    n = F.greatest(F.size(words), F.lit(1))
    return F.arrays_zip(F.col(words), *[F.slice(words, j + 1, n) for j in range(1, SHINGLE)])


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``keys`` and, for each text column, ``fp_<text>``: one long. ``keys`` must be unique.

    If ``rows`` is already partitioned by a prefix of the keys nothing is
    shuffled; else one partial row per document and chunk is.
    """
    both = rows.select(*keys, F.posexplode(F.array(*[F.coalesce(F.col(t), F.lit("")) for t in texts])).alias("__k", "__t"))
    term = both.withColumn("__w", words_of(F.col("__t"))).select(*keys, "__k", F.posexplode_outer(terms("__w")).alias("__i", "__s"))
    hashed = term.select(*keys, "__k", F.floor(F.coalesce("__i", F.lit(0)) / CHUNK).cast("int").alias("__c"), F.when(F.col("__s").isNotNull(), F.xxhash64("__s")).alias("__h"))
    mask = F.lit(_MASK)
    packed = [F.sum(F.coalesce(F.shiftrightunsigned("__h", j).bitwiseAND(mask), F.lit(0))).alias(f"__p{j}") for j in range(_LANES)]
    chunks = hashed.groupBy(*keys, "__k", "__c").agg(F.count("__h").alias("__n"), *packed)
    ones = [F.sum(F.shiftrightunsigned(f"__p{b % _LANES}", b - b % _LANES).bitwiseAND(F.lit(0xFFFF))).alias(f"__b{b}") for b in range(64)]
    votes = chunks.groupBy(*keys, "__k").agg(F.sum("__n").alias("__n"), *ones)
    bit = lambda b: F.when(F.col(f"__b{b}") * 2 > F.col("__n"), F.lit((1 << b) if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))
    parts = [bit(b) for b in range(64)]
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2], strict=True)]
    flat = votes.select(*keys, "__k", parts[0].alias("__fp"))
    return flat.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == i, F.col("__fp"))).alias(f"fp_{t}") for i, t in enumerate(texts)])


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of differing bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_masks(blocks: int = BLOCKS) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, list[int]]]:
    """For each choice of ``blocks - radius`` blocks: the mask of its bits, and masks of the earlier blocks left out."""
    masks, out = block_masks(blocks), []
    for chosen in combinations(range(blocks), blocks - radius):
        skipped = [masks[b] for b in range(max(chosen)) if b not in chosen]
        out.append((_signed(sum(masks[b] for b in chosen)), [_signed(m) for m in skipped]))
    return out


def near_fingerprints(queries: DataFrame, index: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (q, fp, n, distance) with q from ``queries`` (q), fp from ``index`` (fp, n), at most ``radius`` bits apart.

    Both sides must be distinct. A pair is kept in the first table in which it
    meets: there each earlier block that is left out differs.
    """
    tables = block_tables(radius, blocks)
    most = max(len(s) for _, s in tables)
    choice = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m"), *[F.lit(s[j] if j < len(s) else 0).cast("long").alias(f"s{j}") for j in range(most)]) for i, (m, s) in enumerate(tables)])
    q = queries.select("q", F.explode(choice).alias("c")).select("q", F.col("c.t").alias("tq"), F.col("q").bitwiseAND(F.col("c.m")).alias("kq"), *[F.col(f"c.s{j}") for j in range(most)])
    x = index.select("fp", "n", F.explode(choice).alias("c")).select("fp", "n", F.col("c.t").alias("tx"), F.col("fp").bitwiseAND(F.col("c.m")).alias("kx"))
    diff = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(True)
    for j in range(most):
        first = first & ((F.col(f"s{j}") == 0) | (diff.bitwiseAND(F.col(f"s{j}")) != 0))
    hit = (F.col("tq") == F.col("tx")) & (F.col("kq") == F.col("kx")) & (F.bit_count(diff) <= radius) & first
    # both sides grow with the corpus: neither is broadcast, however small it looks before the tables multiply it
    return q.join(x.hint("merge"), hit).select("q", "fp", "n", F.bit_count(diff).alias("distance"))


def id_ranges(ids: DataFrame, col: str, parts: int) -> tuple[list[int], int]:
    """Cut points (as a sorted list of at most ``MAX_RANGES``) that deal the ids out evenly."""
    if parts < 2:
        return [], 1
    cuts = ids.agg(F.percentile_approx(col, F.array(*[F.lit(i / parts) for i in range(1, parts)]), max(10_000, 4 * parts))).first()[0] or []
    return sorted(set(cuts)), len(set(cuts)) + 1


def range_number(col: Column, cuts: list[int]) -> Column:
    """Number of cut points below ``col``, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    tops = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    table = F.array(*[F.array(*[F.lit(c).cast("long") for c in g]) for g in groups])
    g = F.size(F.filter(tops, lambda c: c < col))
    return F.when(g == 0, F.lit(0)).otherwise((g - 1) * step + F.size(F.filter(F.element_at(table, F.greatest(g, F.lit(1))), lambda c: c < col))).cast("int")


def with_next(docs: DataFrame, *, id_col: str, text_col: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """Documents in descending order of id, each with the text that follows.

    Ids are cut into ranges of even size, so one hash exchange brings neighbours
    together. Returns the rows (part, rn, id, text, n: the next row's text or
    null at the end of a range) and, for each range p, the text that follows it
    (the first row of the next range; behind the last range the first of all).
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cuts, n = id_ranges(base.select("id"), "id", parts)
    # part 0 has the largest ids; null ids come last, in a part of their own
    part = F.when(F.col("id").isNull(), F.lit(n)).otherwise(F.lit(n - 1) - range_number(F.col("id"), cuts))
    base = base.withColumn("part", part.cast("int"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    tops = base.select("part", "id").groupBy("part").agg(F.max("id").alias("top"))
    heads = base.join(F.broadcast(tops.withColumnRenamed("part", "p")), (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("top"))).drop("p", "top")
    heads = heads.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy(*order))).where("k = 1")
    follow = W.orderBy("part")
    heads = heads.select("part", "text").withColumn("first", F.first(F.struct("text")).over(follow.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select(F.col("part").alias("p"), F.coalesce(F.lead(F.struct("text")).over(follow), F.col("first"))["text"].alias("follower"))
    own = W.partitionBy("part").orderBy(*order)
    rows = base.withColumn("rn", F.row_number().over(own)).withColumn("n", F.lead(F.struct("text")).over(own))
    return rows, heads


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, rn, id, n_chars, edited_sha256, fp_text, fp_edited) for each document and its edited text."""
    spark = docs.sparkSession
    rows = docs.count()
    parts = int(min(MAX_RANGES, max(2 * shuffle_partitions(spark), rows // RANGE_ROWS))) if rows > RANGE_ROWS else 1
    ordered, heads = with_next(docs, id_col=id_col, text_col=text_col, parts=parts)
    heads = materialize(heads, "simhash-heads")
    # at most MAX_RANGES rows: a hash join keeps the partitioning, the adaptive planner picks broadcast if they are small
    joined = ordered.join(heads.hint("shuffle_hash"), F.col("part") == F.col("p"), "left")
    following = F.coalesce(F.when(F.col("n").isNotNull(), F.coalesce(F.col("n")["text"], F.lit(""))), F.col("follower"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))
    prepared = joined.select("part", "rn", "id", n.cast("long").alias("n_chars"), text.alias("text"), edited.alias("edited"))
    prepared = prepared.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return fingerprints(prepared, ["part", "rn", "id", "n_chars", "edited_sha256"], ["text", "edited"])


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, and near_docs: for ids divisible by 50 the number of other documents within radius 3, else null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = materialize(fingerprint_edits(docs), "simhash")
    own = W.partitionBy("part").orderBy("rn")
    heads = prints.where("rn = 1").select("part", F.col("fp_text").alias("fp"))
    follow = W.orderBy("part")
    heads = heads.select(F.col("part").alias("p"), F.coalesce(F.lead("fp").over(follow), F.first("fp").over(follow.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("follower"))
    lined = prints.withColumn("n", F.lead("fp_text").over(own)).join(heads, F.col("part") == F.col("p"), "left")
    next_fp = F.coalesce("n", "follower")
    index = prints.groupBy(F.col("fp_text").alias("fp")).agg(F.count("*").alias("n"))
    asked = prints.where(F.col("id") % QUERY_STEP == 0)
    found = near_fingerprints(asked.select(F.col("fp_text").alias("q")).distinct(), index).groupBy("q").agg(F.sum("n").alias("near"))
    counts = asked.select(F.col("id").alias("asked_id"), F.col("fp_text").alias("q")).distinct().join(found, "q").select("asked_id", F.col("q").alias("asked_fp"), (F.col("near") - 1).alias("near_docs"))
    out = lined.join(counts, (F.col("id") == F.col("asked_id")) & (F.col("fp_text") == F.col("asked_fp")), "left")
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_hex(F.col("fp_text")).alias("fingerprint"), as_hex(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp_text"), next_fp).alias("near_next"), "near_docs",
    )
