"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text stands for each
language. A text is parsed greedily into the longest phrases that occur in the
sample; phrases times log2(length of the longest sample) over text length estimates
the cross entropy, and the language with the least wins. Languages without a letter
in their sample are not learned.

The automata are laid out as dense transition tables in which a missing edge
starts the next phrase, so that many windows of text advance together, one byte
at a time, as NumPy gathers. Phrases do not cross the windows of ``WINDOW``
bytes that a text is cut into; all bytes of all texts are parsed.

Null and letterless texts give ``und`` with score 0. A null id is never held
out nor learned from. Without labelled rows everything is ``und``. Repeated
rows are predicted each for itself; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, bounded_batches, buffers, lowered, slices

WINDOW = 256
#: Classes of bytes: no letter of the samples, white space and the like, padding, and the border of samples.
OTHER, SPACE, PAD, BORDER = range(4)
#: Bits of a raw byte; a language that needs more explains nothing of a text.
RAW_BITS = 8.0
#: What a text may cost more than the labelled ones before it is foreign: addresses, keys and numbers in a short text add about as much.
MARGIN_BITS = 1.5
#: Texts shorter than this are too short to be called foreign to all languages.
MIN_REJECT_BYTES = 64


@dataclass
class LanguageModel:
    """Languages in order, sample lengths, byte classes and a transition table for each language."""

    langs: list[str]
    sizes: list[int]
    classes: np.ndarray
    n_classes: int
    tables: list[np.ndarray]


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``seq``; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _table(seq: list[int], n: int) -> np.ndarray:
    """Rows 0..n-1: a phrase has just begun with that class; row n: nothing read yet. Entries are row * n."""
    auto = suffix_automaton(seq)
    out = np.empty((n + 1 + len(auto), n), np.int64)
    out[:] = np.arange(n)
    out[:, PAD] = n
    for s, edges in enumerate(auto):
        for c, to in edges.items():
            out[n + 1 + s, c] = n + 1 + to
    out[n + 1] = np.where(np.arange(n) == PAD, n, np.arange(n))
    for c, to in auto[0].items():
        out[c] = out[n + 1 + to]
    return (out * n).astype(np.int32).ravel()


def _normalised(arr: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes of the lower-cased texts, runs of blanks and symbols as one blank."""
    data, off = buffers(lowered(arr))
    cls = classes[data]
    keep = cls != SPACE
    keep[1:] |= cls[:-1] != SPACE
    firsts = off[:-1][off[:-1] < len(data)]
    keep[firsts] = True
    ends = np.concatenate([[0], np.cumsum(keep)])
    return cls[keep], ends[off]


def fit_language_model(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_bytes: int = 20_000, docs_per_lang: int = 48) -> LanguageModel:
    """Learn from at most ``docs_per_lang`` texts and ``sample_bytes`` bytes a language (the documented bound).

    The texts are those whose key hashes lowest; equal rows count once. Of each
    at most a sixteenth of the characters goes in, a piece from a place that its
    hash draws from the whole text. Only counts by language and the sample reach
    the driver.
    """
    rows = labelled.select(F.col(key_col).alias("__k"), F.col(lang_col).alias("__l"), F.col(text_col).alias("__t")).where("__l is not null and __k is not null")
    rate = 2.0**31
    h = F.pmod(F.xxhash64(F.col("__k")), F.lit(1 << 31)).cast("double")
    counts = {r["__l"]: r["n"] for r in rows.groupBy("__l").agg(F.count("*").alias("n")).collect()}
    texts: dict[str, list[tuple[float, str]]] = {k: [] for k in counts}
    if counts:
        limits = [(k, rate * min(1.0, docs_per_lang / n)) for k, n in counts.items()]
        spark = labelled.sparkSession
        bound = F.broadcast(spark.createDataFrame(limits, "__l2 string, __m double"))  # a row for each language
        sample = rows.where("__t is not null").withColumn("__h", h).join(bound, F.col("__l") == F.col("__l2")).where("__h < __m")
        per = sample_bytes // 16
        length = F.length("__t")
        start = F.pmod(F.xxhash64("__k", "__t"), F.greatest(length - per + 1, F.lit(1)).cast("long")) + 1
        for r in sample.select("__l", "__h", F.substring("__t", start.cast("int"), F.lit(per)).alias("__t")).distinct().collect():
            texts[r["__l"]].append((r["__h"], r["__t"]))
    langs = sorted(k for k, rows in texts.items() if any(c.isalpha() for _, t in rows for c in t))
    ascii_space = np.full(256, SPACE, np.uint8)
    ascii_space[128:] = OTHER
    letters = [*range(ord("a"), ord("z") + 1)]
    seen: set[int] = set()
    raw = {}
    for lang in langs:
        parts = [t for _, t in sorted(texts[lang])[:docs_per_lang]]
        raw[lang] = parts
        for t in parts:
            seen |= {b for b in t.lower().encode() if b >= 128}
    classes = ascii_space
    for i, b in enumerate([*letters, *sorted(seen)]):
        classes[b] = BORDER + 1 + i
    n = BORDER + 1 + len(letters) + len(seen)
    sizes, tables = [], []
    for lang in langs:
        seq: list[int] = []
        if raw[lang]:
            cls, off = _normalised(pa.array(raw[lang], pa.string()), classes)
            for i in range(len(raw[lang])):
                if len(seq) < sample_bytes:
                    seq += [*cls[off[i] : off[i + 1]].tolist(), BORDER]
        sizes.append(max(2, len(seq)))
        tables.append(_table(seq, n))
    # a phrase costs the same in all languages: a small sample must not make it cheap
    return LanguageModel(langs, [max(sizes)] * len(sizes) if sizes else [], classes, n, tables)


def phrase_counts(arr: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by language and text, and the number of bytes parsed of each text."""
    cls, off = _normalised(arr, model.classes)
    n, docs = model.n_classes, len(arr)
    size = np.diff(off)
    rows = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(rows)])
    lanes = int(first[-1])
    counts = np.zeros((len(model.langs), docs), np.int64)
    if not lanes:
        return counts, size
    flat = np.full(lanes * WINDOW, PAD, np.uint8)
    flat[np.arange(len(cls)) + np.repeat(first[:-1] * WINDOW - off[:-1], size)] = cls
    steps = np.ascontiguousarray(flat.reshape(lanes, WINDOW).T)
    idx = np.empty(lanes, np.int64)
    owner = np.repeat(np.arange(docs), rows)
    states = [np.full(lanes, n * n, np.int32) for _ in model.langs]
    begun = [np.zeros(lanes, np.int32) for _ in model.langs]
    for j in range(WINDOW):
        col = steps[j].astype(np.int64)
        for k, table in enumerate(model.tables):
            np.add(states[k], col, out=idx)
            np.take(table, idx, out=states[k], mode="clip")
            begun[k] += states[k] < n * n
    for k in range(len(model.langs)):
        counts[k] = np.bincount(owner, begun[k], docs).astype(np.int64)
    return counts, size


def predict(arr: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score in 0..1 and cross entropy in bits a byte of each text."""
    docs = len(arr)
    has_letter = np.asarray(pc.fill_null(pc.match_substring_regex(pc.fill_null(arr, ""), r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
    if not model.langs or not docs:
        return ["und"] * docs, np.zeros(docs), np.full(docs, np.inf)
    counts, size = phrase_counts(arr, model)
    bits = counts * np.log2(np.array(model.sizes, float))[:, None]
    best = np.argmin(bits, 0)
    low = bits[best, np.arange(docs)]
    score = 1 / np.exp2(np.clip(low - bits, -512, 0) / 16).sum(0)
    langs = [model.langs[b] if ok else "und" for b, ok in zip(best, has_letter, strict=True)]
    return langs, np.where(has_letter, score, 0.0), np.where(size > 0, low / np.maximum(size, 1), np.inf)


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default but for those of the result's names; none of them read) plus lang_pred, score and bits_per_byte, one row in, one out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")] if keep is None else keep
    inner = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("__t"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]), "`__lang` string", "`__score` double", "`__bits` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__t"):
                langs, score, bits = predict(part.column("__t"), shared.value)
                cols = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], names=[*part.schema.names[:-1], "__lang", "__score", "__bits"])

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)], F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__bits").alias("bits_per_byte"))


def rejection_bound(told: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> float:
    """Bits a byte above which a text is foreign to all languages: ``MARGIN_BITS`` more than all but one in 10,000 of the labelled texts cost that were identified rightly, ``RAW_BITS`` at most and without any.

    All identified rows (``identify``) with a label count, but for those too short to be rejected.
    """
    right = told.where((F.col("lang_pred") == F.col(lang_col)) & _long_enough(text_col))
    usual = right.agg(F.percentile_approx("bits_per_byte", F.lit(0.9999), F.lit(100_000))).first()[0]
    return RAW_BITS if usual is None else min(RAW_BITS, usual + MARGIN_BITS)


def _long_enough(text_col: str):
    return F.octet_length(F.btrim(F.col(text_col), F.lit(SPACES))) >= MIN_REJECT_BYTES


def is_rejected(text_col: str = "text", bound: float = RAW_BITS):
    """A document is rejected if it has no letter or if, at some length, every language costs more than ``bound`` bits a byte."""
    return (F.col("lang_pred") == "und") | ((F.col("bits_per_byte") > bound) & _long_enough(text_col))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(~held_out("doc_id")))
    out = identify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
