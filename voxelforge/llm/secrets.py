"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns at the hits, checksum validation.

One automaton finds every keyword in the ASCII-lower-cased text. A kind's
pattern is then matched anchored at the hits of its keywords only, from left to
right, behind the end of that kind's last match. Bare hexadecimal runs have no
keyword: a vectorised probe of every 24th byte tells whether a text can hold
such a run at all before the pattern is run. Tokens that carry a checksum of
their own (six base-62 digits of the CRC-32 of the part before) are kept only if
it is right.

Null and empty texts have no spans. Ids may be null or repeated: each row is
scanned for itself. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, buffers, slices

# The kinds that the contract lists, and tokens with a checksum (prefix, length of the random part).
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
CHECKED = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
RANDOM_PART, CHECK_DIGITS = 30, 6
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = (*BASE_KINDS, *CHECKED)
_RANK = {k: i for i, k in enumerate(KINDS)}
_TOKEN = re.compile(rf"[A-Za-z0-9]{{{RANDOM_PART + CHECK_DIGITS}}}(?![A-Za-z0-9])")
_hex_byte = np.zeros(256, bool)
_hex_byte[list(b"0123456789abcdef")] = True


def checksum(random_part: str) -> str:
    """CRC-32 in base 62, six digits with leading zeros."""
    n, out = zlib.crc32(random_part.encode()), ""
    for _ in range(CHECK_DIGITS):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def keyword_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        auto.add_word(word, ("assign", len(word)))
    auto.add_word("akia", ("access", 4))
    for kind, prefixes in CHECKED.items():
        for p in prefixes:
            auto.add_word(p, (kind, len(p)))
    auto.make_automaton()
    return auto


def may_have_hex(raw: np.ndarray) -> bool:
    """False only if no run of 24 hexadecimal digits can be there: such a run covers a probed byte and the 11 on one side of it."""
    probes = np.flatnonzero(_hex_byte[raw[MIN_HEX - 1 :: MIN_HEX]]) * MIN_HEX + MIN_HEX - 1
    half = MIN_HEX // 2 - 1
    left, right = probes, probes
    for d in range(1, half + 1):
        left = left[_hex_byte[raw[np.maximum(left - d, 0)]]]
        right = right[_hex_byte[raw[np.minimum(right + d, len(raw) - 1)]]]
        if not len(left) and not len(right):
            return False
    return True


def scan_text(text: str, auto: ahocorasick.Automaton, hex_possible: bool = True) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of ``text`` by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    until = dict.fromkeys(KINDS, 0)
    lower = text.lower() if text.isascii() else text.encode().lower().decode()
    for last, (kind, n) in auto.iter(lower):
        at = last - n + 1
        if at < until[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                until[kind] = m.end()
                if len(m[2]) >= MIN_VALUE:
                    found.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                until[kind] = m.end()
                if m.end() - at >= MIN_ACCESS:
                    found.append((at, m.end(), kind))
        elif text.startswith(lower[at : last + 1], at) and (m := _TOKEN.match(text, last + 1)):
            until[kind] = m.end()
            if checksum(m[0][:RANDOM_PART]) == m[0][RANDOM_PART:]:
                found.append((at, m.end(), kind))
    if hex_possible:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], _RANK[s[2]]))
    return found


SCHEMA = "__id {id}, starts array<long>, ends array<long>, kinds array<string>"


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id and the spans as array<struct<start, end, kind>>; no shuffle."""
    bounded_batches(docs.sparkSession)
    inner = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    id_type = inner.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = keyword_automaton()
        for batch in batches:
            for part in slices(batch, "__t"):
                data, off = buffers(part.column("__t"))
                spans = [
                    scan_text(t, auto, may_have_hex(data[off[i] : off[i + 1]])) if t else []
                    for i, t in enumerate(part.column("__t").to_pylist())
                ]
                cols = [pa.array([[s[k] for s in row] for row in spans], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("__id"), *cols], names=["__id", "starts", "ends", "kinds"])

    out = inner.mapInArrow(run, SCHEMA.format(id=id_type))
    spans = F.transform(F.arrays_zip("starts", "ends", "kinds"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end"), s["kinds"].alias("kind")))
    return out.select(F.col("__id").alias(id_col), spans.alias("spans"))


def spans_text(spans, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` joined by commas, of the given kinds or of all."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(F.col("spans"), BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(*BASE_KINDS))).cast("long").alias("n_checked"),
    )
