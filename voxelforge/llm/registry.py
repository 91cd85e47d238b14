"""Queries of the training-data operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontaminate
from .language_id import op9_language_id
from .licenses import OP2_SQL, op2_licenses
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import OP10_SQL, op10_mixing
from .order_minhash import op7_near_dedup
from .repeats import OP8_SQL, op8_repeats
from .secrets import op6_secrets
from .simhash import op4_fingerprints
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licenses": op2_licenses,
    "op3_warc": op3_warc,
    "op4_fingerprints": op4_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op6_secrets": op6_secrets,
    "op7_near_dedup": op7_near_dedup,
    "op8_repeats": op8_repeats,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op2_licenses": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
    "op8_repeats": OP8_SQL,
    "op10_mixing": OP10_SQL,
}
