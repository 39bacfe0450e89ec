"""The operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3
from .decontaminate import op5
from .language_id import op9
from .line_dedup import OP8_SQL, op8
from .ppm import op7
from .quality_rules import op4
from .simhash_dedup import op10
from .token_counts import op2
from .toxicity import op1
from .warc import OP6_SQL, op6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1,
    "op2_token_counts": op2,
    "op3_bpe": op3,
    "op4_quality_rules": op4,
    "op5_decontaminate": op5,
    "op6_warc": op6,
    "op7_ppm": op7,
    "op8_line_dedup": op8,
    "op9_language_id": op9,
    "op10_simhash_dedup": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
}
