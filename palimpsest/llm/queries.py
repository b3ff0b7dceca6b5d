"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.chat import op6_chat_formatting
from palimpsest.llm.decontaminate import op5_decontamination
from palimpsest.llm.line_dedup import op10_line_dedup
from palimpsest.llm.passages import op4_substring_dedup
from palimpsest.llm.pieces import op9_sentencepiece
from palimpsest.llm.ppm import op1_lm_scoring
from palimpsest.llm.quality import op2_quality_rules
from palimpsest.llm.sharding import op8_sharding
from palimpsest.llm.simhash import op3_simhash_near_dedup
from palimpsest.llm.url_filter import OP7_SQL, op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL: dict[str, str] = {"op7_url_filter": OP7_SQL}
