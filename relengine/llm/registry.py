"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relengine.llm import op2_mix as op2
from relengine.llm import op3_exact_dedup as op3
from relengine.llm import op10_warc as op10
from relengine.llm.op1_token_files import op1_token_files
from relengine.llm.op4_quality_classifier import op4_quality_classifier
from relengine.llm.op5_quality_rules import op5_quality_rules
from relengine.llm.op6_bpe import op6_bpe
from relengine.llm.op7_language_id import op7_language_id
from relengine.llm.op9_jaccard_join import op9_jaccard_join
from relengine.llm.op8_token_counts import op8_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_mix": op2.op2_mix,
    "op3_exact_dedup": op3.op3_exact_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe": op6_bpe,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_warc": op10.op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix": op2.ORACLE,
    "op3_exact_dedup": op3.ORACLE,
    "op10_warc": op10.ORACLE,
}
