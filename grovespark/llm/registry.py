"""The production queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovespark.llm.decontam import OP3_SQL, op3_benchmark_decontamination
from grovespark.llm.langid import op6_language_id
from grovespark.llm.linededup import OP8_SQL, op8_line_dedup
from grovespark.llm.packing import op4_harmonic_packing
from grovespark.llm.pii import op7_pii_surrogates
from grovespark.llm.shards import op1_training_order
from grovespark.llm.simhash import op5_simhash_near_dedup
from grovespark.llm.spotsigs import op2_spotsigs
from grovespark.llm.toxicity import op9_toxicity
from grovespark.llm.urlcascade import OP10_SQL, op10_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_training_order,
        op2_spotsigs,
        op3_benchmark_decontamination,
        op4_harmonic_packing,
        op5_simhash_near_dedup,
        op6_language_id,
        op7_pii_surrogates,
        op8_line_dedup,
        op9_toxicity,
        op10_url_filter,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": OP3_SQL,
        "op8_line_dedup": OP8_SQL,
        "op10_url_filter": OP10_SQL,
    }
