"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bm25 import ORACLE_SQL as BM25_SQL
from .bm25 import op9_bm25_search
from .decontaminate import op3_decontaminate
from .near_dedup import op7_near_dedup
from .quality import op1_quality_classifier
from .secret_scan import op10_secret_scan
from .source_mix import ORACLE_SQL as MIX_SQL
from .source_mix import op5_source_mix
from .suffix_dedup import op8_suffix_dedup
from .token_count import op2_token_counts
from .toxicity import op4_toxicity
from .url_filter import op6_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_token_counts, op3_decontaminate, op4_toxicity, op5_source_mix, op6_url_filter, op7_near_dedup, op8_suffix_dedup, op9_bm25_search, op10_secret_scan)}
ORACLE: dict[str, str] = {"op5_source_mix": MIX_SQL, "op9_bm25_search": BM25_SQL}
