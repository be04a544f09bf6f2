"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbago.llm import decontaminate, media, near_dup, pii, secrets, url_filter
from plumbago.llm.decontaminate import op2_benchmark_decontamination
from plumbago.llm.media import op6_media_columns
from plumbago.llm.mixture import op8_mixing_sources
from plumbago.llm.near_dup import op1_minhash_near_dedup
from plumbago.llm.pii import op9_pii
from plumbago.llm.quality import op7_quality_classifier
from plumbago.llm.secrets import op3_secret_scans
from plumbago.llm.token_count import op10_token_counts
from plumbago.llm.toxicity import op4_toxicity
from plumbago.llm.url_filter import op5_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_secret_scans": op3_secret_scans,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_media_columns": op6_media_columns,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": near_dup.SQL,
    "op2_benchmark_decontamination": decontaminate.SQL,
    "op3_secret_scans": secrets.SQL,
    "op5_url_filters": url_filter.SQL,
    "op6_media_columns": media.SQL,
    "op9_pii": pii.SQL,
}
