"""Queries of this package, for the repository's entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op6_latent_decontamination
from .media import op9_matroska_media
from .packing import op2_bm25_packing
from .pii import op10_boosted_pii
from .quality import op4_ordinal_quality
from .secrets import op1_forest_secrets
from .sharding import op3_lpt_sharding
from .simhash import op7_simhash_pigeonring
from .substring import op8_paragraph_minhash
from .token_counts import op5_resync_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_forest_secrets,
        op2_bm25_packing,
        op3_lpt_sharding,
        op4_ordinal_quality,
        op5_resync_token_counts,
        op6_latent_decontamination,
        op7_simhash_pigeonring,
        op8_paragraph_minhash,
        op9_matroska_media,
        op10_boosted_pii,
    )
}

#: None of these queries has an SQL equivalent that DuckDB runs; tests/llm holds brute-force versions.
ORACLE_SQL: dict[str, str] = {}
