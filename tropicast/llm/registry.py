"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (exact_dedup, filter_audit, graph_search, html_text, language, mixing, packing, quality, scoring, secrets, simhash,
               syncmers, whitening)
from .common import table


def _over(name: str, operator: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in (name, *more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_scoring": _over("documents", scoring.op1_scoring),
        "op2_ann": _over("embeddings", graph_search.op2_ann),
        "op3_packing": _over("documents", packing.op3_packing),
        "op4_simhash": _over("documents", simhash.op4_simhash),
        "op5_fingerprints": _over("documents", syncmers.op5_fingerprints),
        "op6_mixing": _over("documents", mixing.op6_mixing),
        "op7_quality": _over("documents", quality.op7_quality, "labels"),
        "op8_html": _over("pages", html_text.op8_html),
        "op9_secrets": _over("documents", secrets.op9_secrets),
        "op10_language": _over("documents", language.op10_language),
        "op11_whitening": _over("embeddings", whitening.op11_whitening),
        "op12_exact_dedup": _over("documents", exact_dedup.op12_exact_dedup),
        "op13_filter_audit": _over("documents", filter_audit.op13_filter_audit, "labels"),
    }


def oracles() -> dict[str, str]:
    return {"op9_secrets": secrets.ORACLE, "op12_exact_dedup": exact_dedup.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
