"""All queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import problems, q_aggregates, q_beliefs, q_graph, q_lifecycle, q_more, q_scalars, q_scans

MODULES = [problems, q_scans, q_scalars, q_aggregates, q_graph, q_lifecycle, q_more, q_beliefs]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return problems.p5_report(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
