"""Predicates over entries. A list of conditions means all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uri as U


def type_equals(content_type: str) -> Column:
    return F.coalesce(F.col("content_type") == content_type, F.lit(False))


def in_tenant(tenant: str) -> Column:
    return U.tenant(F.col("uri")) == tenant


def in_agent(agent: str) -> Column:
    return U.in_agent(F.col("uri"), agent)


def written_between(start: Column, end: Column) -> Column:
    return F.coalesce("updated_at", "created_at").between(start, end)


def valid_at(at: Column) -> Column:
    """Half-open validity and not invalidated; missing validity is always valid."""
    return F.col("invalidated_by").isNull() & F.coalesce(F.col("valid_from") <= at, F.lit(True)) & F.coalesce(F.col("valid_until") > at, F.lit(True))


def valid_overlaps(start: Column, end: Column) -> Column:
    return F.coalesce(F.col("valid_from") <= end, F.lit(True)) & F.coalesce(F.col("valid_until") >= start, F.lit(True))


def timeline_valid(at: Column) -> Column:
    """The variant that ignores invalidation and includes both ends."""
    return F.coalesce(F.col("valid_from") <= at, F.lit(True)) & F.coalesce(F.col("valid_until") >= at, F.lit(True))


def known_and_valid(valid: Column, known: Column) -> Column:
    return valid_at(valid) & (F.coalesce("updated_at", "created_at") <= known)


def has_tags(*tags: str) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col("tags"))) == 0, F.lit(False))


def quality_above(least: float) -> Column:
    return F.coalesce(F.col("quality") >= least, F.lit(False))


def where(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def allowed(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows that the first matching rule allows.

    Rules (prefix, effect, priority): the highest priority wins, then the longest prefix, then deny over allow; without a
    match access is denied. Any number of rules: every address is looked up by its own prefixes, so the join is by equality.
    """
    segments = F.split("uri", "/")
    asked = df.select("uri").distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))))
    verdict = asked.join(rules.select("prefix", "effect", "priority"), "prefix").groupBy("uri").agg(F.max_by("effect", F.struct("priority", F.length("prefix"), F.col("effect") != "allow")).alias("effect"))
    return df.join(verdict.filter("effect = 'allow'").select("uri"), "uri", "left_semi")
