"""Time travel over versions: transaction time ``tx`` and validity [valid_from, valid_until)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import micros, numbered, previous


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key, by aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(key, "v.*")


def as_of(versions: DataFrame, tx: Column) -> DataFrame:
    """Last version of each uri written by ``tx``."""
    return latest(versions.filter(F.col("tx") <= tx), "uri", "tx", "version")


def bitemporal_as_of(versions: DataFrame, tx: Column, valid: Column) -> DataFrame:
    """Last version known by ``tx`` that is valid at ``valid``."""
    v = versions.filter((F.col("tx") <= tx) & (F.col("valid_from") <= valid) & F.coalesce(F.col("valid_until") > valid, F.lit(True)))
    return latest(v, "uri", "tx", "version")


def between(versions: DataFrame, start: Column, end: Column) -> DataFrame:
    return versions.filter(F.col("tx").between(start, end))


def bitemporal_between(versions: DataFrame, start: Column, end: Column, valid_start: Column, valid_end: Column) -> DataFrame:
    return between(versions, start, end).filter((F.col("valid_from") <= valid_end) & F.coalesce(F.col("valid_until") >= valid_start, F.lit(True)))


def consecutive(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Versions numbered anew from 1 per key; the last one is current."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).withColumn("current", F.lead(key).over(w).isNull())


def rollback(versions: DataFrame, to: int) -> DataFrame:
    """New rows that put version ``to`` of every uri that has it on top as version max+1."""
    top = versions.groupBy("uri").agg(F.max("version").alias("m"))
    return versions.filter(F.col("version") == to).join(top, "uri").withColumn("version", F.col("m") + 1).drop("m")


def version_diff(versions: DataFrame, a: int, b: int) -> DataFrame:
    """Text and type of two versions of each uri side by side, where they differ."""
    x = versions.filter(F.col("version") == a).select("uri", F.col("l0").alias("l0_a"), F.col("content_type").alias("type_a"))
    y = versions.filter(F.col("version") == b).select("uri", F.col("l0").alias("l0_b"), F.col("content_type").alias("type_b"))
    return x.join(y, "uri").filter(~F.col("l0_a").eqNullSafe(F.col("l0_b")) | ~F.col("type_a").eqNullSafe(F.col("type_b")))


def prune(checkpoints: DataFrame, protected: DataFrame, hot: int, cold: int, every: int) -> DataFrame:
    """Checkpoints to drop per scope: beyond the ``hot`` newest, unless protected or among the ``cold`` newest of each ``every``-th one."""
    ranked = numbered(checkpoints, ["scope"], -micros(F.col("committed_at")), [F.desc("id")], "rn").filter(F.col("rn") > hot)
    kept = ranked.withColumn("cold", F.floor((F.col("rn") - hot - 1) / every)).withColumn("first", (F.col("rn") - hot - 1) % every == 0)
    return kept.filter(~(F.col("first") & (F.col("cold") < cold))).join(protected, "id", "left_anti").select("id", "scope", "rn")


def gaps(df: DataFrame, key: str, at: str) -> DataFrame:
    """Mean gap in seconds between consecutive rows of a key."""
    w = W.partitionBy(key).orderBy(at)
    g = df.withColumn("gap", F.timestamp_diff("MICROSECOND", F.lag(at).over(w), F.col(at)) / 1e6)
    return g.groupBy(key).agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"))


def lagged_effect(changes: DataFrame, group: str, order: str, cause: Column, effect: Column) -> DataFrame:
    """Risk of the effect right after the cause, and without it, per group, and the weighted difference over groups."""
    t = previous(changes.withColumn("e", effect.cast("int")), [group], F.col(order), [], cause.cast("int"), "c").filter("c is not null")
    g = t.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.when(F.col("c") == 1, F.col("e"))).alias("p1"), F.avg(F.when(F.col("c") == 0, F.col("e"))).alias("p0")).filter("p1 is not null and p0 is not null")
    return g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * (F.col("p1") - F.col("p0"))) / F.sum("n")).alias("risk_difference"))
