"""Numbers, sums and neighbours in the order of a group, where one group may hold most of the rows.

A group of over ``most`` rows is cut into parts at quantiles of its first order key. Each part is a task of its own; what
lies before a part is one row a part. Rows that share the first key lie in one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST = 1_000_000
PARTS = 256


def _cut(df: DataFrame, group: list[str], at: Column, most: int) -> DataFrame:
    """``df`` with ``_at`` and ``_part``; a null ``at`` comes first."""
    x = df.withColumn("_at", at.cast("double"))
    sizes = x.groupBy(*group).agg(F.count("*").alias("_n"), F.percentile_approx("_at", [i / PARTS for i in range(1, PARTS)], 10_000).alias("_cuts")).filter(F.col("_n") > most)
    large = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_cuts")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_at"))), F.lit(0))
    return x.join(large, same, "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).select(*df.columns, "_at", "_part")


def _with_base(df: DataFrame, base: DataFrame, group: list[str]) -> DataFrame:
    b = base.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_base")
    return df.join(b, [*[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p")], "left").drop(*[f"_g{i}" for i in range(len(group))], "_p")


def running(df: DataFrame, group: list[str], at: Column, order: list[Column], value: Column, name: str, most: int = MOST) -> DataFrame:
    """``df`` with the sum of ``value`` over a group's rows up to this one, by ``at`` (a number, ascending), then ``order``."""
    x = _cut(df.withColumn("_v", value), group, at, most)
    sums = x.groupBy(*group, "_part").agg(F.sum("_v").alias("_s"))
    base = sums.withColumn("_base", F.sum("_s").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    inside = x.withColumn("_in", F.sum("_v").over(W.partitionBy(*group, "_part").orderBy("_at", *order).rowsBetween(W.unboundedPreceding, 0)))
    out = _with_base(inside, base, group)
    return out.withColumn(name, F.coalesce("_in", F.lit(0)) + F.coalesce("_base", F.lit(0))).select(*df.columns, name)


def numbered(df: DataFrame, group: list[str], at: Column, order: list[Column], name: str, most: int = MOST) -> DataFrame:
    """``df`` with the place of each row in its group, from 1."""
    x = _cut(df, group, at, most)
    sizes = x.groupBy(*group, "_part").agg(F.count("*").alias("_s"))
    base = sizes.withColumn("_base", F.sum("_s").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    inside = x.withColumn("_in", F.row_number().over(W.partitionBy(*group, "_part").orderBy("_at", *order)))
    return _with_base(inside, base, group).withColumn(name, (F.col("_in") + F.coalesce("_base", F.lit(0))).cast("int")).select(*df.columns, name)


def previous(df: DataFrame, group: list[str], at: Column, order: list[Column], value: Column, name: str, most: int = MOST) -> DataFrame:
    """``df`` with the ``value`` of the row before in the group, null for the first. ``order``: ascending."""
    x = _cut(df.withColumn("_v", F.struct(value.alias("v"))), group, at, most)
    w = W.partitionBy(*group, "_part").orderBy("_at", *order)
    inside = x.withColumn("_in", F.lag("_v").over(w)).withColumn("_last", F.lead("_v").over(w).isNull())
    # the last row of a part, by the same order
    lasts = inside.filter("_last").select(*group, "_part", "_v")
    base = lasts.withColumn("_base", F.lag("_v").over(W.partitionBy(*group).orderBy("_part")))
    return _with_base(inside, base, group).withColumn(name, F.coalesce("_in", "_base")["v"]).select(*df.columns, name)


def micros(at: Column) -> Column:
    """A time as a number that a double holds to a fraction of a millisecond."""
    return F.unix_micros(at.cast("timestamp"))
