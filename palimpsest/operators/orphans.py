"""References to records that do not exist, or that came in after the reference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


@dataclass(frozen=True)
class Reference:
    """One kind of link: rows of ``links`` refer by ``key`` to ``target_key`` of ``targets``."""

    name: str
    links: DataFrame
    row_key: Column
    key: Column
    seen_at: Column
    targets: DataFrame
    target_key: Column
    target_seen_at: Column


def _links(refs: Sequence[Reference]) -> DataFrame:
    parts = [
        r.links.select(F.lit(r.name).alias("ref_table"), r.row_key.cast("string").alias("row_key"), r.key.cast("string").alias("key"), r.seen_at.alias("seen_at")).filter(F.col("key").isNotNull())
        for r in refs
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("ref_table", "row_key", "key").agg(F.min("seen_at").alias("seen_at"))


def orphan_links(refs: Sequence[Reference]) -> DataFrame:
    """Every distinct link whose target is absent or late.

    Links and target keys are put in one long table, each row tagged as link or
    target; grouping by (table, key) sums up per key whether a target exists and
    when it first came in. Groups that hold a target no later than their first
    link are clean and fall away there. The rest meet their links again: a key
    with over a thousandth of all links (so at most a thousand keys) is spread
    over parts of that size first, so that no task gets all links of one key.

    Result: ref_table, row_key, missing_key, seen_at, status (``absent`` or
    ``late``). A null key is no link; a null row key is kept as a value of its
    own; repeated links count once, at their earliest time; a link or target
    without time is neither late nor does it make others late. Empty inputs give
    no rows.
    """
    links = _links(refs)
    tagged = links.select("ref_table", "key", F.lit(1).cast("bigint").alias("n_links"), F.col("seen_at").alias("first_link"), F.lit(False).alias("is_target"), F.lit(None).cast("timestamp_ntz").alias("first_target"))
    for r in refs:
        tagged = tagged.unionByName(
            r.targets.select(F.lit(r.name).alias("ref_table"), r.target_key.cast("string").alias("key"), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("timestamp_ntz").alias("first_link"), F.lit(True).alias("is_target"), r.target_seen_at.alias("first_target")).filter(
                F.col("key").isNotNull()
            )
        )
    per_key = (
        tagged.groupBy("ref_table", "key")
        .agg(F.sum("n_links").alias("n_links"), F.min("first_link").alias("first_link"), F.max("is_target").alias("has_target"), F.min("first_target").alias("first_target"))
        .filter((F.col("n_links") > 0) & (~F.col("has_target") | (F.col("first_target") > F.col("first_link"))))
    )
    most = max(10_000, links.count() // HOT_SHARE)
    hot = per_key.filter(F.col("n_links") > most).select("ref_table", "key", F.ceil(F.col("n_links") / most).cast("int").alias("parts"))
    suspects = (
        per_key.join(F.broadcast(hot), ["ref_table", "key"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        .select("ref_table", "key", "salt", "has_target", "first_target")
    )
    salted = links.join(F.broadcast(hot), ["ref_table", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("row_key"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return (
        salted.join(suspects, ["ref_table", "key", "salt"])
        .filter(~F.col("has_target") | (F.col("first_target") > F.col("seen_at")))
        .select("ref_table", "row_key", F.col("key").alias("missing_key"), "seen_at", F.when(F.col("has_target"), "late").otherwise("absent").alias("status"))
    )


def orphan_report(refs: Sequence[Reference]) -> DataFrame:
    """Orphans per table, month and status: links and distinct missing keys."""
    return orphan_links(refs).groupBy("ref_table", F.date_format("seen_at", "yyyy-MM").alias("period"), "status").agg(F.count("*").alias("n_links"), F.countDistinct("missing_key").alias("n_keys"))
