"""Rules on what becomes of entries: writes, decay, review, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import keep


def lifecycle_action(composite: Column, recency: Column, frequency: Column, tenant_weight: Column, tags: Column) -> Column:
    """The matching rule of highest priority: freeze 100, consolidate 50, archive 30, delete 20, else keep."""
    pinned = F.coalesce(F.array_contains(tags, "pinned"), F.lit(False))
    return F.when((tenant_weight > 0.9) | pinned, "Freeze").when(composite < 0.2, "Consolidate").when((recency < 0.1) & (frequency < 0.1), "Archive").when(composite < 0.05, "Delete").otherwise("Keep")


def review_task(scope: Column, days: Column, half_life: Column, quality: Column) -> Column:
    """What is due for a middle- or long-term entry, else null."""
    due = days / half_life
    task = F.when((due >= 1.75) & (quality < 0.30), "Forget").when((due >= 1.05) | (quality < 0.45), "Revalidate").otherwise("Rehearse")
    return F.when(scope.isin("Mid", "Long") & ~((due < 0.82) & (quality >= 0.35)), task)


def write_resolution(exists: Column, same_text: Column, new_quality: Column, old_quality: Column) -> Column:
    return F.when(~exists, "Add").when(same_text, "Noop").when(new_quality > old_quality + 0.1, "Update").otherwise("Invalidate")


def changed_rows(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows as the next version of each key: one higher than the current one, from 1 for new keys."""
    v = current.select(key, F.col("mvcc_version").alias("old"))
    return incoming.join(v, key, "left").withColumn("mvcc_version", F.coalesce(F.col("old") + 1, F.lit(1))).drop("old")


def write_duplicates(df: DataFrame, group: list[str], least: float = 0.86, least_tokens: int = 5) -> DataFrame:
    """Pairs of entries of one group whose token sets have a Jaccard similarity of ``least`` or more.

    Pairs are found through shared words among the rarest ``n - ceil(least n) + 1`` of each, so common words bring
    nobody together that a rare one does not; no similar pair is lost. A null in the group is a value of its own.
    """
    t = keep(df.select("uri", F.to_json(F.struct(*group)).alias("g"), T.terms(F.col("l0"), 2).alias("t")).filter(F.size("t") >= least_tokens), "texts")
    often = t.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    ranked = t.select("uri", "g", F.explode("t").alias("w")).join(often, "w").groupBy("uri", "g").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("r"))
    n = F.size("r")
    rare = F.slice("r", F.lit(1), (n - F.ceil(least * n - 1e-9) + 1).cast("int"))
    # a word that only one text has brings nobody together
    p = ranked.select("uri", "g", n.alias("n"), F.explode(F.filter(rare, lambda e: e["c"] > 1)).alias("e")).select("uri", "g", "n", "e.w")
    a, b = p.select("g", "w", F.col("uri").alias("a"), F.col("n").alias("na")), p.select("g", "w", F.col("uri").alias("b"), F.col("n").alias("nb"))
    c = a.join(b, ["g", "w"]).filter((F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)).select("a", "b").distinct()
    s = t.select("uri", "t")
    j = c.join(s.withColumnRenamed("uri", "a").withColumnRenamed("t", "ta"), "a").join(s.withColumnRenamed("uri", "b").withColumnRenamed("t", "tb"), "b")
    return j.withColumn("similarity", T.jaccard(F.col("ta"), F.col("tb"))).filter(F.col("similarity") >= least).select("a", "b", "similarity")


def outbox_backoff(attempts: Column) -> Column:
    return F.least(F.lit(3600.0), F.pow(F.lit(2.0), attempts))


def outbox_status(ok: Column, attempts: Column, most: int = 8) -> Column:
    return F.when(ok, "done").when(attempts >= most, "dead").otherwise("failed")


def health_issues(df: DataFrame, deps: Column, days: Column) -> DataFrame:
    """One row per entry and issue, with a priority."""
    q = F.coalesce("quality", F.lit(0.5))
    kinds = F.array(
        F.when((deps >= 2) & (q <= 0.55), F.struct(F.lit("DangerousDependency").alias("issue"), (1 - q).alias("priority"))),
        F.when((F.col("content_type") == "fact") & (q < 0.72), F.struct(F.lit("MissingEvidence").alias("issue"), (0.72 - q).alias("priority"))),
        F.when((days > 30) & (q < 0.45) & (deps == 0), F.struct(F.lit("Stale").alias("issue"), F.least(F.lit(1.0), days / 365).alias("priority"))),
    )
    return df.select("uri", F.explode(F.array_compact(kinds)).alias("i")).select("uri", "i.issue", "i.priority")


def beta_update(mean: Column, mass: Column, signal: Column, weight: Column, cap: float = 0.15) -> Column:
    """Posterior mean of a Beta belief, moved by at most ``cap``."""
    new = (mean * mass + signal * weight) / (mass + weight)
    return mean + F.least(F.lit(cap), F.greatest(F.lit(-cap), new - mean))
