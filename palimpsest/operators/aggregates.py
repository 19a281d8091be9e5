"""Scores, tallies and distribution measures over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import previous


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def tally(latest: DataFrame) -> DataFrame:
    """Votes per entry from the latest vote of each voter: up, down, flags, net, consensus 2|p-1/2|."""
    of = lambda op: F.count(F.when(F.col("op") == op, 1))
    t = latest.groupBy("entry_id").agg(of("Upvote").alias("up"), of("Downvote").alias("down"), of("FlagOutdated").alias("flags"))
    n = F.col("up") + F.col("down")
    return t.withColumn("net", F.col("up") - F.col("down")).withColumn("consensus", F.when(n > 0, F.abs(F.col("up") / n - 0.5) * 2).otherwise(0.0))


def quality_four(df: DataFrame, at: Column, access: Column) -> DataFrame:
    """Completeness, freshness, consistency and utility, and their weighted mean."""
    days = F.floor(F.timestamp_diff("SECOND", F.col("updated_at"), at) / 3600) / 24
    n = F.octet_length("l0")
    c = F.when(F.coalesce(F.length("l1"), F.lit(0)) > 0, 0.9).otherwise(0.4)
    f = clamp(F.exp(-days / 30), 0.05, 1.0)
    k = F.when((n > 20) & (n < 2000), 0.85).otherwise(0.5)
    u = clamp(F.log(access + 1) / 5, 0.1, 1.0)
    return df.withColumns({"completeness": c, "freshness": f, "consistency": k, "utility": u, "overall": 0.25 * c + 0.25 * f + 0.2 * k + 0.3 * u})


def quality_seven(adoption: Column, contradictions: Column, recall: Column, quality: Column, downstream: Column, gain: Column, corroboration: Column) -> Column:
    return 0.20 * adoption + 0.15 * F.when(contradictions == 0, 1.0).otherwise(0.5) + 0.10 * recall + 0.10 * F.coalesce(quality, F.lit(0.5)) + 0.15 * F.when(downstream, 1.0).otherwise(0.3) + 0.10 * gain + 0.20 * F.least(corroboration, F.lit(3)) / 3


def importance(n: Column, days: Column, centrality: Column, confidence: Column, tenant: Column) -> tuple[Column, Column]:
    """Composite of the signals that are known, renormalised, and the share of weight that is known."""
    parts = [(0.25, n / (n + 5)), (0.25, F.exp(-days / 30)), (0.15, centrality), (0.25, confidence), (0.10, tenant)]
    zero = F.lit(0.0)
    known = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), zero)
    total = sum((F.coalesce(w * c, zero) for w, c in parts), zero)
    return F.when(known > 0, total / known).otherwise(0.0), known


def reputation(adoption: Column, quality: Column, corroboration: Column, contradictions: Column, down: Column, immune: Column) -> Column:
    part = lambda c: F.least(c / 10, F.lit(1.0))
    return 0.25 * adoption + 0.25 * quality + 0.20 * corroboration + 0.15 * (1 - part(contradictions)) + 0.10 * (1 - part(down)) + 0.05 * part(immune)


def bond(composite: Column, publications: Column, adoption: Column) -> Column:
    return F.when((composite >= 0.9) & (publications >= 50), "Authority").when((publications >= 10) & (adoption >= 0.8), "Validator").when((publications >= 3) & (adoption >= 0.6), "Contributor").otherwise("Newcomer")


def bond_bonus(level: Column, idle_days: Column) -> Column:
    full = F.when(level == "Authority", 0.20).when(level == "Validator", 0.12).when(level == "Contributor", 0.05).otherwise(0.0)
    return full * F.exp(-idle_days / 30 * 0.5)


def corroboration_bonus(sources: Column, domains: Column, contradictions: Column) -> Column:
    return clamp(sources / 4, 0.0, 0.2) + clamp(domains / 3, 0.0, 0.2) - clamp(0.08 * contradictions, 0.0, 0.3)


def calibration(df: DataFrame, predicted: str, outcome: str, bins: int = 10) -> DataFrame:
    """One row: n, Brier score, expected calibration error over equal-width bins."""
    p, y = F.col(predicted), F.col(outcome)
    b = df.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c"), F.sum((p - y) * (p - y)).alias("se"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    return b.agg(F.sum("c").alias("n"), (F.sum("se") / F.sum("c")).alias("brier"), (F.sum(F.col("c") * F.abs(F.col("mp") - F.col("my"))) / F.sum("c")).alias("ece"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, group: list[str]) -> DataFrame:
    """Shares per equal-width bin and group; out-of-range values count at the ends, empty bins get a floor of 1e-6."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((value - low) / ((high - low) / bins)))).cast("int")
    counts = df.groupBy(*group, b.alias("bin")).agg(F.count("*").alias("c"))
    total = counts.groupBy(*group).agg(F.sum("c").alias("t")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return total.join(counts, [*group, "bin"], "left").select(*group, "bin", F.greatest(F.coalesce("c", F.lit(0)) / F.col("t"), F.lit(1e-6)).alias("share"))


def divergence(bins: DataFrame, group: str, base: object, now: object, by: list[str]) -> DataFrame:
    """Population stability index and symmetric KL divergence of two groups of a histogram, for each of ``by``."""
    a = bins.filter(F.col(group) == base).select(*by, "bin", F.col("share").alias("p"))
    b = bins.filter(F.col(group) == now).select(*by, "bin", F.col("share").alias("q"))
    up = lambda c: F.greatest(F.lit(0.0), F.sum(c))
    p, q = F.col("p"), F.col("q")
    return a.join(b, [*by, "bin"]).groupBy(*by).agg(up((q - p) * F.log(q / p)).alias("psi"), ((up(p * F.log(p / q)) + up(q * F.log(q / p))) / 2).alias("kl"))


def drift_action(psi: Column, shift: Column, kl: Column, n: Column) -> Column:
    return F.when(n < 8, "Observe").when((psi >= 0.20) | (shift >= 0.18), "RebuildIndex").when(kl >= 0.15, "RetrainReranker").otherwise("Observe")


def entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """Entropy of a group's values, divided by its largest possible value; 0 for a single value."""
    c = df.groupBy(group, value).agg(F.count("*").alias("c"))
    s = c.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log("c")).alias("clc"))
    return s.select(group, F.when(F.col("k") > 1, (F.log("n") - F.col("clc") / F.col("n")) / F.log("k")).otherwise(0.0).alias("entropy"))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector per group; positions are averaged, nothing is collected but one number per position."""
    p = df.select(F.col(group), F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return p.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centroid"))


def share_of_top(df: DataFrame, group: str, by: str) -> DataFrame:
    """The most frequent value of a group with its share and the group's size."""
    c = df.groupBy(group, by).agg(F.count("*").alias("c"))
    return c.groupBy(group).agg(F.max_by(by, F.struct(F.col("c"), F.col(by))).alias("top"), (F.max("c") / F.sum("c")).alias("share"), F.sum("c").alias("n"))


def co_changed(df: DataFrame, group: str, item: str, part: int = 500) -> DataFrame:
    """Strength 1-0.8^n of items changed together n times. Groups are cut into parts of about ``part`` items, and every two parts meet in a task of their own."""
    d = df.select(F.col(group).alias("g"), F.col(item).alias("x")).filter("g is not null and x is not null").distinct()
    size = d.groupBy("g").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    d = d.join(size, "g").withColumn("mine", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    d = d.select("g", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "x")
    met = d.select("g", "lo", "hi", F.col("mine").alias("ma"), F.col("x").alias("a")).join(d.select("g", "lo", "hi", F.col("mine").alias("mb"), F.col("x").alias("b")), ["g", "lo", "hi"])
    pairs = met.filter("a < b and (lo = hi or ma <> mb)")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("strength", 1 - F.pow(F.lit(0.8), F.col("n")))


def capacity_victims(df: DataFrame, capacity: int, score: Column) -> DataFrame:
    """The rows of lowest score beyond the capacity, ties by uri: all but the ``capacity`` highest, which alone are gathered."""
    scored = df.withColumn("keep_score", score)
    kept = scored.orderBy(F.desc("keep_score"), F.desc("uri")).limit(capacity).select("uri")
    return scored.join(kept, "uri", "left_anti")


def temperature(df: DataFrame, logit: Column, target: Column) -> DataFrame:
    return df.agg(clamp(F.avg(logit / target), 0.5, 3.0).alias("temperature"))


def thrash(df: DataFrame, scope: str, at: Column, order: list[Column], message: str) -> DataFrame:
    """Consecutive commits with the same message, and empty messages, per scope. ``at``: a number to order by."""
    t = previous(df, [scope], at, order, F.col(message), "_before").withColumn("again", F.coalesce(F.col("_before") == F.col(message), F.lit(False)))
    return t.groupBy(scope).agg(F.count("*").alias("n"), F.count(F.when(F.col("again"), 1)).alias("repeats"), F.count(F.when(F.trim(F.coalesce(F.col(message), F.lit(""))) == "", 1)).alias("empty"))
