"""Publication, conflict, fitness, immunity, routing and privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import keep
from .ranking import highest_in_blocks


def fitness(quality: Column, confidence: Column, adoption: Column, corroboration: Column, hits: Column, novelty: Column, days: Column, contradictions: Column, down: Column) -> Column:
    level = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.55, 0.8, 1.0)]), (F.least(corroboration, F.lit(4)) + 1).cast("int"))
    penalty = F.least(F.lit(0.55), F.greatest(F.lit(0.0), 0.12 * contradictions + 0.06 * down))
    return 0.30 * quality + 0.16 * confidence + 0.20 * adoption + 0.14 * level + 0.08 * F.log(hits + 1) / 8 + 0.07 * novelty + 0.05 / (1 + days / 90) - penalty


def conflict_kind(similarity: Column, marker: Column, same_evidence: Column) -> Column:
    return F.when((similarity > 0.8) | ~((similarity > 0.4) & marker), None).when(same_evidence, "SameEvidence").when(similarity > 0.6, "Direct").otherwise("Overlapping")


def resolve_conflict(quality_a: Column, quality_b: Column, evidence_a: Column, evidence_b: Column) -> Column:
    return F.when((evidence_a > evidence_b) & (quality_a > quality_b), "KeepFirst").when((evidence_b > evidence_a) & (quality_b > quality_a), "KeepSecond").otherwise("Defer")


def immune_verdict(vectors: DataFrame, threats: DataFrame, blocked: float = 0.9, suspicious: float = 0.75) -> DataFrame:
    """Highest cosine of each vector (uri, embedding) to the known threats (id, threat), however many, and the verdict."""
    s = highest_in_blocks(vectors, threats, "uri", "embedding", "id", "threat")
    return s.withColumn("verdict", F.when(F.col("similarity") >= blocked, "Blocked").when(F.col("similarity") >= suspicious, "Suspicious").otherwise("Clean"))


def route_score(capability: Column, trust: Column, reputation: Column, latency: Column, fail: Column) -> Column:
    t = F.element_at(F.array(*[F.lit(x) for x in (0.35, 0.55, 0.80, 1.0)]), (trust + 1).cast("int"))
    return 0.30 * capability + 0.20 * t + 0.15 * reputation + 0.15 * latency + 0.10 + 0.075 - 0.20 * fail


def granted(requests: DataFrame, grants: DataFrame, at: Column) -> DataFrame:
    """Requests (subject, domain, epsilon) that some unexpired grant covers."""
    g = grants.select("subject", "domain", F.col("epsilon").alias("most"), "expires")
    return requests.join(g, ["subject", "domain"]).filter((F.col("epsilon") <= F.col("most")) & (F.col("expires") > at)).select(*requests.columns).distinct()


def k_anonymous(df: DataFrame, group: list[str], who: str, k: int) -> DataFrame:
    return df.groupBy(*group).agg(F.countDistinct(who).alias("n")).filter(F.col("n") >= k)


def noise(seed: Column, scale: float) -> Column:
    """Laplace noise that depends on the seed alone."""
    u = (F.pmod(F.xxhash64(seed), F.lit(1_000_003)) + 0.5) / 1_000_003 - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def shares(value: Column, n: int, modulus: int = 2_147_483_647) -> Column:
    """Additive shares that sum to the value modulo ``modulus``."""
    first = [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(modulus)) for i in range(n - 1)]
    total = sum(first, F.lit(0))
    return F.array(*first, F.pmod(value - total, F.lit(modulus)))


def consistency_level(content_type: Column) -> Column:
    return F.when(content_type.isin("fact", "procedure", "profile"), "Strong").when(content_type.isin("goal", "preference", "skill"), "Causal").otherwise("Eventual")


def opposed_pairs(df: DataFrame, group: list[str], words: Column, least: float, opposites: tuple, padded: bool) -> DataFrame:
    """Pairs (a < b, by uri) of a group with opposite phrases and a Jaccard similarity of ``least`` or more: a, b, similarity. No such pair is lost.

    ``df``: uri (unique), l0, the group. Two sets of similarity t share a word among the rarest
    ``n - ceil(t n) + 1`` of each, so only texts that hold the two sides of one pair of phrases and such a word meet.
    A row with a null in its group, or without text, meets nothing.
    """
    low = F.lower("l0")
    x = F.concat(F.lit(" "), low, F.lit(" ")) if padded else low
    sides = F.array(*[F.struct(F.lit(i).alias("phrase"), F.lit(side).alias("side"), F.contains(x, F.lit(p)).alias("has")) for i, pq in enumerate(opposites) for side, p in enumerate(pq)])
    t = keep(df.select("uri", *group, words.alias("w"), F.filter(sides, lambda e: e["has"]).alias("sides")).filter("size(sides) > 0 and size(w) > 0"), "claims")
    often = t.select(F.explode("w").alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    ranked = t.select("uri", F.explode("w").alias("k")).join(often, "k").groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("c", "k"))).alias("r"))
    n = F.size("r")
    rare = F.slice("r", F.lit(1), (n - F.ceil(least * n - 1e-9) + 1).cast("int"))
    met = t.select("uri", *group, "sides").join(ranked.select("uri", n.alias("n"), F.transform(rare, lambda e: e["k"]).alias("rare")), "uri")
    met = met.select(*group, "uri", "n", F.explode("sides").alias("s"), "rare").select(*group, "uri", "n", "s.phrase", "s.side", F.explode("rare").alias("k"))
    one = lambda side, u, m: met.filter(F.col("side") == side).select(*group, "phrase", "k", F.col("uri").alias(u), F.col("n").alias(m))
    near = one(0, "u", "m").join(one(1, "v", "q"), [*group, "phrase", "k"]).filter((F.col("u") != F.col("v")) & (F.col("m") >= least * F.col("q") - 1e-9) & (F.col("q") >= least * F.col("m") - 1e-9))
    near = near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    both = near.join(t.select(F.col("uri").alias("a"), F.col("w").alias("wa")), "a").join(t.select(F.col("uri").alias("b"), F.col("w").alias("wb")), "b")
    return both.select("a", "b", T.jaccard(F.col("wa"), F.col("wb")).alias("similarity")).filter(F.col("similarity") >= least)


def text_conflicts(df: DataFrame, group: list[str]) -> DataFrame:
    """Pairs of a group that contradict each other in a band of similarity, with its kind."""
    p = opposed_pairs(df, group, T.words(F.col("l0")), 0.4, T.OPPOSITES, True)
    return p.select("a", "b", "similarity", conflict_kind(F.col("similarity"), F.lit(True), F.lit(False)).alias("kind")).filter("kind is not null")


def guard_plan(claims: DataFrame, at: Column, least: float = 0.36, strong: float = 0.18) -> DataFrame:
    """What to do about valid facts, beliefs and hypotheses of one type that contradict each other: a, b, overlap, action, priority.

    ``claims``: uri, l0, content_type, quality, valid_until, evidence (array). The weaker one goes if their
    qualities differ by ``strong`` or more; else both are validated again if they share evidence, or kept side by side.
    """
    valid = claims.filter(F.col("content_type").isin("fact", "belief", "hypothesis") & F.coalesce(F.col("valid_until") > at, F.lit(True)))
    p = opposed_pairs(valid, ["content_type"], T.terms(F.col("l0"), 3, "_-"), least, T.CLAIM_OPPOSITES, False)
    q = valid.select("uri", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("quality", F.lit(0.5)))).alias("q"), "evidence")
    j = p.join(q.select(F.col("uri").alias("a"), F.col("q").alias("qa"), F.col("evidence").alias("va")), "a").join(q.select(F.col("uri").alias("b"), F.col("q").alias("qb"), F.col("evidence").alias("vb")), "b")
    delta = F.abs(F.col("qa") - F.col("qb"))
    action = F.when(F.round(delta, 9) >= strong, "InvalidateWeaker").when(F.coalesce(F.arrays_overlap("va", "vb"), F.lit(False)), "RevalidateBoth").otherwise("KeepBothContextual")
    return j.select("a", "b", F.col("similarity").alias("overlap"), action.alias("action"), F.least(F.lit(1.0), 0.6 * F.col("similarity") + 0.4 * delta).alias("priority"))
