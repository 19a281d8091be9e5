"""Which level of each hit fits into a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL_GAIN = {"L0": 1.0, "L1": 1.45, "L2": 1.85}


def choice_value(relevance: Column, quality: Column, typed: Column, level: str, cost: Column) -> Column:
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.coalesce(quality, F.lit(0.75))))
    return F.greatest(relevance, F.lit(0.0)) * q * F.when(typed, 1.05).otherwise(1.0) * LEVEL_GAIN[level] - 0.01 * F.log(1 + cost)


def choices(hits: DataFrame) -> DataFrame:
    """One row per hit and level that has text: cost in tokens (at least 1, 50, 100) and value."""
    tokens = lambda c, floor: F.greatest(F.lit(floor), F.ceil(F.length(c) / 4)).cast("bigint")
    rows = [F.when(F.col(c).isNotNull(), F.struct(F.lit(level).alias("level"), tokens(F.col(c), floor).alias("cost"), choice_value(F.col("relevance"), F.col("quality"), F.col("content_type").isNotNull(), level, tokens(F.col(c), floor)).alias("value"))) for level, c, floor in (("L0", "l0", 1), ("L1", "l1", 50), ("L2", "l2", 100))]
    return hits.select("query", "uri", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("query", "uri", "c.*")


def knapsack(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Multiple-choice knapsack: at most one level a hit, greatest value within the budget."""
    best = [0.0] * (budget + 1)
    taken: list[dict[int, int]] = []
    groups = [(u, g) for u, g in rows.groupby("uri", sort=True)]
    for _, g in groups:
        options = list(zip(g["cost"].tolist(), g["value"].tolist(), g.index.tolist()))
        new, how = best[:], {}
        for b in range(budget + 1):
            for cost, value, i in options:
                if cost <= b and best[b - cost] + value > new[b] + 1e-12:
                    new[b] = best[b - cost] + value
                    how[b] = i
        best = new
        taken.append(how)
    b, out = budget, []
    for how in reversed(taken):
        if b in how:
            out.append(how[b])
            b -= int(rows.loc[how[b], "cost"])
    return rows.loc[sorted(out), ["query", "uri", "level", "cost"]]


def fit_budget(hits: DataFrame, budget: int) -> DataFrame:
    """Chosen level per query and hit. Hits are a query's top list, so a group is bounded by its k."""
    return choices(hits).groupBy("query").applyInPandas(lambda rows: knapsack(rows.reset_index(drop=True), budget), "query string, uri string, level string, cost bigint")


def greedy(rows: pd.DataFrame, budget: int, penalty: float = 0.5, least: float = 0.05, upgrade: float = 0.7, l1_cost: int = 2000) -> pd.DataFrame:
    """Hits of one query (query, uri, relevance, cost) by relevance a token, ties by uri.

    A hit's value falls with the share of those taken that have its first four address segments. One of ``upgrade`` or more takes level
    L1 at ``l1_cost`` if that is left; what does not fit is passed over, and at a value under ``least`` it ends.
    """
    r = rows.assign(cost=rows["cost"].clip(lower=1)).assign(ratio=lambda t: -t["relevance"] / t["cost"]).sort_values(["ratio", "uri"])
    out, homes, left = [], [], budget
    for query, uri, relevance, cost in zip(r["query"], r["uri"], r["relevance"], r["cost"]):
        home = uri.split("/")[:4]
        value = relevance * (1 - penalty * (sum(h == home for h in homes) / len(homes) if homes else 0.0))
        if not left or value < least:
            break
        level, price = ("L1", l1_cost) if value >= upgrade and left >= l1_cost else ("L0", int(cost))
        if price <= left:
            out.append((query, uri, level, price))
            homes.append(home)
            left -= price
    return pd.DataFrame(out, columns=["query", "uri", "level", "cost"])


def spread_budget(hits: DataFrame, budget: int) -> DataFrame:
    """Chosen hits per query, spread over addresses. Hits (query, uri, relevance, l0) are a query's top list, so a group is bounded by its k."""
    h = hits.select("query", "uri", "relevance", F.ceil(F.length("l0") / 4).cast("bigint").alias("cost"))
    return h.groupBy("query").applyInPandas(lambda rows: greedy(rows, budget), "query string, uri string, level string, cost bigint")
