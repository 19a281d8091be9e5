"""Mixing sources to target shares with a Pfair schedule."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import keep
from .tokens import TOKENIZER, numbered_copies, token_counts

PERIOD = 1000
MOST_SLOTS = 1 << 20
CHUNK_ROWS = 2000
MOST_TARGETS = 10_000


def source_key(c: Column) -> Column:
    """A source without letter case and outer white space."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def period_for(shares: dict[str, float]) -> int:
    """Slots after which the schedule repeats: enough for two of the smallest share, at least ``PERIOD`` and at most ``MOST_SLOTS``."""
    least = min(shares.values()) / sum(shares.values())
    return int(min(MOST_SLOTS, max(PERIOD, math.ceil(2 / least))))


def whole_weights(shares: dict[str, float], period: int) -> dict[str, int]:
    """Shares as whole numbers out of ``period``, by largest remainder, and at least 1 each."""
    total = sum(shares.values())
    exact = {k: v / total * period for k, v in shares.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: max(0, period - sum(out.values()))]:
        out[k] += 1
    for _ in range(sum(out.values()) - period):
        out[max(out, key=lambda k: (out[k], k))] -= 1
    return out


def pfair(weights: dict[str, int], period: int) -> dict[str, list[int]]:
    """Slots of each source in one period. ``weights`` sum to ``period``.

    Block k of a source of weight w is released at floor(k period/w) and due by
    ceil((k+1) period/w). In every slot the released block with the earliest
    deadline goes; so no source is ever a whole block ahead of or behind its share.
    """
    slots: dict[str, list[int]] = {k: [] for k in weights}
    later = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, int, str]] = []
    for t in range(period):
        while later and later[0][0] <= t:
            _, s = heapq.heappop(later)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // weights[s]), -weights[s], s))
        s = heapq.heappop(ready)[2]
        slots[s].append(t)
        if len(slots[s]) < weights[s]:
            heapq.heappush(later, (len(slots[s]) * period // weights[s], s))
    return slots


@dataclass(frozen=True)
class Mix:
    """schedule: the document copies and their slots; shares: one row per source."""

    schedule: DataFrame
    shares: DataFrame


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total_tokens: int | None = None, least: float = 0.5, block_tokens: int = 16_384, tokenizer: str = TOKENIZER) -> Mix:
    """Interleaves the documents of the sources so that each has its target share of the tokens.

    ``targets``: source, target_share, max_repeats. The size of the mix is, if
    not given, the largest at which every source with documents can reach its
    target within ``max_repeats``, but no less than ``least`` times all tokens of the targeted sources:
    a tiny source then gives all it may and is reported as short. Shares are met to one document a source.

    A source is an endless stream: its documents in an order by hash, again and
    again; a document's place in it is a prefix sum in two levels (within chunks of about
    ``CHUNK_ROWS``, then over chunks), so no task sees a whole source. The stream is cut into
    blocks of ``block_tokens``, which the Pfair schedule interleaves by what each source puts in; so all
    sources, short ones too, last to the end of the mix. It repeats after ``period_for`` slots, so every
    document finds its slot by itself. A source of under one slot in ``MOST_SLOTS`` gets one, and ends earlier.

    schedule: id, source, copy (from 0), n_tokens, place (first token in the stream),
    block, slot; ordered by (slot, place) it is the mix. shares: source, target_share,
    share, tokens, available, max_repeats, n_copies, reached (within a
    block or a thousandth of the mix). Documents without source or with one that has no target, a zero share or
    no tokens take no part. Repeated target rows of a source add up. Repeated documents are documents.
    """
    goal = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share"), F.col("max_repeats")).filter("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    kind = docs.schema[id_col].dataType.simpleString()
    sizes = token_counts(docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text")), "text", tokenizer)
    sizes = keep(numbered_copies(sizes), "tokens")
    goals = goal.limit(MOST_TARGETS + 1).collect()
    if len(goals) > MOST_TARGETS:
        raise ValueError(f"over {MOST_TARGETS} targets")
    found = {r["source"]: r["n"] for r in sizes.join(F.broadcast(goal.select("source")), "source").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    share = {g["source"]: g["target_share"] for g in goals if g["target_share"] > 0 and found.get(g["source"], 0) > 0}
    repeats = {g["source"]: max(0, g["max_repeats"]) for g in goals}
    share = {s: w for s, w in share.items() if repeats[s] > 0}
    whole = sum(share.values()) or 1.0
    if total_tokens is None:
        total_tokens = int(max(least * sum(found.values()), min((repeats[s] * found[s] * whole / w for s, w in share.items()), default=0)))
    take = {s: min(int(round(total_tokens * w / whole)), repeats[s] * found[s]) for s, w in share.items()}
    put = {s: n for s, n in take.items() if n > 0}
    period = period_for(put) if put else PERIOD
    weights = whole_weights(put, period) if put else {}
    slots = pfair(weights, period) if weights else {}
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, found[s], take[s], weights.get(s, 0), slots.get(s, [])) for s in take], "source string, available bigint, take bigint, weight int, slots array<int>")

    mine = sizes.join(F.broadcast(plan.select("source", "available", "take")), "source").filter("n_tokens > 0")
    chunks = max(1, mine.count() // CHUNK_ROWS)
    mine = mine.withColumn("chunk", F.pmod("h", F.lit(chunks)))
    inside = mine.withColumn("before", F.sum("n_tokens").over(W.partitionBy("source", "chunk").orderBy("h", "id", "nth").rowsBetween(W.unboundedPreceding, -1)))
    sums = mine.groupBy("source", "chunk").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))).select("source", "chunk", F.coalesce("base", F.lit(0)).alias("base"))
    placed = inside.join(sums, ["source", "chunk"]).withColumn("first", F.coalesce("before", F.lit(0)) + F.col("base"))
    copies = placed.filter("first < take").withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("take") - 1 - F.col("first")) / F.col("available")).cast("int")))).withColumn("place", F.col("copy") * F.col("available") + F.col("first"))
    slotted = copies.join(F.broadcast(plan.select("source", "weight", "slots")), "source").withColumn("block", F.floor(F.col("place") / block_tokens))
    slot = F.floor(F.col("block") / F.col("weight")) * period + F.get("slots", F.pmod("block", "weight").cast("int"))
    schedule = slotted.select(F.col("id").cast(kind).alias(id_col), "source", "copy", "n_tokens", "place", "block", slot.cast("bigint").alias("slot"))
    schedule = keep(schedule, "mix")
    actual = schedule.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_copies"))
    mixed = schedule.agg(F.sum("n_tokens")).first()[0] or 0
    have = spark.createDataFrame([(s, n) for s, n in found.items()], "source string, available bigint")
    report = goal.join(actual, "source", "left").join(have, "source", "left")
    got = F.coalesce("tokens", F.lit(0))
    shares = report.select(
        "source", "target_share", (got / max(1, mixed)).alias("share"), got.alias("tokens"), F.coalesce("available", F.lit(0)).alias("available"), "max_repeats", F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        (got >= F.col("target_share") * mixed - max(block_tokens, mixed // 1000)).alias("reached"),
    )
    return Mix(schedule, shares)
