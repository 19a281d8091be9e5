"""Typed directed edges (from, to, kind): neighbours, traversal, centrality, lineage.

Iterations keep one small row per node and write each round to the shared folder.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import drop, keep
from .components import connected_components

BLOCK_ARCS = 200_000
MERGE_FRONTS = 16
LEAST_ARCS = 5_000


def outgoing(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    e = edges.filter(F.col("kind") == kind) if kind else edges
    return e.join(nodes.select(F.col("node").alias("from")), "from", "left_semi").select("from", "to").distinct()


def incoming(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    e = edges.filter(F.col("kind") == kind) if kind else edges
    return e.join(nodes.select(F.col("node").alias("to")), "to", "left_semi").select("from", "to").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Edges in and out per node, and their number over 16, at most 1."""
    ends = edges.select(F.col("from").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("to").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("n_out"), F.sum("in").alias("n_in")).withColumn("degree", F.least(F.lit(1.0), (F.col("n_out") + F.col("n_in")) / 16))


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None, kinds: list[str] | None = None, undirected: bool = False, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """Nodes within ``hops`` of the seeds, with the distance; None: all that can be reached. No kinds given: all kinds count."""
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    arcs = e.select(F.col("from").alias("a"), F.col("to").alias("b")).distinct()
    if undirected:
        arcs = arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = keep(seeds.select("node", F.lit(0).alias("hop")).distinct(), "seen")
    if hops is None:
        return _closure(keep(arcs.filter("a is not null and b is not null"), "arcs"), seen, block_arcs)
    return _rounds(keep(arcs, "arcs"), seen, hops)


def _rounds(arcs: DataFrame, seen: DataFrame, hops: int | None) -> DataFrame:
    """One round per hop over all arcs, until nothing new is found."""
    front = seen
    for hop in count(1) if hops is None else range(1, hops + 1):
        new = arcs.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        front = keep(new, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % MERGE_FRONTS == 0:
            seen = keep(seen, "seen")
    return seen


def _walk_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Distances inside one block. Rows: arcs (a to b), and seeds (b null)."""
    out, hop = defaultdict(list), {}
    for a, b in zip(rows["a"], rows["b"]):
        if b is None or b != b:
            hop[a] = 0
        else:
            out[a].append(b)
    front = list(hop)
    while front:
        new = []
        for x in front:
            for y in out.get(x, ()):
                if y not in hop:
                    hop[y] = hop[x] + 1
                    new.append(y)
        front = new
    return pd.DataFrame({"node": list(hop), "hop": list(hop.values())})


def _homes(arcs: DataFrame, block_arcs: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of whole histories (a, block), and the nodes (a) of histories of over ``block_arcs`` arcs. Blocks are about two a core, if that leaves them arcs enough."""
    n = arcs.count()
    per = min(block_arcs, max(LEAST_ARCS, n // (2 * arcs.sparkSession.sparkContext.defaultParallelism)))
    comp = keep(connected_components(arcs), "components")
    sizes = arcs.join(comp, arcs["a"] == comp["node"]).groupBy("component").agg(F.count("*").alias("n"))
    of = keep(comp.join(sizes, "component").select(F.col("node").alias("a"), "component", "n"), "homes")
    home = of.filter(F.col("n") <= block_arcs).select("a", F.pmod(F.xxhash64("component"), F.lit(max(1, -(-n // per)))).cast("int").alias("block"))
    return home, of.filter(F.col("n") > block_arcs).select("a")


def _closure(arcs: DataFrame, seeds: DataFrame, block_arcs: int) -> DataFrame:
    """All nodes that can be reached. Components are walked whole in blocks; only for one of over ``block_arcs`` arcs rounds are needed."""
    starts = seeds.join(arcs.select(F.col("a").alias("node")), "node", "left_semi").select(F.col("node").alias("a"))
    home, rest = _homes(arcs, block_arcs)
    large = None
    if not rest.isEmpty():
        large = _rounds(keep(arcs.join(rest, "a", "left_semi"), "arcs"), keep(starts.join(rest, "a", "left_semi").select(F.col("a").alias("node"), F.lit(0).alias("hop")), "seen"), None)
    rows = arcs.unionByName(starts.select("a", F.lit(None).cast(arcs.schema["b"].dataType).alias("b"))).join(home, "a")
    found = rows.groupBy("block").applyInPandas(_walk_block, f"node {arcs.schema['a'].dataType.simpleString()}, hop int").unionByName(seeds)
    found = found if large is None else found.unionByName(large)
    return keep(found.groupBy("node").agg(F.min("hop").alias("hop")), "reached")


def within(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None) -> DataFrame:
    """Edges that start at a node less than ``hops`` away from a seed."""
    near = reach(edges, seeds, max(0, hops - 1), kinds)
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    return e.join(near.select(F.col("node").alias("from")), "from", "left_semi").distinct()


def pagerank(edges: DataFrame, rounds: int = 32, damping: float = 0.85, start: DataFrame | None = None) -> DataFrame:
    """Rank per node, sum 1; nodes without edges out spread theirs over all. ``start``: ranks (node, rank) to begin from."""
    arcs = keep(edges.select(F.col("from").alias("a"), F.col("to").alias("b")).filter("a is not null and b is not null").distinct(), "arcs")
    out = arcs.groupBy("a").agg(F.count("*").alias("n_out"))
    nodes = arcs.select(F.col("a").alias("node")).unionByName(arcs.select(F.col("b").alias("node"))).distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    base = nodes.join(out.withColumnRenamed("a", "node"), "node", "left")
    if start is not None:
        base = base.join(start.select("node", "rank"), "node", "left").withColumn("rank", F.coalesce("rank", F.lit(1.0 / n)))
    else:
        base = base.withColumn("rank", F.lit(1.0 / n))
    # what nodes without edges out hold is summed while a round is written
    loose_rank = F.sum(F.when(F.col("n_out").isNull(), F.col("rank")))
    watch = Observation()
    now = keep(base.observe(watch, loose_rank.alias("loose")), "rank")
    for _ in range(rounds):
        loose = watch.get.get("loose") or 0.0
        watch, past = Observation(), now
        sent = arcs.join(now.filter("n_out is not null").select(F.col("node").alias("a"), (F.col("rank") / F.col("n_out")).alias("share")), "a").groupBy(F.col("b").alias("node")).agg(F.sum("share").alias("got"))
        now = keep(now.select("node", "n_out").join(sent, "node", "left").withColumn("rank", F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))).drop("got").observe(watch, loose_rank.alias("loose")), "rank")
        drop(past)
    return now.select("node", "rank")


def local_pagerank(edges: DataFrame, seeds: DataFrame, hops: int, rounds: int = 32) -> DataFrame:
    """Rank of the nodes within ``hops`` of the seeds, either way, by the edges among them."""
    near = reach(edges, seeds, hops, undirected=True).select("node")
    inside = edges.join(near.withColumnRenamed("node", "from"), "from", "left_semi").join(near.withColumnRenamed("node", "to"), "to", "left_semi")
    return pagerank(inside, rounds)


def node_score(rank: Column, degree: Column) -> Column:
    return 0.72 * rank + 0.28 * F.least(degree / 12, F.lit(1.0))


def associates(edges: DataFrame, seeds: DataFrame, per_seed: int = 2) -> DataFrame:
    """The first neighbours of each seed, each weighing half of the one before."""
    w = W.partitionBy("from").orderBy("to")
    n = outgoing(edges, seeds).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= per_seed)
    return n.select("from", "to", F.pow(F.lit(0.5), F.col("i") - 1).alias("weight"))


def reach_each(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` of each start by its own: of, node, hop (least). ``starts``: of, node."""
    arcs = keep(edges.select(F.col("from").alias("node"), F.col("to").alias("next")).filter("node is not null and next is not null").distinct(), "arcs")
    seen = front = keep(starts.select("of", "node", F.lit(0).alias("hop")).distinct(), "seen")
    for hop in range(1, hops + 1):
        new = arcs.join(front.select("of", "node"), "node").select("of", F.col("next").alias("node")).distinct().join(seen, ["of", "node"], "left_anti").withColumn("hop", F.lit(hop))
        front = keep(new, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def common_ancestors(edges: DataFrame, a: DataFrame, b: DataFrame, hops: int) -> DataFrame:
    """Of each pair of sides (of, node), the node above both with the least sum of distances: of, node, total."""
    x = reach_each(edges, a, hops).withColumnRenamed("hop", "hop_a")
    y = reach_each(edges, b, hops).withColumnRenamed("hop", "hop_b")
    both = x.join(y, ["of", "node"]).select("of", F.struct((F.col("hop_a") + F.col("hop_b")).alias("total"), "node").alias("n"))
    return both.groupBy("of").agg(F.min("n").alias("n")).select("of", "n.node", "n.total")


def _test_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b, ``asked``) of one block whose b can be reached from a by its arcs."""
    out, goals, found = defaultdict(list), defaultdict(set), []
    for a, b, asked in zip(rows["a"], rows["b"], rows["asked"]):
        if asked:
            goals[a].add(b)
        else:
            out[a].append(b)
    for start, wanted in goals.items():
        seen, todo, left = {start}, [start], set(wanted)
        while todo and left:
            x = todo.pop()
            left.discard(x)
            for y in out.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        found += [(start, g) for g in wanted - left]
    return pd.DataFrame(found, columns=["start", "goal"], dtype=object)


def reaches(edges: DataFrame, pairs: DataFrame, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """The pairs (start, goal) whose goal can be reached from the start, or is it.

    Histories are walked whole in blocks; a pair in one of over ``block_arcs`` arcs is searched for along the edges, round by round.
    """
    arcs = keep(edges.select(F.col("from").alias("a"), F.col("to").alias("b")).filter("a is not null and b is not null").distinct(), "arcs")
    pairs = keep(pairs.select("start", "goal").filter("start is not null and goal is not null").distinct(), "pairs")
    home, rest = _homes(arcs, block_arcs)
    no, yes = F.lit(False).alias("asked"), F.lit(True).alias("asked")
    rows = arcs.select("a", "b", no).unionByName(pairs.select(F.col("start").alias("a"), F.col("goal").alias("b"), yes)).join(home, "a")
    kind = arcs.schema["a"].dataType.simpleString()
    met = rows.groupBy("block").applyInPandas(_test_block, f"start {kind}, goal {kind}").unionByName(pairs.filter("start = goal"))
    front = seen = keep(pairs.join(rest.withColumnRenamed("a", "start"), "start", "left_semi").select("start", "goal", F.col("start").alias("a")), "seen")
    for turn in count(1):
        if front.isEmpty():
            return met.distinct()
        new = keep(arcs.join(front, "a").select("start", "goal", F.col("b").alias("a")).distinct().join(seen, ["start", "goal", "a"], "left_anti"), "front")
        hit = keep(new.filter("a = goal").select("start", "goal").distinct(), "met")
        met, front, seen = met.unionByName(hit), new.join(hit, ["start", "goal"], "left_anti"), seen.unionByName(new)
        if turn % MERGE_FRONTS == 0:
            seen, front, met = keep(seen, "seen"), keep(front, "front"), keep(met, "met")


def common_ancestor(edges: DataFrame, a: DataFrame, b: DataFrame, hops: int | None = None) -> DataFrame:
    """Of nodes above both sides the one with the least sum of distances."""
    x = reach(edges, a, hops).withColumnRenamed("hop", "hop_a")
    y = reach(edges, b, hops).withColumnRenamed("hop", "hop_b")
    both = x.join(y, "node").withColumn("total", F.col("hop_a") + F.col("hop_b"))
    return both.orderBy("total", "node").limit(1).select("node", "hop_a", "hop_b")


def shared_weight(df: DataFrame, who: str, what: str, least: int = 1) -> DataFrame:
    """Dice weight 2 sum(min) / total of two agents over their counts per domain."""
    c = df.groupBy(who, what).agg(F.count("*").alias("c"))
    total = c.groupBy(who).agg(F.sum("c").alias("t"))
    a = c.select(what, F.col(who).alias("a"), F.col("c").alias("ca"))
    b = c.select(what, F.col(who).alias("b"), F.col("c").alias("cb"))
    s = a.join(b, what).filter("a < b").groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("common")).filter(F.col("common") >= least)
    return s.join(total.select(F.col(who).alias("a"), F.col("t").alias("ta")), "a").join(total.select(F.col(who).alias("b"), F.col("t").alias("tb")), "b").select("a", "b", (2 * F.col("common") / (F.col("ta") + F.col("tb"))).alias("weight"))
