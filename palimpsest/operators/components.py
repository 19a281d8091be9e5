"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, keep


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, settle: bool = True) -> DataFrame:
    """Label of every node that occurs in ``edges``: columns node, component (the smallest node).

    Each round links every node's larger neighbours to its smallest one (large
    star), then its smaller neighbours likewise (small star). The number of
    edges never grows and the depth of the contracted trees halves, so long
    chains need a logarithmic number of rounds. Rounds end when the edges no
    longer change. Edges with a null end are left out; an edge from a node to
    itself makes the node known. No edges, no rows. Without ``settle`` the rounds end after ``max_rounds`` anyhow, and
    a component may still have several labels, each of nodes near each other. The rows of one node (a component's smallest has
    an edge to most others) only meet other rows by aggregation, or in joins whose other side has one row a node.
    """
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    nodes = keep(pairs, "edges")
    now = nodes.filter("u <> v")
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        smaller = large.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("m"))
        small = large.join(smaller, large["v"] == smaller["node"]).select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v")).filter("u <> v").distinct()
        before, now = now, keep(small, "stars")
        if seen is not None:
            drop(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        if settle:
            raise RuntimeError("components did not settle")
    every = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    return every.join(now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
