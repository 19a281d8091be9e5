import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators.budget import knapsack
from palimpsest.operators.graph import common_ancestor, pagerank, reach
from palimpsest.plans.query import Composite, Find, compile_query


def test_knapsack_against_enumeration():
    r = random.Random(2)
    for _ in range(20):
        rows = pd.DataFrame([("q", f"u{i}", lv, r.randrange(1, 12), r.random()) for i in range(4) for lv in ("L0", "L1")], columns=["query", "uri", "level", "cost", "value"])
        best = 0.0
        for pick in itertools.product([None, 0, 1], repeat=4):
            chosen = [rows.iloc[2 * i + p] for i, p in enumerate(pick) if p is not None]
            if sum(c["cost"] for c in chosen) <= 15:
                best = max(best, sum(c["value"] for c in chosen))
        got = knapsack(rows, 15)
        assert got["cost"].sum() <= 15 and got["uri"].is_unique
        value = rows.merge(got, on=["query", "uri", "level", "cost"])["value"].sum()
        assert abs(value - best) < 1e-9


def test_reach_and_rank(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("c", "a", "x"), ("d", "a", "x")], "`from` string, `to` string, kind string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in reach(e, seed, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r) for r in reach(e, seed, 5, ["x"]).collect()} == {("a", 0), ("b", 1)}
    ranks = {r["node"]: r["rank"] for r in pagerank(e, 20).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["a"] == max(ranks.values())
    assert pagerank(e.limit(0), 3).count() == 0


def test_query_values(spark):
    rows = [("uwu://t/a", "fact", 0.9, ["x"], None), ("uwu://t/b", "fact", 0.4, ["x", "y"], None), ("uwu://t/c", "goal", None, None, "n"), ("uwu://tt/a", "fact", 0.7, [], None)]
    e = spark.createDataFrame(rows, "uri string, content_type string, quality double, tags array<string>, invalidated_by string")
    ask = lambda q: [r["uri"] for r in compile_query(q, e).collect()]
    assert ask(Find(scope="uwu://t", content_type="fact", order="quality", limit=5)) == ["uwu://t/a", "uwu://t/b"]
    assert ask(Find(tags=("x", "y"))) == ["uwu://t/b"]
    assert ask(Find(quality=0.5, order="natural", limit=1)) == ["uwu://t/a"]
    assert sorted(ask(Composite((Find(content_type="goal"), Find(only_current=True)), "union"))) == sorted(["uwu://t/c", "uwu://t/a", "uwu://t/b", "uwu://tt/a"])
    assert ask(Composite((Find(tags=("x",)), Find(quality=0.5)), "intersect")) == ["uwu://t/a"]


@pytest.mark.parametrize("block", [1_000_000, 12, 8])
def test_reach_without_limit(spark, block):
    n = 9
    links = [(f"n{i}", f"n{i + 1}", "x") for i in range(n)] + [(f"n{n}", "n0", "x"), ("s", f"n{n - 1}", "x"), ("p", "q", "x"), ("q", "q", "x"), ("r", None, "x")]
    e = spark.createDataFrame(links, "`from` string, `to` string, kind string")
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    start = one("n0").union(one("p")).union(one("alone"))
    assert {tuple(r) for r in reach(e, start, None, block_arcs=block).collect()} == {(f"n{i}", i) for i in range(n + 1)} | {("p", 0), ("q", 1), ("alone", 0)}
    assert [tuple(r) for r in common_ancestor(e.filter(F.col("from") != f"n{n}"), one("n0"), one("s")).collect()] == [(f"n{n - 1}", n - 1, 1)]


def test_old_ancestors_are_not_collected(spark, monkeypatch):
    import datetime as dt

    from palimpsest.plans import q_graph as Q

    n, t = 140, dt.datetime(2024, 1, 1)
    c = spark.createDataFrame([(f"c{i:03}", "s", t + dt.timedelta(hours=i)) for i in range(n)] + [("loose", "s", t)], "id string, scope string, committed_at timestamp_ntz")
    e = spark.createDataFrame([(f"c{i:03}", f"c{i - 1:03}", "derived_from") for i in range(1, n)], "`from` string, `to` string, kind string")
    monkeypatch.setattr(Q, "commits", lambda s, d: c)
    monkeypatch.setattr(Q, "edges", lambda s, d: e)
    assert [r["id"] for r in Q.v_gc(spark, "").collect()] == ["loose"]
    assert {tuple(r) for r in Q.v_dag(spark, "").collect()} == {(f"c{i:03}", n - 1 - i) for i in range(n - 1)}
