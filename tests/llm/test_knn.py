import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.graph_index import Graph
from palimpsest.llm import knn
from palimpsest.llm.knn import default_probes, nearest, similar_pairs

SCHEMA = "`set` string, `key` string, vec array<double>, rank string"


def brute(keys, v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {keys[i]: [(keys[j], s[i, j]) for j in sorted(range(len(keys)), key=lambda j: (-s[i, j], keys[j]))[:k]] for i in range(len(keys))}


def recall(got, exp, k):
    hit = 0
    for key, best in exp.items():
        least = best[-1][1] - 1e-6
        hit += sum(s >= least for _, s in got.get(key, []))
    return hit / (k * len(exp))


@pytest.mark.parametrize(("shard", "queries"), [(100_000, 100_000), (150, 200)])
def test_recall(spark, shard, queries):
    r = np.random.default_rng(1)
    v = r.normal(size=(900, 64))
    v[300:400] = v[:100] + 0.2 * r.normal(size=(100, 64))
    keys = [f"k{i:04}" for i in range(len(v))]
    df = spark.createDataFrame([("s", k, x.tolist(), "clash") for k, x in zip(keys, v)], SCHEMA)
    n = nearest(df, probes=4, shard=shard, queries=queries)
    got = {}
    for row in n.collect():
        got.setdefault(row["key"], []).append((row["other"], row["similarity"]))
    exp = brute(keys, v.astype(np.float32).astype(float), 5)
    assert recall(got, exp, 5) >= 0.9
    near = {("s", *sorted((a, b))) for a, best in exp.items() for b, s in best if s >= 0.9}
    assert len(near) >= 90 and near == {tuple(x) for x in similar_pairs(n, 0.9).collect()}


def test_recall_at_default_probes_in_many_shards(spark):
    r = np.random.default_rng(5)
    homes = r.normal(size=(60, 64))
    v = homes[r.integers(0, 60, 5000)] + 0.8 * r.normal(size=(5000, 64))
    v[4900:] = v[:100] + 0.1 * r.normal(size=(100, 64))
    keys = [f"k{i:04}" for i in range(len(v))]
    df = spark.createDataFrame([("s", k, x.tolist(), "clash") for k, x in zip(keys, v)], SCHEMA)
    assert -(-len(v) // 75) >= 64 and default_probes(67) == 13
    got = {}
    for row in nearest(df, shard=75).collect():
        got.setdefault(row["key"], []).append((row["other"], row["similarity"]))
    assert recall(got, brute(keys, v.astype(np.float32).astype(float), 5), 5) >= 0.95


def test_hashes_that_clash(spark, monkeypatch):
    rows = [("s", f"k{i}", [i + 1.37, 1.0] + [0.0] * 62, "") for i in range(12)]
    result = lambda: sorted((r["key"], r["other"], round(r["similarity"], 9), r["rank"]) for r in nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    exp = result()
    plain = F.xxhash64
    monkeypatch.setattr(knn.F, "xxhash64", lambda *c: F.lit(5).cast("long") if [x for x in c if isinstance(x, str)] == ["set", "vec"] and len(c) == 2 else plain(*c))
    assert result() == exp and len(exp) == 60


def test_copies_unusable_and_ties(spark):
    one, two = [1.0] + [0.0] * 63, [0.0, 2.0] + [0.0] * 62
    rows = [("s", f"c{i}", one, "") for i in range(9)] + [("s", "t", two, ""), ("s", "t", two, ""), ("o", "x", one, ""), (None, "n", one, ""), (None, "m", one, "")]
    rows += [("s", "null", None, ""), ("s", "short", [1.0], ""), ("s", "zero", [0.0] * 64, ""), ("s", "nan", [float("nan")] * 64, ""), ("s", "inf", [float("inf")] + [1.0] * 63, ""), ("s", "hole", [None] + [1.0] * 63, ""), ("s", None, one, "")]
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r["set"], r["key"]), []).append((r["rank"], r["other"]))
    assert sorted(got["s", "c0"]) == [(i, f"c{i}") for i in range(1, 6)]
    assert sorted(got["s", "c8"]) == [(i + 1, f"c{i}") for i in range(5)]
    assert sorted(got["s", "t"]) == [(i + 1, f"c{i}") for i in range(5)]
    assert ("o", "x") not in got and len(got) == 10
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_alone():
    v = np.random.default_rng(0).normal(size=(500, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = Graph(v, 12, 24)
    ids, dist = g.search(v, 1)
    assert (ids[:, 0] == np.arange(500)).mean() > 0.97 and (np.diff(g.search(v, 8)[1], axis=1) >= 0).all()
    assert (g.links < 500).all() and all(len(set(x[x >= 0])) == (x >= 0).sum() for x in g.links)
    assert Graph(v[:1]).search(v[:2], 3)[0].tolist() == [[0, -1, -1], [0, -1, -1]]
    assert Graph(v[:0]).search(v[:1], 2)[0].tolist() == [[-1, -1]]
