"""Nothing is lost to size: many rules, large groups, short words, dense vectors, deep histories."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import scratch
from palimpsest.functions import text as T
from palimpsest.operators import graph as G
from palimpsest.operators import market as K
from palimpsest.operators.aggregates import capacity_victims, co_changed
from palimpsest.operators.beliefs import inherited, literals
from palimpsest.operators.filters import allowed
from palimpsest.operators.folds import similar_vectors
from palimpsest.operators.hierarchy import circles, places
from palimpsest.operators.lifecycle import write_duplicates
from palimpsest.operators.ranking import highest_in_blocks, nearest_in_blocks
from palimpsest.operators.scans import grep_many


def test_over_ten_thousand_rules(spark):
    rules = spark.createDataFrame([(f"uwu://t{i}", "allow", 1) for i in range(10_001)] + [("uwu://t5/secret", "deny", 1), ("uwu://t6", "deny", 1), ("uwu://t7", "deny", 2)], "prefix string, effect string, priority int")
    df = spark.createDataFrame([(f"uwu://{x}",) for x in ("t0/a", "t10000/a", "t5/a", "t5/secret/a", "t5/secrets", "t6/a", "t7/a", "none/a", "t10000")] + [(None,)], "uri string")
    assert {r[0][6:] for r in allowed(df, rules).collect()} == {"t0/a", "t10000/a", "t5/a", "t5/secrets", "t10000"}


def test_too_many_patterns_are_refused(spark):
    with pytest.raises(ValueError):
        grep_many(spark.createDataFrame([("u", "text")], "uri string, l0 string"), spark.range(11).selectExpr("cast(id as string) as pattern", "cast(null as string) as scope"), 10)


def test_a_commit_of_over_a_thousand_items(spark):
    rows = [("big", f"i{i:04}") for i in range(1_001)] + [("c", "i0000"), ("c", "i0001"), ("c", "i0001"), (None, "i0000"), ("d", None)]
    got = co_changed(spark.createDataFrame(rows, "commit string, item string"), "commit", "item")
    assert got.count() == 1_001 * 1_000 // 2 and got.agg(F.min("a"), F.max("n")).first()[:] == ("i0000", 2)
    assert [tuple(r) for r in got.filter("n > 1").select("a", "b", "n").collect()] == [("i0000", "i0001", 2)]


def test_victims_are_all_but_the_kept(spark):
    df = spark.createDataFrame([(f"u{i:03}", i % 7) for i in range(100)], "uri string, s int")
    exp = sorted((i % 7, f"u{i:03}") for i in range(100))[:90]
    assert sorted((r["s"], r["uri"]) for r in capacity_victims(df, 10, F.col("s")).collect()) == exp


def test_conflicts_of_short_words(spark):
    rows = [("a", "t", "we can go"), ("b", "t", "we cannot go"), ("c", "t", "it is so"), ("d", "u", "we cannot go"), ("e", None, "we cannot go"), ("f", "t", None), ("g", "t", "")]
    df = spark.createDataFrame(rows, "uri string, g string, l0 string").withColumn("k", F.lit("clash"))
    got = {(r["a"], r["b"]): r["kind"] for r in K.text_conflicts(df, ["g"]).collect()}
    assert got == {("a", "b"): "Overlapping"}


def test_opposed_pairs_against_all_pairs(spark):
    r = random.Random(2)
    words = ["can", "cannot", "is", "is not", "a", "of", "x1", "x2", "x3", "go", "so", "the", "key"]
    rows = [(f"u{i:03}", r.choice("ab"), " ".join(r.choice(words) for _ in range(r.randrange(2, 9)))) for i in range(150)]
    got = {(x["a"], x["b"]) for x in K.opposed_pairs(spark.createDataFrame(rows, "uri string, g string, l0 string"), ["g"], T.words(F.col("l0")), 0.4, T.CLAIM_OPPOSITES, False).collect()}
    opposed = lambda x, y: any(p in x and q in y or q in x and p in y for p, q in T.CLAIM_OPPOSITES)
    jac = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    assert got == {(a, b) for (a, g, x), (b, h, y) in itertools.combinations(rows, 2) if g == h and opposed(x, y) and jac(x, y) >= 0.4} and got


def test_guard_actions(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [("a", "cache is enabled now", "fact", 0.9, None, ["e"]), ("b", "cache is disabled now", "fact", 0.5, None, []), ("c", "cache is disabled now", "fact", 0.85, None, ["e"]), ("d", "cache is disabled now", "skill", 0.1, None, []), ("e", "cache is disabled now", "fact", 0.1, at - dt.timedelta(1), []), ("f", "cache is disabled now", "fact", 0.8, None, None)]
    df = spark.createDataFrame(rows, "uri string, l0 string, content_type string, quality double, valid_until timestamp_ntz, evidence array<string>")
    got = {(r["a"], r["b"]): (r["action"], round(r["overlap"], 3), round(r["priority"], 3)) for r in K.guard_plan(df, F.lit(at).cast("timestamp_ntz")).collect()}
    assert got == {("a", "b"): ("InvalidateWeaker", 0.5, 0.46), ("a", "c"): ("RevalidateBoth", 0.5, 0.32), ("a", "f"): ("KeepBothContextual", 0.5, 0.34)}


@pytest.mark.parametrize(("rows", "loose"), [(8192, 0.2), (16, 1.0)])
def test_similar_vectors_against_all_pairs(spark, rows, loose):
    r = np.random.default_rng(1)
    v = np.repeat(r.normal(size=(40, 8)), 6, axis=0) + loose * r.normal(size=(240, 8))
    data = [(f"k{i:03}", x.tolist()) for i, x in enumerate(v)] + [("k000", v[0].tolist()), ("z", [0.0] * 8), ("n", None), ("nan", [float("nan")] * 8), (None, v[0].tolist())]
    got = {(x["a"], x["b"]) for x in similar_vectors(spark.createDataFrame(data, "k string, v array<double>"), "k", "v", 0.9, 5, rows).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {(f"k{i:03}", f"k{j:03}") for i, j in zip(*np.nonzero(np.triu(u @ u.T, 1) >= 0.9))} and got
    assert similar_vectors(spark.createDataFrame([], "k string, v array<double>"), "k", "v", 0.9).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    from palimpsest.operators import ranking

    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(90, 4)), 1)
    v[40:44] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id int, v array<double>")
    q = df.filter("id % 5 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    got = {}
    for x in nearest_in_blocks(q, df, "q", "qv", "id", "v", 3, 6).collect():
        got.setdefault(x["q"], set()).add(x["id"])
    assert got == {i: set(sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], j))[:3]) for i in range(0, 90, 5)}
    best = {x["id"]: round(x["similarity"], 6) for x in highest_in_blocks(df, q, "id", "v", "q", "qv").collect()}
    assert best == {i: round(float((u[i] @ u[::5].T).max()), 6) for i in range(90)}


def test_write_duplicates_against_all_pairs(spark):
    r = random.Random(6)
    rows = [(f"u{i:03}", r.choice("ab"), " ".join(r.sample([f"w{j}" for j in range(14)], 7))) for i in range(80)]
    got = {(x["a"], x["b"]) for x in write_duplicates(spark.createDataFrame(rows, "uri string, g string, l0 string"), ["g"], 0.6).collect()}
    assert got == {(a, b) for (a, g, x), (b, h, y) in itertools.combinations(rows, 2) if g == h and len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())) >= 0.6} and got


def test_a_deep_history(spark):
    n = 20_000
    links = spark.range(1, n).select(F.format_string("n%06d", "id").alias("c"), F.format_string("n%06d", F.col("id") - 1).alias("p"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("at"))
    top = places(links, "c", "p", seen_at="at", block_links=2_500).agg(F.max("depth"), F.max("n_descendants"), F.sum("depth"), F.countDistinct("root")).first()
    assert tuple(top) == (n - 1, n - 1, n * (n - 1) // 2, 1)
    ring = links.unionByName(spark.createDataFrame([("n000000", f"n{n - 1:06}")], "c string, p string").withColumn("at", F.lit(None).cast("timestamp_ntz")))
    assert circles(ring, "c", "p", "at", 2_500).count() == n and circles(links, "c", "p", "at", 2_500).count() == 0


def test_ancestors_of_pairs(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i - 1}", "d") for i in range(1, 60)] + [("x", "n3", "d"), ("a", "b", "d"), ("b", "a", "d"), (None, "n1", "d")], "`from` string, `to` string, kind string")
    pairs = spark.createDataFrame([("n59", "n0"), ("n0", "n59"), ("x", "n1"), ("x", "n4"), ("a", "a"), ("a", "b"), ("lone", "lone"), (None, "a")], "start string, goal string")
    exp = {("n59", "n0"), ("x", "n1"), ("a", "a"), ("a", "b"), ("lone", "lone")}
    assert {tuple(r) for r in G.reaches(e, pairs).collect()} == exp
    assert {tuple(r) for r in G.reaches(e, pairs, block_arcs=10).collect()} == exp


def test_redaction_by_word(spark):
    rows = [("mail (a@b.org), call +49-170-1234567 8", "mail ([REDACTED_EMAIL]), call +[REDACTED_ID] 8"), ("key sk-1 or ABCDEFGHIJKLMNOPQRSTUVWX.", "key [REDACTED_SECRET] or [REDACTED_SECRET]."), ("x -----BEGIN RSA PRIVATE KEY-----\nabc", "[REDACTED_PRIVATE_KEY]"), ("", ""), (None, None), ("@b.org a@b", "@b.org a@b")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(T.redact(F.col("t"))).collect()] == [b for _, b in rows]
    assert [r[0] for r in spark.createDataFrame([("System Prompt: x",), (" ",), (None,), ("a@b.org",), ("fine",)], "t string").select(T.blocked(F.col("t"))).collect()] == ["injection", "empty", "empty", "sensitive", "clean"]


def test_literals(spark):
    got = {(r["subject"], r["relation"], r["object"], r["negated"]) for r in literals(spark.createDataFrame([("u", "Cache = on. mode != fast; the cache must not evict keys\nnever retry"), ("v", None), ("w", " . ")], "uri string, t string"), "uri", "t").collect()}
    assert got == {("cache", "is", "on", False), ("mode", "is", "fast", True), ("cache", "asserts", "evict keys", True), ("retry", "asserts", "true", True)}


def test_inheritance(spark):
    nodes = spark.createDataFrame([("kid", "uwu://t/agent/kid", "dad"), ("dad", "uwu://t/agent/dad", None), ("orphan", "uwu://t/agent/orphan", "gone")], "agent string, scope string, parent string")
    rules = spark.createDataFrame([("kid", "uwu://t/agent/kid/own", "Replace", 0), ("kid", "uwu://t/agent/kid/own/no", "Hide", 1), ("kid", "uwu://t/agent/kid/no", "Hide", 2)], "agent string, pattern string, action string, place int")
    e = spark.createDataFrame([(f"uwu://t/agent/{a}/{x}", a) for a, x in (("kid", "x"), ("kid", "own/no"), ("kid", "no"), ("dad", "y"), ("orphan", "z"), ("stranger", "w"))], "uri string, agent string")
    assert {(r["uri"][14:], r["effective"][14:], r["from_parent"]) for r in inherited(e, nodes, rules).collect()} == {("kid/x", "dad/x", True), ("kid/own/no", "kid/own/no", False), ("dad/y", "dad/y", False)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *a):
            return None

    class Spark:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Spark())


def test_code_book(spark):
    from palimpsest.operators.quantize import encode, train_codebook

    r = np.random.default_rng(3)
    homes = r.normal(size=(4, 6)) * 5
    v = homes[r.integers(0, 4, 200)] + 0.1 * r.normal(size=(200, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id int, v array<double>")
    book = train_codebook(df, "id", "v", 2, 4)
    words = {(x["stretch"], x["code"]): np.array(x["word"]) for x in book.collect()}
    got = {x["id"]: x["codes"] for x in encode(df, book, "id", "v").collect()}
    assert got[900] is None and len(words) == 8
    for i, x in enumerate(v):
        for s, part in enumerate((x[:3], x[3:])):
            d = [np.linalg.norm(part - words[s, c]) for c in range(4)]
            assert got[i][s] == int(np.argmin(d)) and min(d) < 1


def test_hash_tables(spark):
    from palimpsest.operators.folds import lsh_index, lsh_query, lsh_remove, planes

    def number(table, bit, place, full=(1 << 64) - 1):
        z = (table * 0x9E3779B97F4A7C15 + bit * 0xBF58476D1CE4E5B9 + place * 0x94D049BB133111EB) & full
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & full
        z = (z ^ z >> 27) * 0x94D049BB133111EB & full
        return float(np.float32((z ^ z >> 31) / full)) * 2 - 1

    assert np.allclose(planes(5, 7, 3), [[number(3, b, p) for p in range(7)] for b in range(5)], atol=1e-6)
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(f"k{i}", r.normal(size=4).tolist()) for i in range(50)] + [("same", [1.0, 2.0, 3.0, 4.0]), ("short", [1.0]), ("none", None)], "k string, v array<double>")
    index = lsh_index(df, "k", "v", 3, 6, 4)
    asked = spark.createDataFrame([("q", [2.0, 4.0, 6.0, 8.0]), ("bad", [1.0])], "q string, v array<double>")
    near = {tuple(x) for x in lsh_query(index, asked, "q", "v", "k", 3, 6, 4).collect()}
    assert ("q", "same") in near and {x[0] for x in near} == {"q"} and len(near) < 51
    rest = {tuple(x) for x in lsh_query(lsh_remove(index, df.filter("k = 'same'"), "k"), asked, "q", "v", "k", 3, 6, 4).collect()}
    assert rest == near - {("q", "same")}


def test_greedy_budget():
    import pandas as pd

    from palimpsest.operators.budget import greedy

    rows = pd.DataFrame({"query": "q", "uri": ["uwu://t/a/1", "uwu://t/a/2", "uwu://u/a/3", "uwu://v/a/4", "uwu://w/a/5"], "relevance": [0.9, 0.8, 0.5, 0.4, 0.04], "cost": [10, 10, 20, 500, 0]})
    # the third best by ratio is of too small a value, so it ends there
    assert greedy(rows, 100)["uri"].tolist() == ["uwu://t/a/1", "uwu://t/a/2"]
    got = greedy(rows.iloc[:4], 100)[["uri", "level", "cost"]].values.tolist()
    assert got == [["uwu://t/a/1", "L0", 10], ["uwu://t/a/2", "L0", 10], ["uwu://u/a/3", "L0", 20]]
    assert greedy(rows.iloc[:1], 2000)[["level", "cost"]].values.tolist() == [["L1", 2000]] and greedy(rows.iloc[:0], 5).empty
