import random

import pytest

from palimpsest.operators.components import connected_components
from palimpsest.operators.hierarchy import circles, descendants, hierarchy
from palimpsest.operators.hierarchy import _spread

SCHEMA = "child string, parent string, ordinal int, seen timestamp_ntz, node string"


def frame(spark, links):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(a, b, o, t + dt.timedelta(hours=i), "clash") for i, (a, b, o) in enumerate(links)], SCHEMA)


def brute_circles(links):
    out = {}
    for a, b, _ in links:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    found = set()
    for s in out:
        seen, todo = set(), list(out[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        if s in seen:
            found.add(s)
    return found


def links_of(n, seed):
    r = random.Random(seed)
    links = [(f"n{i}", f"n{r.randrange(max(0, i - 4), i)}", 0) for i in range(1, n) if r.random() < 0.95]
    links += [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", 1) for _ in range(n // 12)]
    return links + links[:5] + [("x", None, 0), (None, "y", 0), ("self", "self", 0)]


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_circles(spark, block):
    links = links_of(120, 3)
    got = {r["node"] for r in circles(frame(spark, links), "child", "parent", "seen", block).collect()}
    assert got == brute_circles(links)


def test_spread_components(spark):
    links = links_of(60, 8)
    arcs = spark.createDataFrame([(a, b) for a, b, _ in links if a and b], "src string, dst string").distinct()
    assert {r["node"] for r in _spread(arcs).collect()} == brute_circles(links)


@pytest.mark.parametrize("block", [1_000_000, 2])
def test_paths(spark, block):
    links = [x for x in links_of(100, 4) if x[2] == 0] + [("c1", "c2", 0), ("c2", "c1", 0), ("d", "c1", 0)]
    h = {r["node"]: r for r in hierarchy(frame(spark, links), "child", "parent", "ordinal", "seen", block).collect()}
    parent = {}
    for a, b, _ in links:
        if a and b:
            parent[a] = min(parent.get(a, b), b)
    for n, r in h.items():
        path, x = [n], n
        while x in parent and parent[x] not in path:
            x = parent[x]
            path.append(x)
        if x in parent:
            assert r["state"] == ("circle" if parent[x] == n or n in ("c1", "c2", "self") else "below_circle")
        else:
            assert r["state"] == "tree" and r["path"] == path[::-1] and r["depth"] == len(path) - 1 and r["root"] == path[-1]
    assert set(h) == {x for a, b, _ in links for x in (a, b) if x}
    for n, r in h.items():
        if r["state"] == "tree":
            assert r["n_descendants"] == sum(1 for q in h.values() if q["path"] and n in q["path"][:-1])


def test_descendants(spark):
    h = hierarchy(frame(spark, [("b", "a", 0), ("c", "b", 0)]), "child", "parent", "ordinal")
    assert {tuple(r) for r in descendants(h).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


@pytest.mark.parametrize("block", [1_000_000, 2])
def test_descendants_below_a_circle(spark, block):
    links = [("c1", "c2", 0), ("c2", "c1", 0), ("d", "c1", 0), ("e", "d", 0), ("f", "e", 0), ("g", "d", 0), ("b", "a", 0)]
    h = hierarchy(frame(spark, links), "child", "parent", "ordinal", "seen", block)
    assert {tuple(r) for r in descendants(h).collect()} == {("d", "e", 1), ("d", "f", 2), ("d", "g", 1), ("e", "f", 1), ("a", "b", 1)}
    rows = {r["node"]: r for r in h.collect()}
    assert {n: (r["state"], r["parent"], r["n_descendants"]) for n, r in rows.items() if n in "defg"} == {"d": ("below_circle", "c1", 3), "e": ("below_circle", "d", 1), "f": ("below_circle", "e", 0), "g": ("below_circle", "d", 0)}
    assert rows["d"]["depth"] is None and rows["c1"]["path"] is None and rows["f"]["path"] == ["d", "e", "f"]


def test_empty(spark):
    assert hierarchy(frame(spark, []), "child", "parent").count() == 0
    assert circles(frame(spark, []), "child", "parent").count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200}
