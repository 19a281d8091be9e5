import random

from palimpsest.operators import changefeed
from palimpsest.operators.changefeed import current_state

SCHEMA = "scope string, log_pos bigint, feed_pos bigint, uri string, op string, entry_json string, rename_from string, commit_id string, last string"


def replay(rows):
    seen, state = set(), {}
    for scope, pos, _, uri, op, payload, source, commit, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if (scope, pos) in seen:
            continue
        seen.add((scope, pos))
        if uri is None:
            continue
        if op in ("add", "update") and payload is not None:
            state[scope, uri] = commit
        elif op == "delete":
            state.pop((scope, uri), None)
        elif op == "rename" and source is not None and source != uri and (scope, source) in state:
            state[scope, uri] = state.pop((scope, source))
    return {(k[0], k[1], v) for k, v in state.items()}


def run(spark, rows):
    return {(r["scope"], r["key"], r["value_ref"]) for r in current_state(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_random_feeds_against_replay(spark, monkeypatch):
    monkeypatch.setattr(changefeed, "SEGMENT", 7)
    r = random.Random(5)
    rows = []
    for scope in ("a", "b", None):
        for pos in range(150):
            op = r.choice(["add", "update", "rename", "rename", "delete", "touch"])
            rows.append((scope, pos, len(rows), f"k{r.randrange(6)}", op, None if r.random() < 0.1 else "{}", f"k{r.randrange(6)}" if op == "rename" and r.random() < 0.95 else None, f"c{scope}{pos}", "x"))
    rows += [(s, p, f + 10_000, *rest) for s, p, f, *rest in r.sample(rows, 80)]
    r.shuffle(rows)
    assert run(spark, rows) == replay(rows)


def test_long_rename_chain(spark):
    rows = [("s", 0, 0, "k0", "add", "{}", None, "c", "")] + [("s", i, i, f"k{i}", "rename", None, f"k{i - 1}", f"r{i}", "") for i in range(1, 200)]
    assert run(spark, rows) == {("s", "k199", "c")}


def test_nulls_and_empty(spark):
    assert run(spark, []) == set()
    rows = [("s", None, 1, "k", "add", "{}", None, "c", ""), ("s", 1, 2, None, "add", "{}", None, "c", ""), ("s", 2, 3, "k", None, "{}", None, "c", "")]
    assert run(spark, rows) == set()


def test_tombstones_hold_against_late_changes(spark):
    rows = [("s", 2, 1, "k", "delete", None, None, "d", ""), ("s", 1, 2, "k", "add", "{}", None, "c", "")]
    got = current_state(spark.createDataFrame(rows, SCHEMA), tombstones=True).collect()
    assert [(r["key"], r["present"], r["last_seq"]) for r in got] == [("k", False, 2)]


def test_folding_onto_a_base(spark):
    r = random.Random(9)
    rows = []
    for pos in range(240):
        op = r.choice(["add", "update", "rename", "delete"])
        rows.append(("a", pos, pos, f"k{r.randrange(8)}", op, None if r.random() < 0.1 else "{}", f"k{r.randrange(8)}" if op == "rename" else None, f"c{pos}", "x"))
    base = current_state(spark.createDataFrame(rows[:130], SCHEMA), tombstones=True)
    # the second batch repeats the end of the first
    got = current_state(spark.createDataFrame(rows[125:], SCHEMA), base=base).collect()
    assert {(x["scope"], x["key"], x["value_ref"]) for x in got} == replay(rows)
    whole = current_state(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(x["key"], x["last_seq"], x["value_seq"]) for x in got} == {(x["key"], x["last_seq"], x["value_seq"]) for x in whole}


def test_late_change_meets_a_tombstone_of_the_base(spark):
    base = current_state(spark.createDataFrame([("s", 5, 1, "k", "delete", None, None, "d", "")], SCHEMA), tombstones=True)
    assert current_state(spark.createDataFrame([("s", 1, 2, "k", "add", "{}", None, "c", "")], SCHEMA), base=base).count() == 0
