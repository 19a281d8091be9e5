import datetime as dt

from pyspark.sql import functions as F

from palimpsest.operators import orphans
from palimpsest.operators.orphans import Reference, orphan_links
from palimpsest.operators.redelivery import SeenStore, deduplicate, surplus_copies, uuid_key

U = "0a1b2c3d-0000-1111-2222-333344445555"


def t(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def refs(spark, links, targets):
    a = spark.createDataFrame(links, "id string, to string, at timestamp_ntz, key string")
    b = spark.createDataFrame(targets, "id string, at timestamp_ntz, status string")
    return [Reference("links", a, a["id"], a["to"], a["at"], b, b["id"], b["at"])]


def found(spark, links, targets):
    return {(r["row_key"], r["missing_key"], r["status"]) for r in orphan_links(refs(spark, links, targets)).collect()}


def test_absent_late_and_clean(spark):
    links = [("1", "a", t(5), ""), ("1", "a", t(7), ""), ("2", "b", t(5), ""), ("3", "c", t(5), ""), ("4", None, t(5), ""), (None, "c", t(1), ""), ("5", "b", t(9), "")]
    targets = [("a", t(5), ""), ("a", t(9), ""), ("b", t(6), ""), (None, t(1), "")]
    assert found(spark, links, targets) == {("2", "b", "late"), ("3", "c", "absent"), (None, "c", "absent")}


def test_hot_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_SHARE", 10**9)
    links = [(str(i), "hot", t(1), "") for i in range(11_000)]
    assert len(found(spark, links, [])) == 11_000


def test_no_rows(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [], [("a", t(1), "")]) == set()


def votes(spark, rows):
    return spark.createDataFrame(rows, "delivery_id bigint, replay_id string, received_at timestamp_ntz, key string")


def test_spellings(spark):
    texts = [U, U.upper(), "{" + U + "}", "urn:uuid:" + U, U.replace("-", ""), f"  {U}\t", "", "  ", None, "no uuid", U + "0"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(uuid_key(F.col("x"))).collect()]
    assert got == [U.replace("-", "")] * 6 + [None] * 5


def test_one_copy_stays(spark):
    rows = [(1, U, t(2000), "x"), (2, U.upper(), t(1), "y"), (3, U, t(1), "x"), (4, None, t(1), ""), (5, None, t(1), ""), (6, "", t(1), ""), (7, U, None, ""), (8, U[:-1] + "6", t(3), "")]
    df = votes(spark, rows)
    assert {r[0] for r in surplus_copies(df, "delivery_id", "replay_id", "received_at").collect()} == {1, 3, 7}
    kept = deduplicate(df, "delivery_id", "replay_id", "received_at")
    assert {r["delivery_id"] for r in kept.collect()} == {2, 4, 5, 6, 8} and kept.columns[-1] == "key"


def test_many_copies_over_many_buckets(spark):
    rows = [(i, U if i % 3 == 0 else f"{i:032x}", t(i * 7 % 3000), "") for i in range(3000)]
    first = min((r[2], r[0]) for r in rows if r[1] == U)[1]
    got = {r[0] for r in surplus_copies(votes(spark, rows), "delivery_id", "replay_id", "received_at").collect()}
    assert got == {r[0] for r in rows if r[1] == U} - {first}
    assert surplus_copies(votes(spark, []), "delivery_id", "replay_id", "received_at").count() == 0


def test_batches_against_a_store(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path), words=64)
    rows = [(i, None if i % 50 == 0 else f"{i % 300:032x}", t(i * 11 % 2500), "") for i in range(900)]
    seen, out = set(), set()
    for at in range(0, 900, 300):
        batch = rows[at : at + 300] + [(10_000 + at, f"{7:032x}", t(1), "")]
        got = {r[0] for r in store.add(votes(spark, batch), "delivery_id", "replay_id", "received_at").collect()}
        exp = set()
        for key in {r[1] for r in batch if r[1]}:
            copies = sorted((r for r in batch if r[1] == key), key=lambda r: (r[2], r[0]))
            exp |= {r[0] for r in copies[0 if key in seen else 1 :]}
        assert got == exp
        seen |= {r[1] for r in batch if r[1]}
        out |= got
    assert store.add(votes(spark, []), "delivery_id", "replay_id", "received_at").count() == 0 and out
