import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ordered


@pytest.mark.parametrize("most", [10**6, 10])
def test_against_sorted_lists(spark, most):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + ["a", None]), r.choice([None, 1.0, 2.5] + [r.random() * 100 for _ in range(20)]), i, r.randrange(-5, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at double, id int, v int").withColumn("_clash", F.lit(1))
    args = (["g"], F.col("at"), [F.asc("id")])
    n = {x["id"]: x["n"] for x in ordered.numbered(df, *args, "n", most).collect()}
    s = {x["id"]: x["s"] for x in ordered.running(df, *args, F.col("v"), "s", most).collect()}
    p = {x["id"]: x["p"] for x in ordered.previous(df, *args, F.col("v"), "p", most).collect()}
    for g in ("hot", "a", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        total, last = 0, None
        for i, x in enumerate(mine):
            total += x[3]
            assert (n[x[2]], s[x[2]], p[x[2]]) == (i + 1, total, last)
            last = x[3]
    assert len(n) == len(s) == len(p) == 400
    assert ordered.numbered(df.limit(0), *args, "n", most).count() == 0
