"""Ordered folds in closed form, running budgets, buckets of similar vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vec as V
from ..scratch import keep
from .ordered import numbered, running
from .ranking import _unit_rows


def moving_average(df: DataFrame, key: str, at: Column, order: list[Column], value: Column, keep: float, start: float) -> DataFrame:
    """Last value of x' = keep x + (1-keep) v over the rows of a key in order; ``at`` is a number, ``order`` breaks its ties, newest first.

    In closed form every row weighs (1-keep) keep^(rows after it), so the fold
    is a sum; no row list is built.
    """
    r = numbered(df.withColumn("v", value.cast("double")), [key], -at, order, "_back").withColumn("after", F.col("_back") - 1)
    s = r.groupBy(key).agg(F.count("*").alias("n"), F.sum((1 - keep) * F.pow(F.lit(keep), F.col("after")) * F.col("v")).alias("s"))
    return s.select(key, "n", (F.col("s") + start * F.pow(F.lit(keep), F.col("n"))).alias("average"))


def shrinking_step(df: DataFrame, key: str, at: Column, order: list[Column], value: Column) -> DataFrame:
    """Last value of x' = x + (v - x)/sqrt(i) over the rows of a key; the first row sets it."""
    r = numbered(df.withColumn("v", value.cast("double")), [key], at, order, "i")
    stay = F.when(F.col("i") > 1, F.log(1 - 1 / F.sqrt("i"))).otherwise(0.0)
    # what comes later: all of it less what there is up to here
    r = running(r, [key], F.col("i"), [], stay, "_so_far")
    whole = r.groupBy(F.col(key).alias("_key")).agg(F.min("_so_far").alias("_whole"))
    r = r.join(whole, F.col(key).eqNullSafe(F.col("_key"))).withColumn("later", F.col("_whole") - F.col("_so_far"))
    return r.groupBy(key).agg(F.sum(F.col("v") / F.sqrt("i") * F.exp("later")).alias("estimate"))


def within_budget(df: DataFrame, key: str, at: Column, order: list[Column], cost: Column, budget: float) -> DataFrame:
    """Rows in order with their running cost and whether that stays within the budget."""
    return running(df, [key], at, order, cost, "spent").withColumn("granted", F.col("spent") <= budget)


def planes(bits: int, dim: int, table: int = 0) -> list[list[float]]:
    """Directions of one hash table by rule: every number is the splitmix64 finish of a mix of table, bit and place, mapped to [-1, 1]."""
    # fixed values: the constants of splitmix64
    golden, one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    with np.errstate(over="ignore"):
        z = np.uint64(table) * golden + np.arange(bits, dtype=np.uint64)[:, None] * one + np.arange(dim, dtype=np.uint64)[None, :] * two
        for shift, factor in ((30, one), (27, two)):
            z = (z ^ (z >> np.uint64(shift))) * factor
    z ^= z >> np.uint64(31)
    unit = (z.astype(np.float64) / 2.0**64).astype(np.float32).astype(np.float64)
    return (2 * unit - 1).tolist()



def signature(v: Column, bits: int, dim: int, table: int = 0) -> Column:
    """Bits of the signs of ``bits`` projections."""
    out = F.lit(0)
    for i, p in enumerate(planes(bits, dim, table)):
        out = out + F.when(V.dot(v, V.literal(p)) >= 0, 1 << i).otherwise(0)
    return out


def lsh_index(df: DataFrame, key: str, vec: str, tables: int, bits: int, dim: int) -> DataFrame:
    """Where each vector lies in every hash table: t, bucket, key. Vectors of another length are left out."""
    good = df.filter(F.col(key).isNotNull() & (F.size(vec) == dim))
    return good.select(key, F.posexplode(F.array(*[signature(F.col(vec), bits, dim, t) for t in range(tables)])).alias("t", "bucket")).distinct()


def lsh_query(index: DataFrame, asked: DataFrame, q: str, vec: str, key: str, tables: int, bits: int, dim: int) -> DataFrame:
    """Candidates of each query (q, key): what shares a bucket with it in some table."""
    return lsh_index(asked, q, vec, tables, bits, dim).join(index, ["t", "bucket"]).select(q, key).distinct()


def lsh_remove(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key), key, "left_anti")


def similar_vectors(df: DataFrame, key: str, vec: str, least: float, centers: int = 64, rows: int = 8_192) -> DataFrame:
    """All pairs (a < b) of a cosine of ``least`` or more: a, b, similarity. No pair is lost.

    Every vector has its home at the nearest of some centres (vectors taken by hash). Where an angle of d joins two
    vectors, the angle of one to the other's centre is at most 2 d more than to its own; so each is a guest at every centre
    within that, and meets the vectors at home there in parts of about ``rows``. Loose vectors are guests at many centres:
    the work then nears that of all pairs, as an exact join's must. Vectors of length zero, or with null or
    non-finite numbers, have no similarity; all others must have one length. A key that occurs twice counts once.
    """
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)) & F.exists(vec, lambda x: x != 0)
    v = keep(df.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).filter(F.col("k").isNotNull() & good).groupBy("k").agg(F.min("v").alias("v")), "vectors")
    n = v.count()
    share = min(1.0, 2 * centers / max(1, n))
    picked = v.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("k", F.lit(1)), "k").limit(centers).toArrow()
    c = _unit_rows(picked.column("v")) if picked.num_rows else None
    if c is None:
        c = _unit_rows(v.limit(1).toArrow().column("v"))
    reach = 2 * np.arccos(np.clip(least, -1, 1)) + 1e-9
    kind = v.schema["k"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = np.arccos(np.clip(_unit_rows(b.column(1)) @ c.T, -1, 1))
                home = angle.argmin(axis=1)
                r, at = np.nonzero(angle <= angle.min(axis=1)[:, None] + reach)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array(at, pa.int32()), pa.array(home[r] == at)], ["k", "v", "cell", "home"])

    placed = keep(v.mapInArrow(place, f"k {kind}, v array<double>, cell int, home boolean"), "placed")
    parts = placed.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("home"), 1)) / rows)).cast("int").alias("hosts"), F.greatest(F.lit(1), F.ceil(F.count("*") / rows)).cast("int").alias("guests"))
    x = placed.join(F.broadcast(parts), "cell").withColumn("h", F.pmod(F.xxhash64("k"), F.col("hosts")).cast("int")).withColumn("g", F.pmod(F.xxhash64("k"), F.col("guests")).cast("int"))
    hosts = x.filter("home").select("cell", F.col("h").alias("host"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("guest"), F.lit(True).alias("own"), "k", "v")
    guests = x.select("cell", F.explode(F.sequence(F.lit(0), F.col("hosts") - 1)).alias("host"), F.col("g").alias("guest"), F.lit(False).alias("own"), "k", "v")

    def meet(group: pa.Table) -> pa.Table:
        own = group.column("own").to_numpy()
        keys, unit = group.column("k"), _unit_rows(group.column("v"))
        mine, theirs = np.flatnonzero(own), np.flatnonzero(~own)
        i, j, s = [], [], []
        for at in range(0, len(theirs), 1024):
            some = theirs[at : at + 1024]
            near = unit[some] @ unit[mine].T
            r, q = np.nonzero(near >= least)
            i.append(some[r])
            j.append(mine[q])
            s.append(near[r, q])
        cat = lambda z, t: np.concatenate(z) if z else np.zeros(0, t)
        return pa.table({"x": keys.take(pa.array(cat(i, np.int64))), "y": keys.take(pa.array(cat(j, np.int64))), "similarity": pa.array(cat(s, np.float64))})

    met = hosts.unionByName(guests).groupBy("cell", "host", "guest").applyInArrow(meet, f"x {kind}, y {kind}, similarity double").filter("x <> y")
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("similarity").alias("similarity"))


def field_changes(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Top-level JSON fields that differ between a row and the row before it of the same key."""
    m = df.withColumn("now", F.from_json(payload, "map<string,string>"))
    m = m.withColumn("before", F.lag("now").over(W.partitionBy(key).orderBy(order))).filter("before is not null and now is not null")
    x = m.select(key, order, "now", "before", F.explode(F.array_distinct(F.concat(F.map_keys("now"), F.map_keys("before")))).alias("field"))
    x = x.select(key, order, "field", F.try_element_at("before", F.col("field")).alias("old"), F.try_element_at("now", F.col("field")).alias("new"))
    return x.filter(~F.col("old").eqNullSafe(F.col("new")))


def generations(df: DataFrame, fitness: str, cull: float = 0.22, elite: float = 0.35) -> DataFrame:
    """Fate of each row by fitness: culled at or under ``cull``, else elite among the best ``elite`` of all, else kept.

    Ranks come from counts per value, numbered over ranges of the value, so no task sorts all rows or all values.
    """
    n = df.count()
    c = df.groupBy(fitness).agg(F.count("*").alias("c")).withColumn("_all", F.lit(0))
    better = running(c, ["_all"], -F.col(fitness), [], F.col("c"), "_up").select(fitness, (F.col("_up") - F.col("c")).alias("above"))
    fate = F.when(F.col(fitness) <= cull, "cull").when(F.col("above") < F.ceil(F.lit(elite * n)), "elite").otherwise("keep")
    return df.join(better, fitness).withColumn("fate", fate)
