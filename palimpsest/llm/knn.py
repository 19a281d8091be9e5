"""The most similar vectors for every vector, by sharded robust-pruned graphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import keep
from .graph_index import BEAM, Graph

SHARD = 8_192
MOST_CELLS = 65_536
QUERIES = 131_072
SAMPLE = 4_096
SALTS = 64
NEAR_GROUPS = 8


def usable(vec: Column, dim: int) -> Column:
    """The vector as floats if it has ``dim`` finite numbers, not all zero; else null."""
    v = vec.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300))
    return F.when((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), vec.cast("array<float>"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _means(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; fewer centres where there are fewer vectors."""
    c = sample[:k].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return c


def _centers(sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two levels: the centres of each of about root ``k`` groups of the sample. Gives the group of each centre, in order, and the centres."""
    coarse = _means(sample, math.isqrt(k))
    own = np.argmax(sample @ coarse.T, axis=1)
    groups, centers = [], []
    for g in range(len(coarse)):
        inside = sample[own == g]
        if len(inside):
            c = _means(inside, max(1, round(k * len(inside) / len(sample))))
            groups += [g] * len(c)
            centers.append(c)
    return np.array(groups, np.int32), np.concatenate(centers)


def _ways(unit: np.ndarray, groups: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest centres of each vector, nearest first, out of those in its ``NEAR_GROUPS`` nearest groups."""
    names, starts = np.unique(groups, return_index=True)
    ends = np.append(starts[1:], len(groups))
    mid = np.add.reduceat(centers, starts, axis=0)
    mid /= np.maximum(np.linalg.norm(mid, axis=1, keepdims=True), 1e-30)
    order = np.argsort(-(unit @ mid.T), axis=1, kind="stable")[:, :NEAR_GROUPS]
    best, sim = np.full((len(unit), probes), -1, np.int32), np.full((len(unit), probes), -np.inf, np.float32)
    for g in range(len(names)):
        rows = np.flatnonzero((order == g).any(axis=1))
        if len(rows):
            s = np.concatenate((sim[rows], unit[rows] @ centers[starts[g] : ends[g]].T), axis=1)
            i = np.concatenate((best[rows], np.broadcast_to(np.arange(starts[g], ends[g], dtype=np.int32), (len(rows), ends[g] - starts[g]))), axis=1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            best[rows], sim[rows] = np.take_along_axis(i, top, axis=1), np.take_along_axis(s, top, axis=1)
    return best


def default_probes(shards: int) -> int:
    """Shards that a vector is searched in: twice the binary logarithm of their number, so all of up to four."""
    return min(shards, max(1, math.ceil(2 * math.log2(shards)))) if shards > 1 else 1


def _classes(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors with ``cls``, one number for equal vectors of a set, and one row per class. Different vectors that hash alike are hashed again."""
    seed = 0
    v = v.withColumn("cls", F.xxhash64("set", "vec"))
    while True:
        v = keep(v, "vectors")
        classes = keep(v.groupBy("set", "cls").agg(F.min("vec").alias("vec"), F.max("vec").alias("last")).select("set", "cls", "vec", (F.col("vec") != F.col("last")).alias("clash")), "classes")
        clash = classes.filter("clash").select("set", "cls", "clash")
        if clash.isEmpty():
            return v, classes.select("set", "cls", "vec")
        seed += 1
        v = v.join(clash, ["set", "cls"], "left").select("set", "key", "vec", F.when(F.col("clash"), F.xxhash64(F.lit(seed), "set", "vec")).otherwise(F.col("cls")).alias("cls"))


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, probes: int | None = None, beam: int = BEAM, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """The ``k`` most similar other vectors of the same set, by cosine, for every vector.

    ``vectors``: set, key, vec (array of numbers). Unusable vectors (null, other length than ``dim``, non-finite, all zero)
    and null sets or keys take no part; a key counts once, with its smallest vector.

    Equal vectors form a class with one place in the index; of a class, only its
    ``k + 1`` smallest keys can be among anyone's results, so a class of any size is dealt with row by row.
    Classes are laid out in shards of about ``shard`` (more only where there would be over ``MOST_CELLS``
    shards in all) by nearest centre. Centres are fitted in two levels, by one task a set, on a sample of
    ``SAMPLE`` classes plus four a shard, and only they come to the driver. In each shard a robust-pruned
    directed graph is built over all its vectors, and every vector is searched by beam in its own shard and the
    nearest others by centre, ``probes`` in all (by default ``default_probes``: the cost grows as n log n).
    A shard over four times the usual size is cut by hash and searched in every part; over ``queries`` queries
    to a shard are dealt out to several tasks. With ``probes`` of at least the number of shards every
    shard is searched. Similarities of what is found are exact (double
    precision), and a pair found from one end counts for both ends.

    Result: set, key, other, similarity, rank (1 to k; equal vectors by key, different
    vectors of the very same similarity by a hash). Empty input, no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("set"), F.col("key").cast("string").alias("key"), usable(F.col("vec"), dim).alias("vec")).filter("`set` is not null and key is not null and vec is not null")
    v, classes = _classes(v.groupBy("set", "key").agg(F.min("vec").alias("vec")))
    # two steps, so that the keys of a large class are never sorted in one task
    some = v.select("set", "cls", "key").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    few = some.withColumn("r", F.row_number().over(W.partitionBy("set", "cls", "salt").orderBy("key"))).filter(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(W.partitionBy("set", "cls").orderBy("key"))).filter(F.col("r") <= k + 1)
    heads = few.groupBy("set", "cls").agg(F.array_sort(F.collect_list("key")).alias("keys"))

    kind = vectors.schema["set"].dataType.simpleString()
    per = max(shard, -(-classes.count() // MOST_CELLS))
    sizes = classes.groupBy("set").agg(F.count("*").alias("n")).filter(F.col("n") > per).withColumn("parts", F.ceil(F.col("n") / per).cast("int"))

    def fit(group: pa.Table) -> pa.Table:
        cls = group.column("cls").to_numpy()
        sample = _unit(_matrix(group.column("vec"), dim))[np.argsort(cls, kind="stable")].astype(np.float32)
        groups, centers = _centers(sample, group.column("parts")[0].as_py())
        name = pa.array([group.column("set")[0].as_py()] * len(groups), group.schema.field("set").type)
        return pa.table({"set": name, "cell": pa.array(np.arange(len(groups)), pa.int32()), "part": pa.array(groups), "center": pa.FixedSizeListArray.from_arrays(pa.array(centers.ravel().astype(np.float32)), dim).cast(pa.list_(pa.float32()))})

    share = (F.lit(SAMPLE) + 4 * F.col("parts")) / F.col("n")
    sample = classes.join(F.broadcast(sizes), "set").filter(F.pmod(F.xxhash64("cls", F.lit(2)), F.lit(1 << 30)) < share * (1 << 30)).select("set", "cls", "vec", "parts")
    fitted = sample.groupBy("set").applyInArrow(fit, f"set {kind}, cell int, part int, center array<float>").toArrow()
    centers = {}
    for name in fitted.column("set").unique().to_pylist():
        one = fitted.filter(pc.equal(fitted.column("set"), pa.scalar(name, fitted.schema.field("set").type))).sort_by("cell")
        centers[name] = one.column("part").to_numpy(), _matrix(one.column("center"), dim)
    shared = spark.sparkContext.broadcast(centers)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).dictionary_encode()
            codes, unit = names.indices.to_numpy(), _unit(_matrix(b.column(2), dim)).astype(np.float32)
            ways: list = [[0]] * b.num_rows
            for code, name in enumerate(names.dictionary.to_pylist()):
                if name in shared.value:
                    parts, c = shared.value[name]
                    rows = np.flatnonzero(codes == code)
                    for r, w in zip(rows, _ways(unit[rows], parts, c, min(len(c), probes or default_probes(len(c)))).tolist()):
                        ways[r] = [x for x in w if x >= 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ways, pa.list_(pa.int32()))], ["set", "cls", "vec", "ways"])

    routed = keep(classes.mapInArrow(route, f"set {kind}, cls long, vec array<float>, ways array<int>"), "routed")
    loads = routed.select("set", F.posexplode("ways").alias("i", "cell")).groupBy("set", "cell").agg(F.sum((F.col("i") == 0).cast("long")).alias("nv"), F.count("*").alias("nq"))
    cut = loads.select("set", "cell", F.greatest(F.lit(1), F.ceil(F.col("nv") / (4 * per))).cast("int").alias("subs"), F.greatest(F.lit(1), F.ceil(F.col("nq") / queries)).cast("int").alias("turns")).filter("subs > 1 or turns > 1")
    cut = keep(cut, "cut")  # at most MOST_CELLS / 4 with parts, and one row for every ``queries`` searches
    h = F.xxhash64("cls", F.lit(1))
    cells = routed.select("set", F.posexplode("ways").alias("i", "cell"), "cls", "vec").join(F.broadcast(cut), ["set", "cell"], "left").withColumn("subs", F.coalesce("subs", F.lit(1))).withColumn("turns", F.coalesce("turns", F.lit(1)))
    # a row of its own shard is indexed in its part in every turn; every row is searched for in all parts, in one turn
    mine = (F.col("i") == 0) & (F.col("sub") == F.pmod(h, F.col("subs")))
    cells = cells.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("in_shard", mine).withColumn("turn", F.explode(F.when(mine, F.sequence(F.lit(0), F.col("turns") - 1)).otherwise(F.array(F.pmod(h, F.col("turns")).cast("int")))))
    cells = cells.select("set", "cell", "sub", "turn", "in_shard", (F.col("turn") == F.pmod(h, F.col("turns"))).alias("asks"), "cls", "vec")

    def search(group: pa.Table) -> pa.Table:
        inside, asks = group.column("in_shard").to_numpy(), group.column("asks").to_numpy()
        ids = group.column("cls").to_numpy()
        unit = _unit(_matrix(group.column("vec"), dim))
        mine = np.flatnonzero(inside)
        mine = mine[np.argsort(ids[mine])]
        out: dict = {"a": [], "b": [], "s": []}
        if len(mine):
            graph = Graph(unit[mine], beam=beam)
            # rows of the shard find themselves as well
            for rows, want in ((mine[asks[mine]], k + 1), (np.flatnonzero(~inside), k)):
                for at in range(0, len(rows), 16_384):
                    q = rows[at : at + 16_384]
                    near = graph.search(unit[q], want)[0]
                    r, c = np.nonzero(near >= 0)
                    x, y = q[r], mine[near[r, c]]
                    x, y = x[x != y], y[x != y]
                    out["a"].append(ids[x])
                    out["b"].append(ids[y])
                    out["s"].append(np.einsum("ij,ij->i", unit[x], unit[y]))
        cat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
        n = sum(map(len, out["a"]))
        return pa.table({"set": pa.array([group.column("set")[0].as_py()] * n, group.schema.field("set").type), "a": cat(out["a"], pa.int64()), "b": cat(out["b"], pa.int64()), "s": cat(out["s"], pa.float64())})

    found = keep(cells.groupBy("set", "cell", "sub", "turn").applyInArrow(search, f"set {kind}, a long, b long, s double"), "found")
    both = found.unionByName(found.select("set", F.col("b").alias("a"), F.col("a").alias("b"), "s")).groupBy("set", "a", "b").agg(F.max("s").alias("s"))
    ranked = both.withColumn("r", F.row_number().over(W.partitionBy("set", "a").orderBy(F.desc("s"), "b"))).filter(F.col("r") <= k)
    # options of each class: its own copies first, then the heads of similar classes
    own = heads.select("set", F.col("cls").alias("a"), F.lit(1.0).alias("s"), "keys")
    near = ranked.join(heads.withColumnRenamed("cls", "b"), ["set", "b"]).select("set", "a", "s", "keys")
    options = own.unionByName(near).groupBy("set", "a").agg(F.collect_list(F.struct("s", "keys")).alias("options"))
    flat = F.expr("flatten(transform(options, o -> transform(o.keys, k -> struct(-o.s as d, k as k))))")
    best = v.select("set", "key", F.col("cls").alias("a")).join(options, ["set", "a"]).select("set", "key", F.slice(F.array_sort(F.filter(flat, lambda o: o["k"] != F.col("key"))), 1, k).alias("best"))
    return best.select("set", "key", F.posexplode("best").alias("i", "o")).select("set", "key", F.col("o.k").alias("other"), (-F.col("o.d")).alias("similarity"), (F.col("i") + 1).alias("rank"))


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """Pairs (key_a < key_b) of a set of which one is among the other's nearest, with a cosine of ``least`` or more."""
    return neighbours.filter(F.col("similarity") >= least).select("set", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()
