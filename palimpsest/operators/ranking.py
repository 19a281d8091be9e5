"""Order, limits, merges of ranked results, joins by key."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import keep

QUERY_BLOCK = 16_384
DATA_ROWS = 32_768


def order(by: str) -> list[Column]:
    """Sort keys, always descending, ties by uri."""
    keys = {
        "relevance": [F.desc("relevance")],
        "recency": [F.coalesce("updated_at", "created_at").desc_nulls_last()],
        "quality": [F.col("quality").desc_nulls_last()],
        "natural": [],
    }
    return [*keys[by], F.asc("uri")]


def top(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    return df.orderBy(*keys).limit(k)


def union(children: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), children)


def best_of_each(df: DataFrame) -> DataFrame:
    """One hit per uri, the one of highest relevance; by aggregation, so a repeated uri is combined before the shuffle."""
    rest = [c for c in df.columns if c != "uri"]
    return df.groupBy("uri").agg(F.max_by(F.struct(*rest), F.col("relevance")).alias("h")).select("uri", "h.*")


def intersect(children: list[DataFrame]) -> DataFrame:
    """Hits present in every child, at their best score; a uri counts once per child."""
    tagged = union([c.select("uri", "relevance", F.lit(i).alias("child")) for i, c in enumerate(children)])
    return tagged.groupBy("uri").agg(F.max("relevance").alias("relevance"), F.countDistinct("child").alias("n")).filter(F.col("n") == len(children)).drop("n")


def first_non_empty(children: list[DataFrame]) -> DataFrame:
    tagged = union([c.withColumn("child", F.lit(i)) for i, c in enumerate(children)])
    least = tagged.agg(F.min("child").alias("m"))
    return tagged.join(F.broadcast(least), F.col("child") == F.col("m")).drop("child", "m")


def equi_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of hits with equal key: uri, tenant or the hash of the full text."""
    of = {"uri": F.col("uri"), "tenant": F.col("tenant"), "content": F.sha2("l2", 256)}[key]
    a = left.select(of.alias("k"), F.col("uri").alias("uri_left"))
    b = right.select(of.alias("k"), F.col("uri").alias("uri_right"))
    return a.join(b, "k")


def learned_score(semantic: Column, uri: Column, qtype: Column, explore: Column) -> Column:
    return 0.58 * semantic + 0.24 * uri + 0.14 * qtype + 0.04 * explore


def hybrid_score(relevance: Column, age_days: Column, type_weight: Column, quality: Column) -> Column:
    return 0.4 * relevance + 0.3 * F.exp(-age_days / 30) + 0.3 * type_weight * quality


def federated_top(hits: DataFrame, k: int) -> DataFrame:
    """Best copy of each uri by weighted score, then the k best."""
    s = hits.withColumn("score", 0.35 * F.col("noisy") + 0.20 * F.col("quality") + 0.15 * F.col("reputation") + 0.15 * F.col("corroboration") + 0.10 * F.col("lineage") + 0.05 * F.col("licence"))
    one = s.groupBy("uri").agg(F.max("score").alias("score"))
    return one.orderBy(F.desc("score"), "uri").limit(k)


def per_group(df: DataFrame, group: list[str], keys: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*keys))).filter(F.col("rank") <= k)


def _unit_rows(vec: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length one; rows of length zero stay so."""
    flat = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    if not len(flat):
        return np.zeros((0, 0))
    v = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _blocks(df: DataFrame, key: str, rows: int) -> Iterator[pa.Table]:
    """All rows, about ``rows`` at a time."""
    n = max(1, -(-df.count() // rows))
    for b in range(n):
        yield df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b).toArrow()


def nearest_in_blocks(asked: DataFrame, df: DataFrame, q: str, q_vec: str, key: str, vec: str, k: int, digits: int) -> DataFrame:
    """The ``k`` rows of highest cosine (rounded; ties by key) for every row of a stated query set, itself excepted: q, key, score.

    Queries go out in blocks of ``QUERY_BLOCK``, and every block is one pass over the rows, which stay where they are and
    send their best. All vectors must have one length; rows without vector are left out.
    """
    has = lambda d, c: d.filter(F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()))
    asked, df = has(asked, q_vec).select(q, q_vec), has(df, vec).select(key, vec)
    spark, parts = df.sparkSession, []
    kinds = f"`{q}` {asked.schema[q].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, score double"
    for block in _blocks(asked, q, QUERY_BLOCK):
        sent = spark.sparkContext.broadcast((block.column(0).combine_chunks(), _unit_rows(block.column(1))))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, units = sent.value
            for b in batches:
                for at in range(0, b.num_rows, DATA_ROWS):
                    some = b.slice(at, DATA_ROWS)
                    rows = _unit_rows(some.column(1))
                    for start in range(0, len(units), 512):
                        s = np.round(units[start : start + 512] @ rows.T, digits)
                        width = min(k + 1, s.shape[1])
                        least = np.partition(s, s.shape[1] - width, axis=1)[:, s.shape[1] - width]
                        r, c = np.nonzero(s >= least[:, None])
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(r + start)), some.column(0).take(pa.array(c)), pa.array(s[r, c])], [q, key, "score"])

        parts.append(keep(df.mapInArrow(best, kinds).filter(F.col(q) != F.col(key)), "near"))
    return per_group(union(parts), [q], [F.desc("score"), F.asc(key)], k).select(q, key, "score")


def highest_in_blocks(df: DataFrame, known: DataFrame, key: str, vec: str, known_key: str, known_vec: str) -> DataFrame:
    """Highest cosine of every row to a known one: key, similarity. Known rows go out in blocks of ``QUERY_BLOCK``, each in one pass over the rows."""
    has = lambda d, c: d.filter(F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()))
    df, known = has(df, vec).select(key, vec), has(known, known_vec).select(known_key, known_vec)
    parts = []
    for block in _blocks(known, known_key, QUERY_BLOCK):
        sent = df.sparkSession.sparkContext.broadcast(_unit_rows(block.column(1)))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    some = b.slice(at, 1024)
                    if len(sent.value):
                        yield pa.RecordBatch.from_arrays([some.column(0), pa.array((_unit_rows(some.column(1)) @ sent.value.T).max(axis=1))], [key, "similarity"])

        parts.append(df.mapInArrow(best, f"`{key}` {df.schema[key].dataType.simpleString()}, similarity double"))
    return union(parts).groupBy(key).agg(F.max("similarity").alias("similarity"))
