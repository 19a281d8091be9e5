"""Scans and lookups over entries, and browsing by address. Pages are by key: rows behind a cursor, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uri as U
from ..functions import vec as V


def hits(df: DataFrame, relevance: float | Column) -> DataFrame:
    """Entries as hits: uri, content, relevance, content_type."""
    return df.select("uri", F.col("l0").alias("content"), (relevance if isinstance(relevance, Column) else F.lit(relevance)).alias("relevance"), "content_type")


def by_type(df: DataFrame, content_type: str, scope: Column | None = None) -> DataFrame:
    return df.filter((F.col("content_type") == content_type) & (scope if scope is not None else F.lit(True)))


def by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(U.under(F.col("uri"), prefix))


def page(df: DataFrame, key: str, after: str | None, n: int) -> DataFrame:
    """The ``n`` rows behind ``after`` by ``key``, with the next cursor (null on the last page) on every row."""
    rest = df.filter(F.col(key) > after) if after is not None else df
    more = rest.orderBy(key).limit(n + 1)
    at = more.agg(F.count("*").alias("c"), F.max_by(key, F.col(key)).alias("last"))
    kept = more.orderBy(key).limit(n)
    cursor = kept.agg(F.max(key).alias("m")).crossJoin(at).select(F.when(F.col("c") > n, F.col("m")).alias("next_cursor"))
    return kept.crossJoin(F.broadcast(cursor))


def _folder(scope: str) -> str:
    """The address with one slash behind it; without path the whole store."""
    p = scope.rstrip("/")
    return U.SCHEME if p in ("", "uwu:") else p + "/"


def children(df: DataFrame, scope: str) -> DataFrame:
    """Direct children of an address: name, is_dir, abstract (of the entry of that very address; empty for directories only)."""
    p = _folder(scope)
    rest = F.substring("uri", len(p) + 1, 1 << 20)
    c = df.filter(F.col("uri").startswith(p)).select(F.split(rest, "/")[0].alias("name"), F.contains(rest, F.lit("/")).alias("deeper"), "l0")
    return c.groupBy("name").agg(F.max("deeper").alias("is_dir"), F.coalesce(F.max(F.when(~F.col("deeper"), F.col("l0"))), F.lit("")).alias("abstract"))


def find(df: DataFrame, scope: str | None, glob: str, content_type: str | None = None) -> DataFrame:
    out = df.filter(F.element_at(F.split("uri", "/"), -1).like(U.glob_to_like(glob)))
    out = by_prefix(out, scope) if scope else out
    return out.filter(F.col("content_type") == content_type) if content_type else out


def grep(df: DataFrame, literal: str, scope: str | None = None) -> DataFrame:
    """Entries whose abstract or overview holds the literal, whatever the case, with the text that does."""
    has = lambda c: F.contains(F.lower(c), F.lit(literal.lower()))
    out = by_prefix(df, scope) if scope else df
    text = F.when(has(F.col("l0")), F.col("l0")).when(has(F.col("l1")), F.col("l1"))
    return out.withColumn("matched", text).filter(F.col("matched").isNotNull())


def tree(df: DataFrame, scope: str, depth: int) -> DataFrame:
    """All addresses below ``scope`` down to ``depth`` levels, directories included: node, level, is_entry."""
    p = _folder(scope)
    seg = F.split(F.substring("uri", len(p) + 1, 1 << 20), "/")
    below = df.filter(F.col("uri").startswith(p)).select(seg.alias("s"))
    nodes = below.select("s", F.explode(F.sequence(F.lit(1), F.least(F.size("s"), F.lit(depth)))).alias("level"))
    named = nodes.select(F.concat(F.lit(p), F.array_join(F.slice("s", F.lit(1), F.col("level")), "/")).alias("node"), "level", (F.size("s") == F.col("level")).alias("is_entry"))
    return named.groupBy("node", "level").agg(F.max("is_entry").alias("is_entry"))


def read(df: DataFrame, level: str) -> DataFrame:
    """Content at a level (L0, L1, L2); a missing level falls back to the next smaller one."""
    text = {"L0": F.col("l0"), "L1": F.coalesce("l1", "l0"), "L2": F.coalesce("l2", "l1", "l0")}[level]
    return df.select("uri", F.lit(level).alias("level"), text.alias("content"))


def read_many(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per requested uri, found or not."""
    return wanted.join(df.select("uri", "l0", F.lit(True).alias("found")), "uri", "left").select("uri", F.coalesce("found", F.lit(False)).alias("found"), "l0")


def grep_many(df: DataFrame, patterns: DataFrame, most: int = 10_000) -> DataFrame:
    """Entries by pattern; the patterns (pattern, scope) are a request, which is refused beyond ``most``."""
    if patterns.limit(most + 1).count() > most:
        raise ValueError(f"over {most} patterns")
    asked = F.broadcast(patterns)
    return df.join(asked, F.contains(F.lower("l0"), F.lower("pattern")) & (F.col("scope").isNull() | (F.col("uri") == F.col("scope")) | F.col("uri").startswith(F.concat("scope", F.lit("/"))))).select("pattern", "uri")


def vector_search(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest to one query vector; filters come before scoring, the query travels as a literal."""
    kept = vectors.filter(where) if where is not None else vectors
    return kept.withColumn("score", V.cosine(F.col("embedding"), V.literal(query))).orderBy(F.desc("score"), "uri").limit(k)
