"""Structured queries as values, compiled to one DataFrame plan.

The order is filter, sort, limit; traversal follows the limit. Catalyst does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import scans as S
from ..operators import temporal as M


@dataclass(frozen=True)
class Find:
    scope: str | None = None
    content_type: str | None = None
    tags: tuple[str, ...] = ()
    quality: float | None = None
    valid_at: Column | None = None
    only_current: bool = False
    order: str = "natural"
    limit: int | None = None


@dataclass(frozen=True)
class Similar:
    vector: list[float]
    k: int
    where: Column | None = None


@dataclass(frozen=True)
class AsOf:
    at: Column
    scope: str | None = None


@dataclass(frozen=True)
class Traverse:
    start: Find
    hops: int = 1
    kinds: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Composite:
    """merge: union, dedup, intersect or first."""

    parts: tuple
    merge: str = "union"


def _find(q: Find, entries: DataFrame) -> DataFrame:
    c = []
    if q.content_type:
        c.append(P.type_equals(q.content_type))
    if q.tags:
        c.append(P.has_tags(*q.tags))
    if q.quality is not None:
        c.append(P.quality_above(q.quality))
    if q.valid_at is not None:
        c.append(P.valid_at(q.valid_at))
    if q.only_current:
        c.append(F.col("invalidated_by").isNull())
    out = P.where(S.by_prefix(entries, q.scope) if q.scope else entries, c)
    return R.top(out, q.limit, *R.order(q.order)) if q.limit is not None else out


def compile_query(q, entries: DataFrame, edges: DataFrame | None = None, vectors: DataFrame | None = None, versions: DataFrame | None = None) -> DataFrame:
    if isinstance(q, Find):
        return _find(q, entries)
    if isinstance(q, Similar):
        hits = S.vector_search(vectors, q.vector, q.k, q.where)
        return hits.join(entries, "uri", "left")
    if isinstance(q, AsOf):
        v = S.by_prefix(versions, q.scope) if q.scope else versions
        return M.as_of(v, q.at)
    if isinstance(q, Traverse):
        seeds = _find(q.start, entries).select(F.col("uri").alias("node"))
        return seeds.withColumn("hop", F.lit(0)) if edges is None else G.reach(edges, seeds, q.hops, q.kinds or None)
    if isinstance(q, Composite):
        parts = [compile_query(p, entries, edges, vectors, versions).select("uri", F.coalesce("quality", F.lit(0.5)).alias("relevance")) for p in q.parts]
        return {"union": R.union, "intersect": R.intersect, "first": R.first_non_empty}[q.merge](parts) if q.merge != "dedup" else R.best_of_each(R.union(parts))
    raise TypeError(f"no query: {q!r}")
