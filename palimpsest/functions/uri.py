"""Addresses ``uwu://tenant/segment/...?as_of=...&level=...`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "uwu://"
# fixed values: the categories an address may fall into
CATEGORIES = ("agent", "user", "team", "session", "resource", "skill", "memory", "shared", "system", "archive")


def is_valid(uri: Column) -> Column:
    return F.coalesce(uri.rlike(r"^uwu://[^/?#\s][^?#\s]*"), F.lit(False))


def without_query(uri: Column) -> Column:
    return F.regexp_replace(uri, r"\?.*$", "")


def segments(uri: Column) -> Column:
    """Path segments behind the scheme, tenant first."""
    return F.filter(F.split(F.substring(without_query(uri), len(SCHEME) + 1, 1 << 20), "/"), lambda s: s != "")


def tenant(uri: Column) -> Column:
    return F.get(segments(uri), F.lit(0))


def depth(uri: Column) -> Column:
    return F.size(segments(uri)) - 1


def leaf(uri: Column) -> Column:
    return F.element_at(segments(uri), -1)


def parent(uri: Column) -> Column:
    """The address one segment up; null at the tenant."""
    s = segments(uri)
    return F.when(F.size(s) > 1, F.concat(F.lit(SCHEME), F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), "/")))


def join(uri: Column, child: Column) -> Column:
    return F.concat(F.regexp_replace(without_query(uri), "/+$", ""), F.lit("/"), F.regexp_replace(child, "^/+", ""))


def category(uri: Column) -> Column:
    second = F.get(segments(uri), F.lit(1))
    return F.when(second.isin(*CATEGORIES), second).otherwise("other")


def query_params(uri: Column) -> Column:
    """Query part as a map; empty without one."""
    q = F.regexp_extract(uri, r"\?(.*)$", 1)
    return F.when(q == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(q, F.lit("&"), F.lit("=")))


def under(uri: Column, prefix: str) -> Column:
    """The prefix itself or anything below it."""
    p = prefix.rstrip("/")
    return (uri == p) | uri.startswith(p + "/")


def in_agent(uri: Column, agent: str) -> Column:
    return F.contains(F.concat(uri, F.lit("/")), F.lit(f"/agent/{agent}/"))


def glob_to_like(pattern: str) -> str:
    """``*`` and ``?`` to LIKE's ``%`` and ``_``; LIKE's own characters are escaped."""
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}.get(c, c) for c in pattern)
