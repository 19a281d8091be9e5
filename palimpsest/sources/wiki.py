"""Wiki pages as entries of one tenant and space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_segment(c: Column) -> Column:
    """A name that can stand between two slashes of an address."""
    return F.coalesce(~c.isin("", ".", "..") & ~c.rlike("[/?#]"), F.lit(False))


def collection(tenant: Column, space: Column) -> Column:
    """The name under which a space's vectors are kept; no two spaces share it."""
    return F.concat(F.lit("wiki__"), F.lower(F.hex(F.encode(tenant, "UTF-8"))), F.lit("__"), F.lower(F.hex(F.encode(space, "UTF-8"))))


def bound_pages(pages: DataFrame) -> DataFrame:
    """Pages (tenant, space, id, text) as entries of their space: uri, tenant, space, collection, l0.

    ``id`` must be an address below ``uwu://tenant/wiki/space/``; pages with another one, or with a name that cannot stand
    in an address, are left out.
    """
    seg = F.split(F.substring("id", 7, 1 << 20), "/")
    own = F.startswith(F.col("id"), F.lit("uwu://")) & (F.get(seg, F.lit(0)) == F.col("tenant")) & (F.get(seg, F.lit(1)) == "wiki") & (F.get(seg, F.lit(2)) == F.col("space")) & (F.coalesce(F.get(seg, F.lit(3)), F.lit("")) != "")
    return pages.filter(valid_segment(F.col("tenant")) & valid_segment(F.col("space")) & own).select(F.col("id").alias("uri"), "tenant", "space", collection(F.col("tenant"), F.col("space")).alias("collection"), F.col("text").alias("l0"))
