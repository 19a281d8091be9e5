"""Views over the input tables that the operators run on, and the same views in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table

NOW = "2025-01-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Current entries, one per uri, with tags, quality and validity."""
    cols = ["tenant_id", "l0_abstract", "l1_overview", "l2_full_text", "content_type", "state_scope", "tags_json", "mvcc_version", "created_at", "updated_at"]
    one = table(spark, d, "context_entries").groupBy("uri").agg(F.max_by(F.struct(*cols), F.struct("mvcc_version", "updated_at")).alias("e")).select("uri", "e.*")
    seg = F.split("uri", "/")
    v = F.col("mvcc_version")
    return one.select(
        "uri",
        F.get(seg, F.lit(2)).alias("tenant"),
        F.get(seg, F.lit(4)).alias("agent"),
        "content_type",
        "state_scope",
        F.from_json("tags_json", "array<string>").alias("tags"),
        F.col("l0_abstract").alias("l0"),
        F.col("l1_overview").alias("l1"),
        F.col("l2_full_text").alias("l2"),
        F.when(F.col("l1_overview").isNotNull(), (F.length("l0_abstract") % 96 + 4) / 100).alias("quality"),
        "mvcc_version",
        "created_at",
        "updated_at",
        F.col("created_at").alias("valid_from"),
        F.when(v % 3 == 0, F.col("created_at") + F.expr("interval 90 days")).alias("valid_until"),
        F.when(v % 5 == 0, F.concat("uri", F.lit("/newer"))).alias("invalidated_by"),
    )


FX = f"""fx AS (
 SELECT uri, split_part(uri, '/', 3) AS tenant, split_part(uri, '/', 5) AS agent, content_type, state_scope, from_json(tags_json, '["VARCHAR"]') AS tags,
  l0_abstract AS l0, l1_overview AS l1, l2_full_text AS l2, CASE WHEN l1_overview IS NOT NULL THEN (length(l0_abstract) % 96 + 4) / 100.0e0 END AS quality,
  mvcc_version, created_at, updated_at, created_at AS valid_from, CASE WHEN mvcc_version % 3 = 0 THEN created_at + INTERVAL 90 DAY END AS valid_until,
  CASE WHEN mvcc_version % 5 = 0 THEN uri || '/newer' END AS invalidated_by
 FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY mvcc_version DESC, updated_at DESC) AS k FROM context_entries) WHERE k = 1),
 t0 AS (SELECT TIMESTAMP '{NOW}' AS t)"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Entries, and of each whose first sentence holds can, must or should that sentence with the opposite, of another quality."""
    e = entries(spark, d).select("uri", "tenant", "agent", "content_type", "l0", "quality", "mvcc_version", "valid_until", F.col("tags").alias("evidence"))
    turned = F.split("l0", r"[.] ", 2)[0]
    for word, other in (("can", "cannot"), ("must", "must not"), ("should", "should not")):
        turned = F.replace(turned, F.lit(f" {word} "), F.lit(f" {other} "))
    r = e.withColumn("r", turned).filter(F.col("r") != F.split("l0", r"[.] ", 2)[0])
    revised = r.select(F.concat("uri", F.lit("/revised")).alias("uri"), "tenant", "agent", "content_type", F.col("r").alias("l0"), (1 - F.col("quality")).alias("quality"), (F.col("mvcc_version") + 1).alias("mvcc_version"), "valid_until", "evidence")
    return e.unionByName(revised)


CLX = f"""{FX}, cr AS (SELECT *, split_part(l0, '. ', 1) AS f FROM fx),
 cl AS (SELECT uri, tenant, agent, content_type, l0, quality, mvcc_version, valid_until, tags AS evidence FROM fx
  UNION ALL SELECT uri || '/revised', tenant, agent, content_type, replace(replace(replace(f, ' can ', ' cannot '), ' must ', ' must not '), ' should ', ' should not '), 1 - quality, mvcc_version + 1, valid_until, tags
  FROM cr WHERE contains(f, ' can ') OR contains(f, ' must ') OR contains(f, ' should '))"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct versions: uri, version, tx (when it was written), valid_from, valid_until (the 10 days after every third)."""
    v = table(spark, d, "context_versions").groupBy("uri", "mvcc_version").agg(F.min_by(F.struct("l0_abstract", "content_type", "created_at", "ingested_at"), "ingested_at").alias("v"))
    return v.select("uri", F.col("mvcc_version").alias("version"), F.col("v.l0_abstract").alias("l0"), F.col("v.content_type").alias("content_type"), F.col("v.ingested_at").alias("tx"), F.col("v.created_at").alias("valid_from"), F.when(F.col("mvcc_version") % 3 == 0, F.col("v.created_at") + F.expr("interval 10 days")).alias("valid_until"))


VX = """vx AS (
 SELECT uri, mvcc_version AS version, l0_abstract AS l0, content_type, ingested_at AS tx, created_at AS valid_from, CASE WHEN mvcc_version % 3 = 0 THEN created_at + INTERVAL 10 DAY END AS valid_until
 FROM (SELECT *, row_number() OVER (PARTITION BY uri, mvcc_version ORDER BY ingested_at) AS k FROM context_versions) WHERE k = 1)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges: from, to, kind."""
    p = table(spark, d, "version_commit_parents").filter("commit_id is not null and parent_id is not null")
    return p.select(F.col("commit_id").alias("from"), F.col("parent_id").alias("to"), F.when(F.col("ordinal") == 0, "derived_from").otherwise("merges").alias("kind")).distinct()


EX = """ex AS (SELECT DISTINCT commit_id AS f, parent_id AS t, CASE WHEN ordinal = 0 THEN 'derived_from' ELSE 'merges' END AS kind FROM version_commit_parents WHERE commit_id IS NOT NULL AND parent_id IS NOT NULL)"""


def commits(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "version_commits")
    return c.groupBy("id").agg(F.min_by(F.struct("scope", "message", "committed_at", "metadata_json", "author_json"), "ingested_at").alias("c")).select("id", "c.*")


CX = """cx AS (SELECT id, scope, message, committed_at, metadata_json, author_json FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS k FROM version_commits) WHERE k = 1)"""


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """Changes once each, in the form of the first arrival."""
    c = table(spark, d, "version_entry_deltas")
    rest = ["feed_pos", "received_at", "commit_id", "uri", "op", "entry_json", "rename_from"]
    return c.groupBy("scope", "log_pos").agg(F.min_by(F.struct(*rest), "feed_pos").alias("x")).select("scope", "log_pos", "x.*")


DX = """dx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, log_pos ORDER BY feed_pos) AS k FROM version_entry_deltas) WHERE k = 1)"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Latest vote of each voter on each entry."""
    v = table(spark, d, "vote_payloads")
    return v.groupBy("entry_id", "voter").agg(F.max_by("op", F.struct("voted_at", "delivery_id")).alias("op"), F.max(F.struct("voted_at", "delivery_id"))["voted_at"].alias("voted_at"))


OX = """ox AS (SELECT entry_id, voter, op, voted_at FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, voter ORDER BY voted_at DESC, delivery_id DESC) AS k FROM vote_payloads) WHERE k = 1)"""


class Catalog:
    """Collects queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def __call__(self, sql: str | None = None, views: str = FX):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                text = sql.strip()
                if text[:4].upper() == "WITH":
                    self.oracles[f.__name__] = text
                elif text.startswith("+"):
                    self.oracles[f.__name__] = f"WITH RECURSIVE {views}, {text[1:]}"
                else:
                    self.oracles[f.__name__] = f"WITH {views} {text}" if views else text
            return f

        return add
