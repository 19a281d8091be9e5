"""Queries over hierarchies, references, change feeds and redelivered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changefeed import current_state
from ..operators.hierarchy import circles, descendants, hierarchy
from ..operators.orphans import Reference, orphan_links, orphan_report
from ..operators.redelivery import deduplicate, surplus_copies
from ..scratch import keep
from ..tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return circles(table(spark, d, "version_commit_parents"), "commit_id", "parent_id", "ingested_at").select(F.col("node").alias("commit_id"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "version_commit_parents"), "commit_id", "parent_id", "ordinal", "ingested_at")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(p3_hierarchy(spark, d))


def references(spark: SparkSession, d: str) -> list[Reference]:
    parents, commits = table(spark, d, "version_commit_parents"), table(spark, d, "version_commits")
    versions, entries = table(spark, d, "context_versions"), table(spark, d, "context_entries")
    return [
        Reference("version_commit_parents", parents, parents["commit_id"], parents["parent_id"], parents["ingested_at"], commits, commits["id"], commits["ingested_at"]),
        Reference("context_versions", versions, versions["mvcc_version"], versions["uri"], versions["ingested_at"], entries, entries["uri"], entries["ingested_at"]),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links = orphan_links(references(spark, d))
    return links.select("ref_table", "row_key", "missing_key", F.date_format("seen_at", "yyyy-MM").alias("period"), "status")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(references(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return current_state(table(spark, d, "version_entry_deltas")).select(F.col("key").alias("uri"), F.col("value_ref").alias("commit_id")).distinct()


def p6_state(spark: SparkSession, d: str) -> DataFrame:
    """Current entries with the payload that set them, tombstones included."""
    feed = table(spark, d, "version_entry_deltas")
    state = keep(current_state(feed, tombstones=True), "state")
    first = feed.groupBy("scope", F.col("log_pos").alias("value_seq")).agg(F.min_by("entry_json", "feed_pos").alias("entry_json"))
    same = state["scope"].eqNullSafe(first["scope"]) & (state["value_seq"] == first["value_seq"])
    return state.join(first, same, "left").select(state["scope"], F.col("key").alias("uri"), state["value_seq"], "last_seq", "present", F.col("value_ref").alias("commit_id"), "entry_json")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return surplus_copies(table(spark, d, "vote_payloads"), "delivery_id", "replay_id", "received_at")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    return deduplicate(table(spark, d, "vote_payloads"), "delivery_id", "replay_id", "received_at")


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p5_found, p5_report, p6_found, p6_state, p7_found, p7_kept)}

LINKS_SQL = """
 links AS (
  SELECT 'version_commit_parents' AS ref_table, commit_id AS row_key, parent_id AS missing_key, min(ingested_at) AS seen FROM version_commit_parents WHERE parent_id IS NOT NULL GROUP BY commit_id, parent_id
  UNION ALL
  SELECT 'context_versions', CAST(mvcc_version AS VARCHAR), uri, min(ingested_at) FROM context_versions WHERE uri IS NOT NULL GROUP BY mvcc_version, uri),
 targets AS (
  SELECT 'version_commit_parents' AS ref_table, id AS k, min(ingested_at) AS first_seen FROM version_commits WHERE id IS NOT NULL GROUP BY id
  UNION ALL
  SELECT 'context_versions', uri, min(ingested_at) FROM context_entries WHERE uri IS NOT NULL GROUP BY uri),
 found AS (
  SELECT l.ref_table, l.row_key, l.missing_key, strftime(l.seen, '%Y-%m') AS period, CASE WHEN t.k IS NULL THEN 'absent' ELSE 'late' END AS status
  FROM links l LEFT JOIN targets t ON t.ref_table = l.ref_table AND t.k = l.missing_key WHERE t.k IS NULL OR t.first_seen > l.seen)
"""

_KEYED = "SELECT delivery_id, received_at, regexp_replace(regexp_replace(regexp_replace(lower(replay_id), '^\\s*(urn:uuid:)?[{(]?', ''), '[)}]?\\s*$', ''), '-', '', 'g') AS r FROM vote_payloads"
_SURPLUS = f"SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY r ORDER BY received_at, delivery_id) AS k FROM ({_KEYED}) WHERE regexp_full_match(r, '[0-9a-f]{{32}}')) WHERE k > 1"

_FIRST_PARENT = """
 e AS (SELECT commit_id AS c, min(struct_pack(o := ordinal, p := parent_id)).p AS p FROM version_commit_parents WHERE parent_id IS NOT NULL AND commit_id IS NOT NULL GROUP BY commit_id),
 n AS (SELECT commit_id AS x FROM version_commit_parents WHERE commit_id IS NOT NULL UNION SELECT parent_id FROM version_commit_parents WHERE parent_id IS NOT NULL),
 t(node, parent, root, depth, path) AS (
  SELECT x, CAST(NULL AS VARCHAR), x, 0, [x] FROM n WHERE x NOT IN (SELECT c FROM e)
  UNION ALL SELECT e.c, e.p, t.root, t.depth + 1, list_append(t.path, e.c) FROM t JOIN e ON e.p = t.node)
"""

_TREE = f"""
 WITH RECURSIVE {_FIRST_PARENT},
 up(x, y) AS (SELECT c, p FROM e UNION SELECT up.x, e.p FROM up JOIN e ON e.c = up.y),
 ring AS (SELECT DISTINCT x FROM up WHERE x = y),
 b(node, parent, path) AS (
  SELECT c, p, [c] FROM e WHERE p IN (SELECT x FROM ring) AND c NOT IN (SELECT x FROM ring)
  UNION ALL SELECT e.c, e.p, list_append(b.path, e.c) FROM b JOIN e ON e.p = b.node),
 every AS (SELECT node, parent, root, depth, path, 'tree' AS state FROM t UNION ALL SELECT node, parent, NULL, NULL, path, 'below_circle' FROM b UNION ALL SELECT x, e.p, NULL, NULL, NULL, 'circle' FROM ring JOIN e ON e.c = x),
 below AS (SELECT a, node, i, n FROM (SELECT node, unnest(path) AS a, generate_subscripts(path, 1) AS i, len(path) AS n FROM every))
"""
# the feed replayed change by change: one list of (key, present, commit, seq of the value, seq of the last change) a scope
_FEED = """
 c AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY log_pos) AS i FROM (SELECT scope, log_pos, commit_id, uri, op, entry_json, rename_from, row_number() OVER (PARTITION BY scope, log_pos ORDER BY feed_pos) AS k FROM version_entry_deltas WHERE log_pos IS NOT NULL) WHERE k = 1 AND uri IS NOT NULL),
 f AS (SELECT *, op IN ('add', 'update') AND entry_json IS NOT NULL AS sets, op = 'delete' AS deletes, coalesce(op = 'rename' AND rename_from <> uri, false) AS moves FROM c),
 r(scope, i, st) AS (
  SELECT DISTINCT scope, 0::BIGINT, [{'k': NULL::VARCHAR, 'p': false, 'v': NULL::VARCHAR, 's': NULL::BIGINT, 'l': NULL::BIGINT}][1:0] FROM f
  UNION ALL
  SELECT r.scope, f.i, CASE
   WHEN sets THEN list_append(list_filter(st, lambda x: x.k <> f.uri), {'k': f.uri, 'p': true, 'v': f.commit_id, 's': f.log_pos, 'l': f.log_pos})
   WHEN deletes THEN list_append(list_filter(st, lambda x: x.k <> f.uri), {'k': f.uri, 'p': false, 'v': NULL::VARCHAR, 's': NULL::BIGINT, 'l': f.log_pos})
   WHEN moves THEN list_concat(list_filter(st, lambda x: x.k <> f.uri AND x.k <> f.rename_from),
    [{'k': f.rename_from, 'p': false, 'v': NULL::VARCHAR, 's': NULL::BIGINT, 'l': f.log_pos},
     CASE WHEN len(list_filter(st, lambda x: x.k = f.rename_from AND x.p)) > 0 THEN {'k': f.uri, 'p': true, 'v': list_filter(st, lambda x: x.k = f.rename_from)[1].v, 's': list_filter(st, lambda x: x.k = f.rename_from)[1].s, 'l': f.log_pos}
      WHEN len(list_filter(st, lambda x: x.k = f.uri AND x.p)) > 0 THEN {'k': f.uri, 'p': true, 'v': list_filter(st, lambda x: x.k = f.uri)[1].v, 's': list_filter(st, lambda x: x.k = f.uri)[1].s, 'l': f.log_pos}
      ELSE {'k': f.uri, 'p': false, 'v': NULL::VARCHAR, 's': NULL::BIGINT, 'l': f.log_pos} END])
   ELSE st END
  FROM r JOIN f ON f.scope IS NOT DISTINCT FROM r.scope AND f.i = r.i + 1),
 z AS (SELECT scope, unnest(st) AS x FROM (SELECT scope, arg_max(st, i) AS st FROM r GROUP BY scope))
"""

ORACLES = {
    "p3_found": """
 WITH RECURSIVE e AS (SELECT DISTINCT commit_id AS c, parent_id AS p FROM version_commit_parents WHERE parent_id IS NOT NULL),
 r(s, x) AS (SELECT c, p FROM e UNION SELECT r.s, e.p FROM r JOIN e ON e.c = r.x)
 SELECT DISTINCT s AS commit_id FROM r WHERE s = x""",
    "p3_descendants": _TREE + " SELECT a AS ancestor, node AS descendant, CAST(n - i AS INT) AS distance FROM below WHERE i < n",
    "p3_hierarchy": _TREE + " SELECT e.node, parent, root, depth::INT AS depth, path, CASE WHEN state <> 'circle' THEN (SELECT count(*) FROM below WHERE below.a = e.node) - 1 END AS n_descendants, state FROM every e",
    "p6_found": f"WITH RECURSIVE {_FEED} SELECT DISTINCT x.k AS uri, x.v AS commit_id FROM z WHERE x.p",
    "p6_state": f"WITH RECURSIVE {_FEED} SELECT z.scope, x.k AS uri, x.s AS value_seq, x.l AS last_seq, x.p AS present, x.v AS commit_id, c.entry_json FROM z LEFT JOIN c ON c.scope IS NOT DISTINCT FROM z.scope AND c.log_pos = x.s",
    "p5_found": f"WITH {LINKS_SQL} SELECT * FROM found",
    "p5_report": f"WITH {LINKS_SQL} SELECT ref_table, period, status, count(*) AS n_links, count(DISTINCT missing_key) AS n_keys FROM found GROUP BY ALL",
    "p7_found": _SURPLUS,
    "p7_kept": f"SELECT * FROM vote_payloads WHERE delivery_id NOT IN ({_SURPLUS})",
}
