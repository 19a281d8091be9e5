"""Graphs and versions as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import versioning as V
from ..operators.components import connected_components
from ..operators.ordered import micros, numbered, previous
from .fixtures import CX, DX, EX, VX, Catalog, commits, deltas, edges, entries, versions

query = Catalog()
SEEDS = f"{EX}, {CX}, s AS (SELECT arg_max(id, (committed_at, id)) AS node FROM cx GROUP BY scope)"
ALL = f"{EX}, s AS (SELECT f AS node FROM ex UNION SELECT t FROM ex)"


def _seeds(s, d):
    """The newest commit of every scope."""
    return V.heads(commits(s, d)).select(F.col("head").alias("node"))


def _every(s, d):
    return edges(s, d).select(F.explode(F.array("from", "to")).alias("node")).distinct()


@query('SELECT DISTINCT f AS "from", t AS "to" FROM ex WHERE f IN (SELECT node FROM s) AND kind = \'derived_from\'', ALL)
def g_out(s, d):
    return G.outgoing(edges(s, d), _every(s, d), "derived_from")


@query('SELECT DISTINCT f AS "from", t AS "to" FROM ex WHERE t IN (SELECT node FROM s)', ALL)
def g_in(s, d):
    return G.incoming(edges(s, d), _every(s, d))


@query('SELECT f AS "from", t AS "to", kind FROM ex', EX)
def g_edge_mut(s, d):
    e = edges(s, d)
    return e.unionByName(e.filter("kind = 'merges'")).dropDuplicates(["from", "to", "kind"])


@query("SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, least(1.0e0, sum(o + i) / 16.0e0) AS degree FROM (SELECT f AS node, 1 AS o, 0 AS i FROM ex UNION ALL SELECT t, 0, 1 FROM ex) GROUP BY node", EX)
def g_degree(s, d):
    return G.degrees(edges(s, d))


_REACH = "+ r(node, hop) AS (SELECT node, 0 FROM s UNION SELECT ex.t, r.hop + 1 FROM r JOIN ex ON ex.f = r.node WHERE r.hop < {h}), m AS (SELECT node, min(hop)::INT AS hop FROM r GROUP BY node)"


@query(_REACH.format(h=3) + " SELECT node, hop FROM m", SEEDS)
def g_traverse(s, d):
    return G.reach(edges(s, d), _seeds(s, d), 3)


@query(_REACH.format(h=2) + ' SELECT DISTINCT f AS "from", t AS "to", kind FROM ex JOIN m ON m.node = ex.f', SEEDS)
def g_batch(s, d):
    return G.within(edges(s, d), _seeds(s, d), 3)


@query("+ u AS (SELECT f AS a, t AS b FROM ex UNION SELECT t, f FROM ex), r(node, hop) AS (SELECT node, 0 FROM s UNION SELECT u.b, r.hop + 1 FROM r JOIN u ON u.a = r.node WHERE r.hop < 2) SELECT node, min(hop)::INT AS hop FROM r GROUP BY node", SEEDS)
def g_expand(s, d):
    return G.reach(edges(s, d), _seeds(s, d), 2, undirected=True)


@query(_REACH.format(h=5) + " SELECT node, hop FROM m WHERE hop > 0", SEEDS)
def g_downstream(s, d):
    return G.reach(edges(s, d), _seeds(s, d), 5).filter("hop > 0")


@query(_REACH.format(h="(SELECT count(*) FROM ex)").replace("JOIN ex ON", "JOIN (SELECT * FROM ex WHERE kind = 'derived_from') ex ON") + " SELECT node, hop FROM m", SEEDS)
def g_lineage(s, d):
    return G.reach(edges(s, d), _seeds(s, d), None, ["derived_from"])


query.queries["v_log"], query.oracles["v_log"] = g_lineage, query.oracles["g_lineage"]


SUB = f"{EX}, u AS (SELECT f AS a, t AS b FROM ex UNION SELECT t, f FROM ex)"


@query("+ r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y) SELECT x AS node, least(x, min(y)) AS component FROM r GROUP BY x", SUB)
def g_community(s, d):
    return connected_components(edges(s, d), "from", "to")


def _rank_sql(rounds: int) -> str:
    steps = [f"{EX}, a AS (SELECT DISTINCT f, t FROM ex), o AS (SELECT f, count(*) AS c FROM a GROUP BY f), n AS (SELECT f AS x FROM a UNION SELECT t FROM a), k AS (SELECT count(*) AS n FROM n), r0 AS MATERIALIZED (SELECT x, 1.0e0 / (SELECT n FROM k) AS r, c FROM n LEFT JOIN o ON o.f = n.x)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT p.x, (0.15e0 + 0.85e0 * coalesce((SELECT sum(r) FROM r{i} WHERE c IS NULL), 0)) / (SELECT n FROM k) + 0.85e0 * coalesce(g.s, 0) AS r, p.c FROM r{i} p LEFT JOIN (SELECT a.t, sum(q.r / q.c) AS s FROM a JOIN r{i} q ON q.x = a.f GROUP BY a.t) g ON g.t = p.x)")
    return ", ".join(steps)


@query(f"WITH {_rank_sql(32)} SELECT x AS node, round(r * (SELECT n FROM k), 6) AS rank FROM r32")
def g_pagerank(s, d):
    r = G.pagerank(edges(s, d), 32)
    return r.select("node", F.round(F.col("rank") * r.count(), 6).alias("rank"))


def g_pagerank_inc(s, d):
    """Warm start from the ranks without the merge edges."""
    e = edges(s, d)
    old = G.pagerank(e.filter("kind = 'derived_from'"), 32)
    r = G.pagerank(e, 32, start=old)
    return r.select("node", F.round(F.col("rank") * r.count(), 5).alias("rank"))


_WARM = (
    "da AS (SELECT DISTINCT f, t FROM ex WHERE kind = 'derived_from'), do_ AS (SELECT f, count(*) AS c FROM da GROUP BY f), dn AS (SELECT f AS x FROM da UNION SELECT t FROM da), dk AS (SELECT count(*) AS n FROM dn), d0 AS MATERIALIZED (SELECT x, 1.0e0 / (SELECT n FROM dk) AS r, c FROM dn LEFT JOIN do_ ON do_.f = dn.x), "
    + ", ".join(f"d{i + 1} AS MATERIALIZED (SELECT p.x, (0.15e0 + 0.85e0 * coalesce((SELECT sum(r) FROM d{i} WHERE c IS NULL), 0)) / (SELECT n FROM dk) + 0.85e0 * coalesce(g.s, 0) AS r, p.c FROM d{i} p LEFT JOIN (SELECT da.t, sum(q.r / q.c) AS s FROM da JOIN d{i} q ON q.x = da.f GROUP BY da.t) g ON g.t = p.x)" for i in range(32))
)
_COLD = "SELECT x, 1.0e0 / (SELECT n FROM k) AS r, c FROM n LEFT JOIN o ON o.f = n.x"
query(
    "+ " + _rank_sql(32).removeprefix(f"{EX}, ").replace(_COLD, "SELECT n.x, coalesce(d32.r, 1.0e0 / (SELECT n FROM k)) AS r, o.c FROM n LEFT JOIN o ON o.f = n.x LEFT JOIN d32 ON d32.x = n.x") + " SELECT x AS node, round(r * (SELECT n FROM k), 5) AS rank FROM r32",
    f"{EX}, {_WARM}",
)(g_pagerank_inc)


@query(f"WITH {_rank_sql(32)}, g AS (SELECT node, sum(c) AS deg FROM (SELECT f AS node, count(*) AS c FROM ex GROUP BY f UNION ALL SELECT t, count(*) FROM ex GROUP BY t) GROUP BY node) SELECT x AS node, round(0.72 * r * (SELECT n FROM k) + 0.28 * least(deg / 12, 1.0), 5) AS score FROM r32 JOIN g ON g.node = x")
def g_noderank(s, d):
    e = edges(s, d)
    r = G.pagerank(e, 32)
    n = r.count()
    return r.join(G.degrees(e), "node").select("node", F.round(G.node_score(F.col("rank") * n, F.col("n_in") + F.col("n_out")), 5).alias("score"))


@query('+ n AS (SELECT DISTINCT f, t FROM ex WHERE f IN (SELECT node FROM s)), k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY t) AS i FROM n) SELECT f AS "from", t AS "to", pow(0.5, i - 1) AS weight FROM k WHERE i <= 2', ALL)
def g_assoc(s, d):
    return G.associates(edges(s, d), _every(s, d))


@query('SELECT f AS "from", list_sort(list(DISTINCT t)) AS neighbours FROM ex GROUP BY f', EX)
def g_relations(s, d):
    return edges(s, d).groupBy("from").agg(F.array_sort(F.collect_set("to")).alias("neighbours"))


@query("+ c AS (SELECT tenant, content_type, count(*) AS c FROM fx GROUP BY ALL), t AS (SELECT tenant, sum(c) AS t FROM c GROUP BY tenant) SELECT x.tenant AS a, y.tenant AS b, round(2 * sum(least(x.c, y.c)) / (any_value(tx.t) + any_value(ty.t)), 6) AS weight FROM c x JOIN c y ON x.content_type = y.content_type AND x.tenant < y.tenant JOIN t tx ON tx.tenant = x.tenant JOIN t ty ON ty.tenant = y.tenant GROUP BY x.tenant, y.tenant")
def g_dice(s, d):
    return G.shared_weight(entries(s, d), "tenant", "content_type").withColumn("weight", F.round("weight", 6))


@query("+ c AS (SELECT t AS node, count(*) AS citations FROM ex GROUP BY t) SELECT node, citations, round(citations / (citations + 5), 6) AS bridge_score FROM c", EX)
def g_influence(s, d):
    c = edges(s, d).groupBy(F.col("to").alias("node")).agg(F.count("*").alias("citations"))
    return c.withColumn("bridge_score", F.round(F.col("citations") / (F.col("citations") + 5), 6))


@query("+ c AS (SELECT t AS node, count(*) AS n FROM ex GROUP BY t) SELECT node FROM c WHERE n / (n + 5) > 0.35", EX)
def g_risky(s, d):
    return g_influence(s, d).filter("citations / (citations + 5) > 0.35").select("node")


@query("+ k AS (SELECT id FROM cx) SELECT t AS node, count(*) AS n, round(least(0.95, greatest(0.05, 0.25 + 0.35 * 0.5 + least(0.08 * count(*), 0.3))), 6) AS difficulty FROM ex WHERE f IN (SELECT id FROM k) AND t NOT IN (SELECT id FROM k) GROUP BY t", f"{EX}, {CX}")
def g_frontier(s, d):
    k = commits(s, d).select("id")
    e = edges(s, d).join(k.withColumnRenamed("id", "from"), "from", "left_semi").join(k.withColumnRenamed("id", "to"), "to", "left_anti")
    g = e.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("n"))
    return g.withColumn("difficulty", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), 0.25 + 0.35 * 0.5 + F.least(0.08 * F.col("n"), F.lit(0.3)))), 6))


@query(_REACH.format(h=3) + " SELECT node, hop, CASE WHEN hop = 1 THEN 'Invalidate' ELSE 'Review' END AS action FROM m WHERE hop > 0", SEEDS)
def g_cascade(s, d):
    return G.reach(edges(s, d), _seeds(s, d), 3).filter("hop > 0").withColumn("action", F.when(F.col("hop") == 1, "Invalidate").otherwise("Review"))


@query("SELECT tenant, array_to_string(list(substr(l0, 1, 30) ORDER BY uri)[1:3], ' | ') AS summary FROM fx GROUP BY tenant")
def g_evidence(s, d):
    r = entries(s, d).withColumn("i", F.row_number().over(W.partitionBy("tenant").orderBy("uri"))).filter("i <= 3")
    return r.groupBy("tenant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.substring("l0", 1, 30).alias("x")))), lambda e: e["x"]), " | ").alias("summary"))


@query("SELECT tenant AS community, count(*) AS n FROM fx GROUP BY tenant UNION ALL SELECT '(root)', count(*) FROM fx")
def g_hierarchy(s, d):
    c = entries(s, d).groupBy(F.col("tenant").alias("community")).agg(F.count("*").alias("n"))
    return c.unionByName(c.agg(F.lit("(root)").alias("community"), F.sum("n").alias("n")))


@query("+ c AS (SELECT tenant, count(*) FILTER (contains(lower(l0), 'index')) / count(*) AS overlap, avg(coalesce(quality, 0.5)) AS q FROM fx GROUP BY tenant) SELECT tenant, round(0.72 * overlap + 0.2 * q, 6) AS score FROM c ORDER BY round(0.72 * overlap + 0.2 * q, 6) DESC, tenant LIMIT 8")
def g_rank_comm(s, d):
    c = entries(s, d).groupBy("tenant").agg((F.count(F.when(F.contains(F.lower("l0"), F.lit("index")), 1)) / F.count("*")).alias("o"), F.avg(F.coalesce("quality", F.lit(0.5))).alias("q"))
    return c.select("tenant", F.round(0.72 * F.col("o") + 0.2 * F.col("q"), 6).alias("score")).orderBy(F.desc("score"), "tenant").limit(8)


@query("+ k AS (SELECT tenant, uri, row_number() OVER (PARTITION BY tenant ORDER BY round(coalesce(quality, 0.5) + 0.2 * contains(lower(l0), 'index')::INT, 6) DESC, uri) AS i FROM fx) SELECT tenant, uri, i::INT AS rank FROM k WHERE i <= 3")
def g_rank_nodes(s, d):
    e = entries(s, d).withColumn("sc", F.round(F.coalesce("quality", F.lit(0.5)) + 0.2 * F.contains(F.lower("l0"), F.lit("index")).cast("int"), 6))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("tenant").orderBy(F.desc("sc"), "uri"))).filter("rank <= 3").select("tenant", "uri", "rank")


# versions


def _chain(s, d):
    """Commits of each scope by age, newest first."""
    c = numbered(commits(s, d).select("scope", "id", "committed_at"), ["scope"], -micros(F.col("committed_at")), [F.desc("id")], "n")
    return c.select(F.col("id").alias("commit_id"), (F.col("n") - 1).alias("depth"))


CHAIN = f"{CX}, {DX}, ch AS (SELECT id AS commit_id, row_number() OVER (PARTITION BY scope ORDER BY committed_at DESC, id DESC) - 1 AS depth FROM cx), ev AS (SELECT commit_id, log_pos, uri, op FROM dx WHERE op IN ('add','update','delete','rename') UNION ALL SELECT commit_id, log_pos, rename_from, 'delete' FROM dx WHERE op = 'rename' AND rename_from IS NOT NULL)"
_SNAP = "sn{x} AS (SELECT uri, commit_id FROM (SELECT ev.*, row_number() OVER (PARTITION BY uri ORDER BY depth, log_pos DESC, commit_id DESC, op DESC) AS k FROM ev JOIN ch USING (commit_id) WHERE depth >= {x}) WHERE k = 1 AND op <> 'delete')"


def _snap(s, d, back=0):
    return V.snapshot(deltas(s, d), _chain(s, d).filter(F.col("depth") >= back))


@query(f"+ {_SNAP.format(x=0)} SELECT uri, commit_id FROM sn0", CHAIN)
def v_snapshot(s, d):
    return _snap(s, d)


@query("SELECT uri, arg_max(op, log_pos) AS op FROM dx WHERE op IN ('add','update','delete') GROUP BY uri, scope", DX)
def v_apply(s, d):
    return deltas(s, d).filter("op in ('add','update','delete')").groupBy("uri", "scope").agg(F.max_by("op", "log_pos").alias("op")).select("uri", "op")


@query(f"+ {_SNAP.format(x=2)} SELECT uri, commit_id FROM sn2", CHAIN)
def v_readat(s, d):
    return _snap(s, d, 2)


@query("SELECT scope, arg_max(id, (committed_at, id)) AS commit FROM cx WHERE committed_at <= TIMESTAMP '2024-07-01' GROUP BY scope", CX)
def v_asof(s, d):
    return V.heads(commits(s, d).filter(F.col("committed_at") <= F.lit("2024-07-01").cast("timestamp_ntz"))).withColumnRenamed("head", "commit")


_DIFF = f"+ {_SNAP.format(x=2)}, {_SNAP.format(x=0)}, df AS (SELECT coalesce(a.uri, b.uri) AS uri, CASE WHEN a.uri IS NULL THEN 'added' WHEN b.uri IS NULL THEN 'removed' WHEN a.commit_id IS DISTINCT FROM b.commit_id THEN 'changed' END AS change FROM sn2 a FULL JOIN sn0 b ON a.uri = b.uri)"


@query(_DIFF + " SELECT * FROM df WHERE change IS NOT NULL", CHAIN)
def v_diff(s, d):
    return V.diff(_snap(s, d, 2), _snap(s, d), "uri", "commit_id")


query.queries["diff_sets"], query.oracles["diff_sets"] = v_diff, query.oracles["v_diff"]


@query("+ a AS (SELECT uri, arg_max(l0, version) AS l0 FROM vx WHERE tx <= TIMESTAMP '2024-05-01' GROUP BY uri), b AS (SELECT uri, arg_max(l0, version) AS l0 FROM vx WHERE tx <= TIMESTAMP '2024-10-01' GROUP BY uri) SELECT b.uri, a.l0 AS before, b.l0 AS after FROM b LEFT JOIN a ON a.uri = b.uri WHERE a.l0 IS DISTINCT FROM b.l0", VX)
def v_tdiff(s, d):
    """Text of every entry at two instants, where it differs; one pass over the versions."""
    v = versions(s, d)
    at = lambda t: F.max_by("l0", F.when(F.col("tx") <= F.lit(t).cast("timestamp_ntz"), F.col("version")))
    known = F.max(F.col("tx") <= F.lit("2024-10-01").cast("timestamp_ntz"))
    g = v.groupBy("uri").agg(at("2024-05-01").alias("before"), at("2024-10-01").alias("after"), known.alias("known")).filter("known")
    return g.filter(~F.col("before").eqNullSafe(F.col("after"))).select("uri", "before", "after")



_MERGE = f"+ {_SNAP.format(x=3)}, {_SNAP.format(x=0)}, {_SNAP.format(x=1)}, j AS (SELECT coalesce(b.uri, o.uri, t.uri) AS uri, b.commit_id AS b, o.commit_id AS o, t.commit_id AS t FROM sn3 b FULL JOIN sn0 o ON o.uri = b.uri FULL JOIN sn1 t ON t.uri = coalesce(b.uri, o.uri)), m AS (SELECT uri, CASE WHEN o IS NOT DISTINCT FROM t THEN 'same' WHEN t IS NOT DISTINCT FROM b THEN 'ours' WHEN o IS NOT DISTINCT FROM b THEN 'theirs' ELSE 'conflict' END AS state, o, t FROM j), w AS (SELECT uri, state, CASE WHEN state = 'theirs' THEN t WHEN state = 'conflict' THEN {{won}} ELSE o END AS merged FROM m)"


def _three(s, d, prefer):
    return V.three_way(_snap(s, d, 3), _snap(s, d), _snap(s, d, 1), "uri", "commit_id", prefer)


@query(_MERGE.format(won="NULL") + " SELECT * FROM w WHERE merged IS NOT NULL OR state = 'conflict'", CHAIN)
def v_merge(s, d):
    return _three(s, d, None)


query.queries["join_snapshot_3way"], query.oracles["join_snapshot_3way"] = v_merge, query.oracles["v_merge"]


@query(_MERGE.format(won="t") + " SELECT * FROM w WHERE merged IS NOT NULL OR state = 'conflict'", CHAIN)
def v_cherry(s, d):
    return V.pick(_snap(s, d, 3), _snap(s, d, 1), _snap(s, d), "uri", "commit_id", "theirs")


@query("SELECT scope, uri, arg_max(commit_id, (log_pos, commit_id)) AS commit_id FROM dx WHERE op IN ('add','update') GROUP BY scope, uri", DX)
def v_kmerge(s, d):
    return V.last_writer(deltas(s, d).filter("op in ('add','update')"), ["scope", "uri"], ["log_pos", "commit_id"], "commit_id")


query.queries["v_crdt_lww"], query.oracles["v_crdt_lww"] = v_kmerge, query.oracles["v_kmerge"]


@query("SELECT tenant, list_sort(list_distinct(flatten(list(tags)))) AS tags FROM fx GROUP BY tenant")
def v_crdt_set(s, d):
    return entries(s, d).select("tenant", F.explode("tags").alias("t")).groupBy("tenant").agg(F.array_sort(F.collect_set("t")).alias("tags"))


@query("+ g AS (SELECT tenant, max(quality) AS confidence, sum(round(100 * coalesce(quality, 0.5))::BIGINT * mvcc_version)::BIGINT AS q, sum(mvcc_version)::BIGINT AS n, arg_max(uri, (updated_at, uri)) AS latest, list_sort(list_distinct(flatten(list(tags)))) AS tags FROM fx GROUP BY tenant) SELECT tenant, confidence, (1000 * q) // n AS quality, latest, coalesce(tags, []) AS tags FROM g")
def v_patch(s, d):
    """Maximum of confidence, mean quality weighted by version (whole thousandths of a hundredth, so no rounding differs), latest entry and union of tags."""
    v = F.col("mvcc_version")
    q = F.round(100 * F.coalesce("quality", F.lit(0.5))).cast("bigint")
    e = entries(s, d)
    g = e.groupBy("tenant").agg(F.max("quality").alias("confidence"), F.sum(q * v).alias("q"), F.sum(v).alias("n"), F.max_by("uri", F.struct("updated_at", "uri")).alias("latest"))
    return g.join(v_crdt_set(s, d), "tenant", "left").select("tenant", "confidence", F.expr("(1000 * q) div n").alias("quality"), "latest", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


_ANC = f"{EX}, {CX}, h AS (SELECT arg_max(id, (committed_at, id)) AS id FROM cx GROUP BY scope), r(id, hop) AS (SELECT id, 0 FROM h UNION SELECT ex.t, r.hop + 1 FROM r JOIN ex ON ex.f = r.id WHERE r.hop < (SELECT count(*) FROM ex)), a AS (SELECT id, min(hop)::INT AS hop FROM r GROUP BY id)"


def _reached(s, d):
    return G.reach(edges(s, d), V.heads(commits(s, d)).select(F.col("head").alias("node")), None)


@query("+ q AS (SELECT id FROM cx ORDER BY committed_at DESC, id DESC LIMIT 100) SELECT id FROM cx WHERE committed_at < TIMESTAMP '2024-10-01' AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM q)", _ANC)
def v_gc(s, d):
    return V.collectable(commits(s, d), _reached(s, d).select(F.col("node").alias("id")), 100, F.lit("2024-10-01").cast("timestamp_ntz"))


query.queries["join_anti_gc"], query.oracles["join_anti_gc"] = v_gc, query.oracles["v_gc"]


@query("+ z AS (SELECT 1) SELECT id AS node, hop FROM a WHERE hop > 0", _ANC)
def v_dag(s, d):
    return _reached(s, d).filter("hop > 0")


@query("+ f AS (SELECT scope, arg_min(id, (committed_at, id)) AS first FROM cx GROUP BY scope) SELECT f.scope, f.first, f.first IN (SELECT id FROM r0 WHERE r0.scope = f.scope) AS is_ancestor FROM f", f"{EX}, {CX}, r0(scope, id) AS (SELECT scope, arg_max(id, (committed_at, id)) FROM cx GROUP BY scope UNION SELECT r0.scope, ex.t FROM r0 JOIN ex ON ex.f = r0.id)")
def v_isancestor(s, d):
    """Whether the first commit of a scope is an ancestor of (or is) its newest one, each pair of a scope by its own."""
    c = commits(s, d)
    ends = c.groupBy("scope").agg(F.min_by("id", F.struct("committed_at", "id")).alias("first"), F.max_by("id", F.struct("committed_at", "id")).alias("head"))
    found = G.reaches(edges(s, d), ends.select(F.col("head").alias("start"), F.col("first").alias("goal")))
    return ends.join(found.select(F.col("start").alias("head"), F.col("goal").alias("first"), F.lit(True).alias("hit")), ["head", "first"], "left").select("scope", "first", F.coalesce("hit", F.lit(False)).alias("is_ancestor"))


_SIDE = "{n}(m, id, hop) AS (SELECT f, t, 0 FROM ex WHERE kind = '{k}' AND f IN (SELECT f FROM ex WHERE kind = 'merges') UNION SELECT m, ex.t, hop + 1 FROM {n} JOIN ex ON ex.f = {n}.id WHERE hop < {h})"


@query(
    f"+ {_SIDE.format(n='l', k='derived_from', h=8)}, {_SIDE.format(n='q', k='merges', h=8)}, x AS (SELECT m, id, min(hop) AS a FROM l GROUP BY m, id), y AS (SELECT m, id, min(hop) AS b FROM q GROUP BY m, id)"
    " SELECT m AS merge, arg_min(x.id, (a + b, x.id)) AS node, min(a + b)::INT AS total FROM x JOIN y USING (m, id) GROUP BY m",
    EX,
)
def v_mergebase(s, d):
    """Nearest common ancestor, within 8 steps on each side, of the two sides of every merge."""
    e = edges(s, d)
    merges = e.filter("kind = 'merges'").select("from").distinct()
    side = lambda k: e.filter(F.col("kind") == k).join(merges, "from", "left_semi").select(F.col("from").alias("of"), F.col("to").alias("node"))
    return G.common_ancestors(e, side("derived_from"), side("merges"), 8).select(F.col("of").alias("merge"), "node", "total")


@query("SELECT dx.uri, dx.commit_id, cx.committed_at FROM dx JOIN cx ON cx.id = dx.commit_id WHERE dx.op = 'update'", f"{DX}, {CX}")
def join_delta_commit(s, d):
    return deltas(s, d).filter("op = 'update'").join(commits(s, d).select(F.col("id").alias("commit_id"), "committed_at"), "commit_id").select("uri", "commit_id", "committed_at")


query.queries["v_prov"], query.oracles["v_prov"] = join_delta_commit, query.oracles["join_delta_commit"]


@query("SELECT commit_id, count(DISTINCT uri) AS n_uris FROM dx WHERE commit_id IS NOT NULL GROUP BY commit_id", DX)
def v_impact(s, d):
    return deltas(s, d).filter("commit_id is not null").groupBy("commit_id").agg(F.countDistinct("uri").alias("n_uris"))


@query("SELECT scope, arg_max(id, (committed_at, id)) AS head FROM cx GROUP BY scope", CX)
def v_branches(s, d):
    return V.heads(commits(s, d))


@query("SELECT id, 'release-' || strftime(committed_at, '%Y%m%d') AS tag FROM cx WHERE contains(message, 'checkpoint')", CX)
def v_tags(s, d):
    return commits(s, d).filter(F.contains("message", F.lit("checkpoint"))).select("id", F.concat(F.lit("release-"), F.date_format("committed_at", "yyyyMMdd")).alias("tag"))


@query("SELECT dx.commit_id, op, count(*) AS n FROM dx WHERE commit_id IN (SELECT id FROM cx) GROUP BY ALL", f"{DX}, {CX}")
def v_commit(s, d):
    return deltas(s, d).join(commits(s, d).select(F.col("id").alias("commit_id")), "commit_id", "left_semi").groupBy("commit_id", "op").agg(F.count("*").alias("n"))


@query("+ f AS (SELECT f, min(t) AS t FROM ex WHERE kind = 'derived_from' GROUP BY f), o AS (SELECT id, lag(id) OVER (PARTITION BY scope ORDER BY committed_at, id) AS before FROM cx) SELECT o.id, coalesce(f.t = o.before, false) AS follows FROM o LEFT JOIN f ON f.f = o.id", f"{EX}, {CX}")
def w_squash(s, d):
    p = edges(s, d).filter("kind = 'derived_from'").groupBy(F.col("from").alias("id")).agg(F.min("to").alias("t"))
    o = previous(commits(s, d).select("scope", "id", "committed_at"), ["scope"], micros(F.col("committed_at")), [F.asc("id")], F.col("id"), "before")
    return o.join(p, "id", "left").select("id", F.coalesce(F.col("t") == F.col("before"), F.lit(False)).alias("follows"))


@query("SELECT commit_id, list_sort(list(DISTINCT uri)) AS uris FROM dx WHERE commit_id IS NOT NULL AND op IN ('add','update') GROUP BY commit_id", DX)
def c_samples(s, d):
    return deltas(s, d).filter("commit_id is not null and op in ('add','update')").groupBy("commit_id").agg(F.array_sort(F.collect_set("uri")).alias("uris"))


@query("SELECT scope, arg_max(id, (committed_at, id)) AS last, arg_min(id, (committed_at, id)) AS first, count(*) AS n FROM cx GROUP BY scope HAVING count(*) > 1", CX)
def v_squash(s, d):
    return commits(s, d).groupBy("scope").agg(F.max_by("id", F.struct("committed_at", "id")).alias("last"), F.min_by("id", F.struct("committed_at", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1")


QUERIES, ORACLES = query.queries, query.oracles
