"""Writes, lifecycle, retrieval, market, training and streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec as V
from ..operators import aggregates as A
from ..operators import budget as B
from ..operators import lifecycle as L
from ..operators import market as K
from ..operators.ordered import numbered
from ..scratch import shared_dir
from ..streaming import watch as S
from ..tables import table
from .q_scalars import _ONE as redact_sql
from .fixtures import DX, FX, NOW, OX, Catalog, deltas, entries, now, votes

query = Catalog()
DAYS = f"(floor(trunc(epoch(TIMESTAMP '{NOW}' - updated_at)) / 3600) / 24)"
days = lambda: F.floor(F.timestamp_diff("SECOND", F.col("updated_at"), now()) / 3600) / 24
q5 = lambda: F.coalesce("quality", F.lit(0.5))
Q5 = "coalesce(quality, 0.5e0)"


def _e(name, cols, sql, views=FX, source=entries):
    def run(s, d):
        return source(s, d).select("uri", *[c.alias(n) for n, c in cols().items()])

    run.__name__ = name
    query(f"SELECT uri, {sql} FROM fx", views)(run)


# writes and lifecycle
_e("lc_rules", lambda: {"action": L.lifecycle_action(q5() - 0.1, F.exp(-F.abs(days()) / 30), F.col("mvcc_version") / (F.col("mvcc_version") + 5), F.lit(0.5), F.col("tags"))}, f"CASE WHEN list_contains(tags, 'pinned') THEN 'Freeze' WHEN {Q5} - 0.1 < 0.2 THEN 'Consolidate' WHEN exp(-abs({DAYS}) / 30) < 0.1 AND mvcc_version / (mvcc_version + 5) < 0.1 THEN 'Archive' WHEN {Q5} - 0.1 < 0.05 THEN 'Delete' ELSE 'Keep' END AS action")
_due = f"({DAYS} / 90)"
_e("lc_review", lambda: {"task": L.review_task(F.col("state_scope"), days(), F.lit(90), q5())}, f"CASE WHEN state_scope IN ('Mid','Long') AND NOT ({_due} < 0.82 AND {Q5} >= 0.35) THEN CASE WHEN {_due} >= 1.75 AND {Q5} < 0.3 THEN 'Forget' WHEN {_due} >= 1.05 OR {Q5} < 0.45 THEN 'Revalidate' ELSE 'Rehearse' END END AS task")
_e("lc_tier", lambda: {"tier": F.when(F.col("state_scope") == "Mid", "cold").otherwise("hot")}, "CASE WHEN state_scope = 'Mid' THEN 'cold' ELSE 'hot' END AS tier")
_e("wr_sanitize", lambda: {"h": F.sha2(T.redact(F.col("l2")), 256)}, f"sha256(array_to_string(list_transform(list_filter(regexp_split_to_array(l2, '\\s+'), lambda x: x <> ''), lambda t: {redact_sql}), ' ')) AS h")
_e("wr_pack", lambda: {"pack": F.to_json(F.struct("content_type", "mvcc_version"))}, "'{\"content_type\":\"' || content_type || '\",\"mvcc_version\":' || mvcc_version || '}' AS pack")
_e("wr_blob", lambda: {"hash": F.sha2("l2", 256), "size": F.octet_length("l2").cast("bigint")}, "sha256(l2) AS hash, strlen(l2) AS size")


@query("SELECT sha256(l2) AS hash, count(*) AS refs FROM fx WHERE l2 IS NOT NULL GROUP BY 1")
def wr_dedupstore(s, d):
    return entries(s, d).filter("l2 is not null").groupBy(F.sha2("l2", 256).alias("hash")).agg(F.count("*").alias("refs"))


@query("+ w AS (SELECT uri, count(*) AS n FROM context_versions WHERE uri IS NOT NULL GROUP BY uri) SELECT w.uri, coalesce(fx.mvcc_version + 1, 1) AS mvcc_version FROM w LEFT JOIN fx USING (uri)")
def wr_upsert(s, d):
    inc = table(s, d, "context_versions").filter("uri is not null").select("uri").distinct()
    return L.changed_rows(entries(s, d), inc, "uri").select("uri", "mvcc_version")


query.queries["wr_batch"], query.oracles["wr_batch"] = wr_upsert, query.oracles["wr_upsert"]


@query("SELECT scope, uri, max(log_pos) AS at FROM dx WHERE op = 'delete' GROUP BY scope, uri", DX)
def wr_delete(s, d):
    return deltas(s, d).filter("op = 'delete'").groupBy("scope", "uri").agg(F.max("log_pos").alias("at"))


@query("SELECT uri, log_pos, 'set' AS kind FROM dx WHERE op = 'rename' AND rename_from IS NOT NULL AND rename_from <> uri UNION ALL SELECT rename_from, log_pos, 'gone' FROM dx WHERE op = 'rename' AND rename_from IS NOT NULL AND rename_from <> uri", DX)
def wr_rename(s, d):
    r = deltas(s, d).filter("op = 'rename' and rename_from is not null and rename_from <> uri")
    return r.select("log_pos", F.explode(F.array(F.struct(F.col("uri").alias("uri"), F.lit("set").alias("kind")), F.struct(F.col("rename_from").alias("uri"), F.lit("gone").alias("kind")))).alias("x")).select("x.uri", "log_pos", "x.kind")


_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(l0), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2))"


@query(f"+ t AS (SELECT uri, tenant, content_type, {_TERMS} AS t FROM fx WHERE len({_TERMS}) >= 5) SELECT a.uri AS a, b.uri AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM t a JOIN t b ON a.content_type = b.content_type AND a.tenant = b.tenant AND a.uri < b.uri WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.5")
def wr_dedup(s, d):
    return L.write_duplicates(entries(s, d), ["tenant", "content_type"], 0.5).withColumn("similarity", F.round("similarity", 6))


@query("SELECT v.uri, CASE WHEN fx.uri IS NULL THEN 'Add' WHEN v.l0 = fx.l0 THEN 'Noop' WHEN 0.9 > coalesce(fx.quality, 0.5) + 0.1 THEN 'Update' ELSE 'Invalidate' END AS action FROM (SELECT uri, arg_min(l0_abstract, (mvcc_version, ingested_at)) AS l0 FROM context_versions WHERE uri IS NOT NULL GROUP BY uri) v LEFT JOIN fx USING (uri)")
def wr_resolve(s, d):
    v = table(s, d, "context_versions").filter("uri is not null").groupBy("uri").agg(F.min_by("l0_abstract", F.struct("mvcc_version", "ingested_at")).alias("new"))
    j = v.join(entries(s, d).select("uri", "l0", "quality", F.lit(True).alias("old")), "uri", "left")
    return j.select("uri", L.write_resolution(F.coalesce("old", F.lit(False)), F.col("new") == F.col("l0"), F.lit(0.9), q5()).alias("action"))


@query("SELECT commit_id, op, count(*) AS attempts, CASE WHEN op = 'add' THEN 'done' WHEN count(*) >= 8 THEN 'dead' ELSE 'failed' END AS status, least(3600.0, pow(2.0, count(*))) AS backoff FROM dx WHERE commit_id IS NOT NULL GROUP BY commit_id, op", DX)
def wr_outbox(s, d):
    o = deltas(s, d).filter("commit_id is not null").groupBy("commit_id", "op").agg(F.count("*").alias("attempts"))
    return o.withColumn("status", L.outbox_status(F.col("op") == "add", F.col("attempts"))).withColumn("backoff", L.outbox_backoff(F.col("attempts")))


@query("SELECT uri FROM fx WHERE uri NOT IN (SELECT uri FROM context_versions WHERE uri IS NOT NULL)")
def wr_reconcile(s, d):
    return entries(s, d).join(table(s, d, "context_versions").select("uri"), "uri", "left_anti").select("uri")


@query(f"+ i AS (SELECT uri, unnest([CASE WHEN mvcc_version % 4 >= 2 AND {Q5} <= 0.55 THEN struct_pack(issue := 'DangerousDependency', priority := 1 - {Q5}) END, CASE WHEN content_type = 'fact' AND {Q5} < 0.72 THEN struct_pack(issue := 'MissingEvidence', priority := 0.72 - {Q5}) END, CASE WHEN {DAYS} > 30 AND {Q5} < 0.45 AND mvcc_version % 4 = 0 THEN struct_pack(issue := 'Stale', priority := least(1.0, {DAYS} / 365)) END]) AS i FROM fx) SELECT uri, i.issue AS issue, round(i.priority, 6) AS priority FROM i WHERE i IS NOT NULL")
def h_diag(s, d):
    return L.health_issues(entries(s, d), F.col("mvcc_version") % 4, days()).withColumn("priority", F.round("priority", 6))


_BM = f"({Q5} * 4 + 0.9 * 2.0) / (4 + 2.0) - {Q5}"
_e("q_reassess", lambda: {"factuality": F.round(L.beta_update(q5(), F.lit(4), F.lit(0.9), F.lit(2.0)), 6)}, f"round({Q5} + least(0.15, greatest(-0.15, {_BM})), 6) AS factuality")
_e("q_route", lambda: {"route": F.when(q5() >= 0.8, "Promote").when(q5() >= 0.5, "Keep").when(days() > 90, "Archive").otherwise("Review")}, f"CASE WHEN {Q5} >= 0.8 THEN 'Promote' WHEN {Q5} >= 0.5 THEN 'Keep' WHEN {DAYS} > 90 THEN 'Archive' ELSE 'Review' END AS route")


@query(f"+ u AS (SELECT tenant, uri, round(1 - abs({Q5} - 0.5) * 2, 6) AS uncertainty FROM fx), k AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY uncertainty DESC, uri) AS k FROM u WHERE uncertainty >= 0.42) SELECT tenant, uri, uncertainty FROM k WHERE k <= 3")
def q_active(s, d):
    u = entries(s, d).withColumn("uncertainty", F.round(1 - F.abs(q5() - 0.5) * 2, 6)).filter("uncertainty >= 0.42")
    return u.withColumn("k", F.row_number().over(W.partitionBy("tenant").orderBy(F.desc("uncertainty"), "uri"))).filter("k <= 3").select("tenant", "uri", "uncertainty")


@query(f"+ c AS (SELECT tenant, uri, round({DAYS} / 90, 6) AS due FROM fx) SELECT tenant, uri, due, (rank() OVER (PARTITION BY tenant ORDER BY due DESC, uri))::INT AS place FROM c")
def w_review(s, d):
    return numbered(entries(s, d).select("tenant", "uri", F.round(days() / 90, 6).alias("due")), ["tenant"], -F.col("due"), [F.asc("uri")], "place")


# consolidation
@query(f"+ m AS (SELECT tenant, max({Q5}) AS best FROM fx WHERE mvcc_version % 2 = 0 GROUP BY tenant) SELECT uri, {Q5} > coalesce(best, 0) + 0.1 AS useful FROM fx LEFT JOIN m USING (tenant) WHERE mvcc_version % 2 = 1")
def cs_marginal(s, d):
    e = entries(s, d)
    m = e.filter("mvcc_version % 2 = 0").groupBy("tenant").agg(F.max(q5()).alias("best"))
    return e.filter("mvcc_version % 2 = 1").join(m, "tenant", "left").select("uri", (q5() > F.coalesce("best", F.lit(0.0)) + 0.1).alias("useful"))


@query(f"SELECT a.uri, b.uri IS NOT NULL AND a.content_type = b.content_type AND 0.8 > coalesce(b.quality, 0.5) + 0.1 AS applied FROM fx a LEFT JOIN fx b USING (uri) WHERE a.mvcc_version % 2 = 0")
def cs_patch(s, d):
    e = entries(s, d)
    b = e.select("uri", F.col("content_type").alias("ct"), F.col("quality").alias("q"))
    return e.filter("mvcc_version % 2 = 0").join(b, "uri", "left").select("uri", (F.col("ct").isNotNull() & (F.col("content_type") == F.col("ct")) & (F.lit(0.8) > F.coalesce("q", F.lit(0.5)) + 0.1)).alias("applied"))


VEC = "v AS (SELECT 'v' || vec_id AS uri, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


def _v(s, d):
    return table(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("uri"), "vec_id", "label", "embedding")


@query("+ z AS (SELECT uri, m.label, round((1 - list_cosine_similarity(e, c)) / 2, 6) AS d FROM v, m) SELECT uri, arg_min(label, (d, label)) AS cluster, min(d) < 0.7 AS near FROM z GROUP BY uri", VEC)
def sa_assign(s, d):
    """Nearest of the labels' centroids; their number is that of the labels and is checked."""
    c = A.centroids(_v(s, d), "label", "embedding").withColumnRenamed("label", "cluster")
    n = c.limit(1001).count()
    if n > 1000:
        raise ValueError("over 1000 clusters")
    z = _v(s, d).join(F.broadcast(c)).withColumn("d", F.round(V.cosine_distance(F.col("embedding"), F.col("centroid")), 6))
    return z.groupBy("uri").agg(F.min(F.struct("d", "cluster")).alias("b")).select("uri", "b.cluster", (F.col("b.d") < 0.7).alias("near"))


@query("SELECT label, round(sqrt(list_dot_product(c, c)), 5) AS norm FROM m", VEC)
def sa_recluster(s, d):
    return A.centroids(_v(s, d), "label", "embedding").select("label", F.round(V.norm(F.col("centroid")), 5).alias("norm"))


_e("ln_record", lambda: {"lineage": F.array_append(F.array("agent"), F.col("content_type"))}, "[agent, content_type] AS lineage")


@query("SELECT uri, unnest(tags) AS evidence FROM fx")
def ex_tree(s, d):
    return entries(s, d).select("uri", F.explode("tags").alias("evidence"))


@query("+ t AS (SELECT threat_type, substr(min(detected_by), 1, 6) AS p, count(*) AS n FROM antibodies WHERE detected_by IS NOT NULL GROUP BY threat_type HAVING count(*) >= 2) SELECT DISTINCT uri, 'Blocked' AS verdict FROM fx JOIN t ON contains(uri, p)")
def im_memory(s, d):
    t = table(s, d, "antibodies").filter("detected_by is not null").groupBy("threat_type").agg(F.substring(F.min("detected_by"), 1, 6).alias("p"), F.count("*").alias("n")).filter("n >= 2")
    if t.limit(1001).count() > 1000:
        raise ValueError("over 1000 kinds of threats")
    return entries(s, d).join(F.broadcast(t), F.contains("uri", "p")).select("uri", F.lit("Blocked").alias("verdict")).distinct()


# retrieval and budget
_e("pl_nl", lambda: {"intent": F.when(F.lower("l0").rlike("error|fehler|erreur"), "error").when(F.lower("l0").rlike("how|comment|wie"), "procedure").otherwise("fact"), "limit": F.greatest(F.lit(10), F.least(F.lit(512), F.ceil(F.length("l0") * 8 / 160))).cast("bigint")}, "CASE WHEN regexp_matches(lower(l0), 'error|fehler|erreur') THEN 'error' WHEN regexp_matches(lower(l0), 'how|comment|wie') THEN 'procedure' ELSE 'fact' END AS intent, greatest(10, least(512, ceil(length(l0) * 8 / 160)))::BIGINT AS \"limit\"")
_k = ("index", "queue", "vote", "cache")
_e("pl_intent", lambda: {"score": F.round(F.least(F.lit(1.0), 0.08 + sum((0.28 * F.contains(F.lower("l0"), F.lit(k)).cast("int") for k in _k), F.lit(0.0)) + 0.32 * F.lower("l0").rlike(r"\d{3,}").cast("int") - 0.35 * F.contains("l0", F.lit("?")).cast("int")), 6)}, "round(least(1.0, 0.08 + " + " + ".join(f"0.28 * contains(lower(l0), '{k}')::INT" for k in _k) + " + 0.32 * regexp_matches(lower(l0), '[0-9]{3,}')::INT - 0.35 * contains(l0, '?')::INT), 6) AS score")


@query("SELECT route, step, node FROM (VALUES ('semantic', 1, 'VectorSearch'), ('semantic', 2, 'Filter'), ('semantic', 3, 'Rerank'), ('event', 1, 'TemporalScan'), ('event', 2, 'Sort')) AS t(route, step, node)", "")
def pl_graph(s, d):
    return s.createDataFrame([("semantic", 1, "VectorSearch"), ("semantic", 2, "Filter"), ("semantic", 3, "Rerank"), ("event", 1, "TemporalScan"), ("event", 2, "Sort")], "route string, step int, node string")


@query("SELECT content_type AS id, arg_max(state_scope, (mvcc_version, uri)) AS value FROM fx WHERE state_scope IS NOT NULL GROUP BY content_type")
def pl_layers(s, d):
    return entries(s, d).filter("state_scope is not null").groupBy(F.col("content_type").alias("id")).agg(F.max_by("state_scope", F.struct("mvcc_version", "uri")).alias("value"))


@query("SELECT uri FROM fx WHERE content_type = 'goal' AND invalidated_by IS NULL ORDER BY quality DESC NULLS LAST, uri LIMIT 20")
def pl_compile(s, d):
    from .query import Find, compile_query

    return compile_query(Find(content_type="goal", only_current=True, order="quality", limit=20), entries(s, d)).select("uri")


def _hits(s, d):
    e = entries(s, d).withColumn("relevance", F.round((F.length("l0") % 37) / 37, 6)).withColumn("query", F.col("content_type"))
    return e.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("relevance"), "uri"))).filter("k <= 20")


HX = f"{FX}, hx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY relevance DESC, uri) AS k FROM (SELECT *, round((length(l0) % 37) / 37.0e0, 6) AS relevance FROM fx)) WHERE k <= 20)"
_COST = "greatest({f}, ceil(length({c}) / 4))::BIGINT"
_CH = "ch AS (" + " UNION ALL ".join(f"SELECT content_type AS query, uri, '{lv}' AS level, {_COST.format(f=f, c=c)} AS cost, round(greatest(relevance, 0) * least(1.0, greatest(0.05, coalesce(quality, 0.75))) * 1.05 * {g} - 0.01 * ln(1 + {_COST.format(f=f, c=c)}), 6) AS value FROM hx WHERE {c} IS NOT NULL" for lv, c, f, g in (("L0", "l0", 1, 1.0), ("L1", "l1", 50, 1.45), ("L2", "l2", 100, 1.85))) + ")"


@query("SELECT query, uri, level, cost FROM ch", f"{HX}, {_CH}")
def bd_choices(s, d):
    return B.choices(_hits(s, d)).select("query", "uri", "level", "cost")


@query("SELECT query, uri, level, value FROM ch", f"{HX}, {_CH}")
def bd_value(s, d):
    return B.choices(_hits(s, d)).select("query", "uri", "level", F.round("value", 6).alias("value"))


@query()
def bd_knapsack(s, d):
    return B.fit_budget(_hits(s, d), 1500)


query.queries["bd_alloc"] = bd_knapsack


@query()
def bd_greedy(s, d):
    return B.spread_budget(_hits(s, d), 3000)


_e("bd_bandit", lambda: {"level": F.when(F.col("mvcc_version") % 3 == 0, "L2").when(F.col("mvcc_version") % 3 == 1, "L0").otherwise("L1")}, "CASE WHEN mvcc_version % 3 = 0 THEN 'L2' WHEN mvcc_version % 3 = 1 THEN 'L0' ELSE 'L1' END AS level")


@query("SELECT event_id, round(least(1.0, greatest(0.0, 0.35 * least(value, 100.0) / 100 + 0.20 * (event_type = 'click')::INT + 0.35 * (event_type IN ('purchase','signup'))::INT + 0.10 * least(1.0, value / 90))), 6) AS reward FROM events", "")
def ln_reward(s, d):
    t = F.col("event_type")
    r = 0.35 * F.least(F.col("value"), F.lit(100.0)) / 100 + 0.20 * (t == "click").cast("int") + 0.35 * t.isin("purchase", "signup").cast("int") + 0.10 * F.least(F.lit(1.0), F.col("value") / 90)
    return table(s, d, "events").select("event_id", F.round(A.clamp(r, 0.0, 1.0), 6).alias("reward"))


@query("+ p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM c) SELECT a, b, n FROM k WHERE k <= 2", "z AS (SELECT 1)")
def ln_prefetch(s, d):
    p = table(s, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).filter("b is not null")
    c = p.groupBy("a", "b").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy(F.desc("n"), "b"))).filter("k <= 2").select("a", "b", "n")


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 100 THEN 'hot' WHEN count(*) >= 20 THEN 'warm' ELSE 'cold' END AS tier FROM events GROUP BY user_id", "")
def ln_tier(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("tier", F.when(F.col("n") >= 100, "hot").when(F.col("n") >= 20, "warm").otherwise("cold"))


_CITE = f"+ c AS (SELECT content_type, uri, l0, round(0.65 * relevance + 0.35 * {Q5}, 6) AS score FROM hx), k AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY score DESC, uri) AS i FROM c)"


def _cited(s, d):
    c = _hits(s, d).select("content_type", "uri", "l0", F.round(0.65 * F.col("relevance") + 0.35 * q5(), 6).alias("score"))
    return c.withColumn("i", F.row_number().over(W.partitionBy("content_type").orderBy(F.desc("score"), "uri")))


@query(_CITE + " SELECT content_type, uri, score FROM k WHERE i <= 5", HX)
def rg_cite(s, d):
    return _cited(s, d).filter("i <= 5").select("content_type", "uri", "score")


@query(_CITE + " SELECT content_type, array_to_string(list(l0 ORDER BY i), ' ') AS answer FROM k WHERE i <= 3 GROUP BY content_type", HX)
def rg_answer(s, d):
    c = _cited(s, d).filter("i <= 3")
    return c.groupBy("content_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l0"))), lambda x: x["l0"]), " ").alias("answer"))


@query(_CITE + " SELECT content_type, round(avg(score), 6) AS evidence, round(0.45 * avg(score) + 0.3 * 0.5 + 0.25, 6) AS confidence, 0.45 * avg(score) + 0.3 * 0.5 + 0.25 < 0.55 AS abstain FROM k WHERE i <= 5 GROUP BY content_type", HX)
def rg_conf(s, d):
    a = _cited(s, d).filter("i <= 5").groupBy("content_type").agg(F.avg("score").alias("x"))
    c = 0.45 * F.col("x") + 0.3 * 0.5 + 0.25
    return a.select("content_type", F.round("x", 6).alias("evidence"), F.round(c, 6).alias("confidence"), (c < 0.55).alias("abstain"))


@query(f"+ w AS (SELECT agent, unnest({_TERMS}) AS t FROM fx), c AS (SELECT agent, t, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY n DESC, t) AS k FROM c) SELECT agent, t AS term, n FROM k WHERE k <= 3")
def tm_hint(s, d):
    c = entries(s, d).select("agent", F.explode(T.terms(F.col("l0"))).alias("term")).groupBy("agent", "term").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(W.partitionBy("agent").orderBy(F.desc("n"), "term"))).filter("k <= 3").select("agent", "term", "n")


@query("SELECT DISTINCT sha256(l0) AS key FROM fx")
def ca_emb(s, d):
    return entries(s, d).select(F.sha2("l0", 256).alias("key")).dropDuplicates(["key"])


# federation and market
@query(f"+ p AS (SELECT tenant, avg({Q5}) AS c, count(*) AS n, avg(mvcc_version) AS m FROM fx GROUP BY tenant) SELECT tenant, round(0.30 * c + 0.20 * CASE n % 4 WHEN 0 THEN 0.35 WHEN 1 THEN 0.55 WHEN 2 THEN 0.80 ELSE 1.0 END + 0.15 * c + 0.15 / (1 + m) + 0.175 - 0.2 * 0.1, 6) AS score FROM p WHERE c >= 0.25")
def fd_route(s, d):
    p = entries(s, d).groupBy("tenant").agg(F.avg(q5()).alias("c"), F.count("*").alias("n"), F.avg("mvcc_version").alias("m")).filter("c >= 0.25")
    return p.select("tenant", F.round(K.route_score(F.col("c"), F.col("n") % 4, F.col("c"), 1 / (1 + F.col("m")), F.lit(0.1)), 6).alias("score"))


@query(f"+ p AS (SELECT tenant, content_type, count(*) AS n FROM fx GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY n DESC, tenant) AS k FROM p) SELECT content_type, tenant, k::INT AS k, CASE WHEN k <= 2 THEN 'fetch' ELSE 'probe' END AS step FROM k WHERE k <= 4")
def fd_plan(s, d):
    p = entries(s, d).groupBy("tenant", "content_type").agg(F.count("*").alias("n"))
    return p.withColumn("k", F.row_number().over(W.partitionBy("content_type").orderBy(F.desc("n"), "tenant"))).filter("k <= 4").select("content_type", "tenant", "k", F.when(F.col("k") <= 2, "fetch").otherwise("probe").alias("step"))


@query("SELECT tenant, round(count(*) / (10.0 + count(*)) + 0.12 * bool_or(content_type = 'fact')::INT, 6) AS score FROM fx GROUP BY tenant")
def fd_boost(s, d):
    g = entries(s, d).groupBy("tenant").agg(F.count("*").alias("n"), F.max(F.col("content_type") == "fact").alias("f"))
    return g.select("tenant", F.round(F.col("n") / (10.0 + F.col("n")) + 0.12 * F.col("f").cast("int"), 6).alias("score"))


@query("SELECT tenant, content_type, count(DISTINCT agent) AS n FROM fx GROUP BY ALL HAVING count(DISTINCT agent) >= 2")
def fd_kanon(s, d):
    return K.k_anonymous(entries(s, d), ["tenant", "content_type"], "agent", 2)


@query("+ g AS (SELECT tenant AS subject, content_type AS domain, max(quality) AS most, max(updated_at) AS expires FROM fx GROUP BY ALL) SELECT DISTINCT r.tenant AS subject, r.content_type AS domain, 0.5e0 AS epsilon FROM fx r JOIN g ON g.subject = r.tenant AND g.domain = r.content_type WHERE 0.5 <= most AND expires > TIMESTAMP '2024-08-01'")
def fd_grant(s, d):
    e = entries(s, d)
    g = e.groupBy(F.col("tenant").alias("subject"), F.col("content_type").alias("domain")).agg(F.max("quality").alias("epsilon"), F.max("updated_at").alias("expires"))
    r = e.select(F.col("tenant").alias("subject"), F.col("content_type").alias("domain"), F.lit(0.5).alias("epsilon"))
    return K.granted(r, g, F.lit("2024-08-01").cast("timestamp_ntz"))


_e("fd_gov", lambda: {"ok": (q5() >= 0.4) & F.col("invalidated_by").isNull()}, f"{Q5} >= 0.4 AND invalidated_by IS NULL AS ok")
_e("fd_intent", lambda: {"kind": F.when(F.contains("l0", F.lit("?")), "question").when(F.length("l0") > 150, "discussion").otherwise("statement")}, "CASE WHEN contains(l0, '?') THEN 'question' WHEN length(l0) > 150 THEN 'discussion' ELSE 'statement' END AS kind")
_e("mk_cap", lambda: {"level": K.consistency_level(F.col("content_type"))}, "CASE WHEN content_type IN ('fact','procedure','profile') THEN 'Strong' WHEN content_type IN ('goal','preference','skill') THEN 'Causal' ELSE 'Eventual' END AS level")
_e("mk_license", lambda: {"licence": F.when(F.col("state_scope") == "Long", "Open").when(F.col("state_scope").isNull(), "Unknown").otherwise("Restricted")}, "CASE WHEN state_scope = 'Long' THEN 'Open' WHEN state_scope IS NULL THEN 'Unknown' ELSE 'Restricted' END AS licence")
_e("mk_fitness", lambda: {"fitness": F.round(K.fitness(q5(), F.lit(0.6), F.lit(0.4), F.col("mvcc_version") % 6, F.col("mvcc_version"), F.lit(0.3), F.abs(days()), F.col("mvcc_version") % 3, F.col("mvcc_version") % 2), 6)}, f"round(0.30 * {Q5} + 0.16 * 0.6 + 0.20 * 0.4 + 0.14 * ([0.0, 0.25, 0.55, 0.8, 1.0])[least(mvcc_version % 6, 4) + 1] + 0.08 * ln(mvcc_version + 1) / 8 + 0.07 * 0.3 + 0.05 / (1 + abs({DAYS}) / 90) - least(0.55, greatest(0.0, 0.12 * (mvcc_version % 3) + 0.06 * (mvcc_version % 2))), 6) AS fitness")


@query(f"SELECT uri FROM fx WHERE {Q5} >= 0.5 AND l1 IS NOT NULL")
def mk_publish(s, d):
    return entries(s, d).filter((q5() >= 0.5) & F.col("l1").isNotNull()).select("uri")


@query(f"SELECT uri, {Q5} AS quality FROM fx WHERE content_type = 'skill' ORDER BY {Q5} DESC, uri LIMIT 15")
def mk_search(s, d):
    return entries(s, d).filter("content_type = 'skill'").select("uri", q5().alias("quality")).orderBy(F.desc("quality"), "uri").limit(15)


@query("+ t AS (SELECT DISTINCT vec_id AS t, e AS te FROM v WHERE vec_id % 50 = 0) SELECT uri, round(max(list_cosine_similarity(e, te)), 5) AS similarity, CASE WHEN round(max(list_cosine_similarity(e, te)), 5) >= 0.9 THEN 'Blocked' WHEN round(max(list_cosine_similarity(e, te)), 5) >= 0.75 THEN 'Suspicious' ELSE 'Clean' END AS verdict FROM v, t GROUP BY uri", VEC)
def mk_immune(s, d):
    """Every vector against a stated set of threats: the rows whose id is divisible by 50."""
    t = _v(s, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("threat"))
    return K.immune_verdict(_v(s, d), t).withColumn("similarity", F.round("similarity", 5))


@query("+ c AS (SELECT tenant, agent, count(*) AS c FROM fx GROUP BY ALL), t AS (SELECT tenant, arg_max(agent, (c, agent)) AS top, max(c) / sum(c) AS share FROM c GROUP BY tenant) SELECT tenant, CASE WHEN share >= 0.3 THEN tenant || ':' || top ELSE tenant END AS community FROM t")
def mk_fork(s, d):
    t = A.share_of_top(entries(s, d), "tenant", "agent")
    return t.select("tenant", F.when(F.col("share") >= 0.3, F.concat_ws(":", "tenant", "top")).otherwise(F.col("tenant")).alias("community"))


@query("SELECT uri, mvcc_version AS total, 3 AS n FROM fx")
def mk_share(s, d):
    """Three shares of a number each, and what they add up to again."""
    x = entries(s, d).select("uri", K.shares(F.col("mvcc_version"), 3).alias("s"))
    return x.select("uri", F.pmod(F.aggregate("s", F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(2_147_483_647)).alias("total"), F.size("s").alias("n"))


@query()
def f_noise(s, d):
    return entries(s, d).select("uri", K.noise(F.col("uri"), 1.0).alias("noise"))


@query("SELECT entry_id, sum(CASE op WHEN 'Upvote' THEN 1 WHEN 'Downvote' THEN -1 ELSE 0 END)::BIGINT AS total, count(DISTINCT voter) AS contributors FROM ox GROUP BY entry_id HAVING count(DISTINCT voter) >= 2", OX)
def a_secure(s, d):
    v = votes(s, d).groupBy("entry_id").agg(F.sum(F.when(F.col("op") == "Upvote", 1).when(F.col("op") == "Downvote", -1).otherwise(0)).alias("total"), F.countDistinct("voter").alias("contributors"))
    return v.filter("contributors >= 2")


# training
_e("td_metric", lambda: {"score": F.round(0.35 / (1 + F.col("mvcc_version") % 3) + 0.25 * q5() + 0.25 + 0.15 / F.greatest(F.log(F.col("mvcc_version") + 1), F.lit(1.0)), 6)}, f"round(0.35 / (1 + mvcc_version % 3) + 0.25 * {Q5} + 0.25 + 0.15 / greatest(ln(mvcc_version + 1), 1.0), 6) AS score")
_e("td_value", lambda: {"value": F.round(0.6 * q5() + 0.4 * F.exp(-F.abs(days()) / 60), 6)}, f"round(0.6 * {Q5} + 0.4 * exp(-abs({DAYS}) / 60), 6) AS value")
_e("td_gate", lambda: {"passed": (q5() > 0.6) & (F.col("mvcc_version") >= 2)}, f"{Q5} > 0.6 AND mvcc_version >= 2 AS passed")


@query("SELECT uri, unnest(CASE WHEN l1 IS NULL THEN ['abstract'] ELSE ['abstract', 'overview'] END) AS gradient FROM fx")
def td_grad(s, d):
    return entries(s, d).select("uri", F.explode(F.when(F.col("l1").isNull(), F.array(F.lit("abstract"))).otherwise(F.array(F.lit("abstract"), F.lit("overview")))).alias("gradient"))


@query("+ b AS (SELECT tenant, content_type, arg_max(uri, (quality, uri)) AS chosen FROM fx WHERE quality >= 0.6 GROUP BY ALL) SELECT chosen, fx.uri AS rejected FROM fx JOIN b USING (tenant, content_type) WHERE fx.quality < 0.3")
def td_pairs(s, d):
    e = entries(s, d)
    b = e.filter("quality >= 0.6").groupBy("tenant", "content_type").agg(F.max_by("uri", F.struct("quality", "uri")).alias("chosen"))
    return e.filter("quality < 0.3").join(b, ["tenant", "content_type"]).select("chosen", F.col("uri").alias("rejected"))


query.queries["join_pref_pairs"], query.oracles["join_pref_pairs"] = td_pairs, query.oracles["td_pairs"]


@query("SELECT uri, quality FROM fx WHERE quality >= 0.5 ORDER BY quality DESC, uri LIMIT 12")
def td_boot(s, d):
    return entries(s, d).filter("quality >= 0.5").select("uri", "quality").orderBy(F.desc("quality"), "uri").limit(12)


@query("+ q AS (SELECT e AS qe FROM v WHERE vec_id = 1) SELECT uri, round(list_cosine_similarity(e, qe), 6) AS score FROM v, q WHERE label = 2 ORDER BY list_cosine_similarity(e, qe) DESC, uri LIMIT 10", VEC)
def td_skill(s, d):
    from ..operators.scans import vector_search

    q = [float(x) for x in table(s, d, "embeddings").filter("vec_id = 1").first()["embedding"]]
    return vector_search(_v(s, d), q, 10, F.col("label") == 2).select("uri", F.round("score", 6).alias("score"))


@query("SELECT scope, commit_id, log_pos, op FROM dx WHERE op <> 'noop'", DX)
def td_encode(s, d):
    return deltas(s, d).filter("op <> 'noop'").select("scope", "commit_id", "log_pos", "op")


@query("SELECT uri FROM fx WHERE content_type = 'reflection' AND split_part(uri, '/', -1) LIKE '%a%'")
def td_reflect(s, d):
    from ..operators.scans import find

    return find(entries(s, d), None, "*a*", "reflection").select("uri")


@query("+ a AS (SELECT uri, l0, string_split(uri, '/') AS s, unnest(range(3, len(string_split(uri, '/')))) AS i FROM fx), g AS (SELECT array_to_string(s[1:i], '/') AS dir, i::INT AS level, s[i + 1] AS child, uri, l0 FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY uri) AS k FROM g) SELECT dir, level, count(*) AS n, count(DISTINCT child) AS n_children, array_to_string(list(l0 ORDER BY k) FILTER (k <= 3), ' | ') AS summary FROM k GROUP BY dir, level")
def px_rollup(s, d):
    """Every directory, up to the tenant's, with its entries, children, and the abstracts of its first three entries."""
    seg = F.split("uri", "/")
    e = entries(s, d).select("uri", "l0", seg.alias("s"), F.explode(F.sequence(F.lit(3), F.size(seg) - 1)).alias("level"))
    g = e.select(F.array_join(F.slice("s", F.lit(1), F.col("level")), "/").alias("dir"), "level", F.get("s", F.col("level")).alias("child"), "uri", "l0")
    # the first three of each of 64 parts, then of the directory: a large one is no task of its own
    few = g.withColumn("part", F.pmod(F.xxhash64("uri"), F.lit(64)))
    few = few.withColumn("k", F.row_number().over(W.partitionBy("dir", "part").orderBy("uri"))).filter("k <= 3")
    few = few.withColumn("k", F.row_number().over(W.partitionBy("dir").orderBy("uri"))).filter("k <= 3")
    text = few.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "l0"))), lambda x: x["l0"]), " | ").alias("summary"))
    return g.groupBy("dir", "level").agg(F.count("*").alias("n"), F.countDistinct("child").alias("n_children")).join(text, "dir")


@query("SELECT agent, count(*) AS n, sha256(string_agg(uri, ',' ORDER BY created_at, uri)) AS archive FROM fx GROUP BY agent")
def ss_archive(s, d):
    e = entries(s, d).groupBy("agent").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("created_at", "uri"))).alias("m"))
    return e.select("agent", "n", F.sha2(F.array_join(F.transform("m", lambda v: v["uri"]), ","), 256).alias("archive"))


_e("pv_threshold", lambda: {"similar": q5() >= 0.6}, f"{Q5} >= 0.6 AS similar")
_e("pol_gate", lambda: {"rule": F.when(F.contains("l0", F.lit("secret")), "deny").when(q5() < 0.2, "require").otherwise("allow")}, f"CASE WHEN contains(l0, 'secret') THEN 'deny' WHEN {Q5} < 0.2 THEN 'require' ELSE 'allow' END AS rule")


@query()
def ob_sample(s, d):
    """Keyed sampling: the feature itself keeps a tenth."""
    return entries(s, d).filter(F.pmod(F.xxhash64("uri", F.lit("key")), F.lit(10)) == 0).select("uri")


_e("ob_finger", lambda: {"f": F.sha2(F.concat(F.lit("key"), "agent"), 256)}, "sha256('key' || agent) AS f")
_e("em_cutover", lambda: {"phase": F.when(q5() >= 0.8, "Cutover").when(q5() >= 0.5, "Shadow").otherwise("Hold")}, f"CASE WHEN {Q5} >= 0.8 THEN 'Cutover' WHEN {Q5} >= 0.5 THEN 'Shadow' ELSE 'Hold' END AS phase")


# streams
CH = '''ch AS (SELECT event_id + 1 AS checkpoint, CASE event_type WHEN 'error' THEN 'Delete' WHEN 'signup' THEN 'Rename' ELSE 'Write' END AS kind, 't' || (user_id % 4) AS tenant, 'uwu://t' || (user_id % 4) || '/' || event_type || '/' || user_id AS path, ts AS "at" FROM events)'''


def _changes(s, d):
    return S.changes(table(s, d, "events"))


@query("SELECT checkpoint, kind, path FROM ch WHERE checkpoint > 500 AND starts_with(path, 'uwu://t1/')", CH)
def st_watch(s, d):
    return S.watch(_changes(s, d), 500, "uwu://t1").select("checkpoint", "kind", "path")


@query('''SELECT checkpoint, kind, path, "at" FROM ch WHERE starts_with(path, 'uwu://t2/')''', CH)
def st_stream(s, d):
    """The same as a stream: files in, parquet out, exactly once."""
    at = f"{shared_dir(s)}/palimpsest-stream-{uuid.uuid4().hex}"
    table(s, d, "events").write.parquet(f"{at}/in")
    S.follow(s, f"{at}/in", f"{at}/out", f"{at}/state", "uwu://t2")
    return s.read.parquet(f"{at}/out").select("checkpoint", "kind", "path", "at")


@query("SELECT checkpoint FROM ch WHERE tenant = 't3'", CH)
def st_tenant(s, d):
    return _changes(s, d).filter("tenant = 't3'").select("checkpoint")


@query("SELECT checkpoint, CASE WHEN starts_with(path, 'uwu://t1/error') THEN 'Monitoring' WHEN starts_with(path, 'uwu://t1') THEN 'Consolidation' ELSE 'Main' END AS channel FROM ch", CH)
def st_route(s, d):
    return _changes(s, d).select("checkpoint", S.channel(F.col("path"), {"uwu://t1": "Consolidation", "uwu://t1/error": "Monitoring"}).alias("channel"))


@query('''SELECT checkpoint FROM ch WHERE tenant IN ('t0', 't1') AND "at" <= TIMESTAMP '2024-01-20' AND "at" >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY''', CH)
def st_sign(s, d):
    return S.valid_envelopes(_changes(s, d), F.lit("2024-01-20").cast("timestamp_ntz"), 5 * 86400, ["t0", "t1"]).select("checkpoint")


@query('''SELECT date_trunc('day', "at") AS start, kind, count(*) AS n FROM ch GROUP BY ALL''', CH)
def st_window(s, d):
    return S.windowed(_changes(s, d))


@query('''+ g AS (SELECT tenant, "at", coalesce("at" >= lag("at") OVER (PARTITION BY tenant ORDER BY "at") + INTERVAL 30 MINUTE, true)::INT AS new FROM ch), h AS (SELECT tenant, "at", sum(new) OVER (PARTITION BY tenant ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min("at") AS start, tenant, count(*) AS n FROM h GROUP BY tenant, k''', CH)
def st_sessions(s, d):
    return S.sessions(_changes(s, d))


@query("SELECT checkpoint, least(30.0, 0.5 * pow(2.0, checkpoint % 10)) AS delay FROM ch", CH)
def st_reconnect(s, d):
    return _changes(s, d).select("checkpoint", S.reconnect_delay(F.col("checkpoint") % 10).alias("delay"))


QUERIES, ORACLES = query.queries, query.oracles
