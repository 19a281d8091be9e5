"""Folds, budgets, buckets and trees as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import folds as D
from ..operators import market as K
from ..operators.components import connected_components
from ..operators.ordered import micros
from ..tables import table
from . import problems
from .fixtures import CLX, Catalog, claims, entries, now
from .q_scalars import claims_sql, contra_sql

query = Catalog()
NONE = "z AS (SELECT 1)"
_EMA = "+ r AS (SELECT user_id, {v} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS k FROM events) SELECT user_id, count(*) AS n, round(sum(0.1 * pow(0.9, k) * v) + 0.5 * pow(0.9, count(*)), 6) AS average FROM r GROUP BY user_id"


@query(_EMA.format(v="(event_type IN ('purchase', 'signup'))::INT"), NONE)
def a_feedback(s, d):
    return D.moving_average(table(s, d, "events"), "user_id", micros(F.col("ts")), [F.desc("event_id")], F.col("event_type").isin("purchase", "signup"), 0.9, 0.5).withColumn("average", F.round("average", 6))


@query(_EMA.format(v="least(value, 100.0) / 100"), NONE)
def ln_feedback(s, d):
    return D.moving_average(table(s, d, "events"), "user_id", micros(F.col("ts")), [F.desc("event_id")], F.least(F.col("value"), F.lit(100.0)) / 100, 0.9, 0.5).withColumn("average", F.round("average", 6))


@query("+ r AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), q AS (SELECT *, coalesce(sum(CASE WHEN i > 1 THEN ln(1 - 1 / sqrt(i)) ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM r) SELECT user_id, round(sum(v / sqrt(i) * exp(later)), 5) AS estimate FROM q GROUP BY user_id", NONE)
def a_trait(s, d):
    return D.shrinking_step(table(s, d, "events"), "user_id", micros(F.col("ts")), [F.asc("event_id")], F.col("value")).withColumn("estimate", F.round("estimate", 5))


@query("+ q AS (SELECT tenant, uri, round(sum(0.1) OVER (PARTITION BY tenant ORDER BY updated_at, uri ROWS UNBOUNDED PRECEDING), 6) AS spent FROM fx) SELECT tenant, uri, spent, spent <= 0.55 AS granted FROM q")
def fd_budget(s, d):
    b = D.within_budget(entries(s, d), "tenant", micros(F.col("updated_at")), [F.asc("uri")], F.lit(0.1), 0.55)
    return b.select("tenant", "uri", F.round("spent", 6).alias("spent"), "granted")


@query("+ q AS (SELECT agent, uri, updated_at, ceil(length(l0) / 4)::BIGINT AS c FROM fx), r AS (SELECT agent, uri, (sum(c) OVER (PARTITION BY agent ORDER BY updated_at DESC, uri ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM q) SELECT agent, uri, spent FROM r WHERE spent <= 200")
def bd_prompt(s, d):
    b = D.within_budget(entries(s, d), "agent", -micros(F.col("updated_at")), [F.asc("uri")], F.ceil(F.length("l0") / 4), 200)
    return b.filter("granted").select("agent", "uri", "spent")


def _vec(s, d):
    return table(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("uri"), "embedding")


_TURN = "(xor({z}, {z} // {cut}) * {by}) % 18446744073709551616"
# directions out of unsigned 128-bit numbers, each step modulo 2^64
_PLANES = (
    "g AS (SELECT t, b, p, (t::UHUGEINT * 11400714819323198485 + b::UHUGEINT * 13787848793156543929 % 18446744073709551616 + p::UHUGEINT * 10723151780598845931 % 18446744073709551616) % 18446744073709551616 AS z FROM range({tables}) x(t), range({bits}) y(b), range(64) u(p)),"
    f" h AS (SELECT t, b, p, {_TURN.format(z='z', cut=1 << 30, by=13787848793156543929)} AS z FROM g), i AS (SELECT t, b, p, {_TURN.format(z='z', cut=1 << 27, by=10723151780598845931)} AS z FROM h),"
    " w AS (SELECT t, b, list(2 * (xor(z, z // 2147483648)::DOUBLE / 18446744073709551616)::FLOAT::DOUBLE - 1 ORDER BY p) AS w FROM i GROUP BY t, b),"
    " k AS (SELECT vec_id, t, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], w) >= 0 THEN 1 << b ELSE 0 END)::INT AS bits FROM embeddings, w GROUP BY vec_id, t)"
)


@query("SELECT 'v' || vec_id AS uri, bits FROM k", _PLANES.format(tables=1, bits=16))
def f_lsh(s, d):
    return _vec(s, d).select("uri", D.signature(F.col("embedding"), 16, 64).alias("bits"))


@query("SELECT DISTINCT q.vec_id AS q, k.vec_id FROM k q JOIN k ON k.t = q.t AND k.bits = q.bits WHERE q.vec_id % 50 = 0 AND k.vec_id % 3 <> 0", _PLANES.format(tables=4, bits=8))
def f_lsh_idx(s, d):
    """Candidates of the rows whose id is divisible by 50 in an index of four tables, out of which those divisible by 3 were taken."""
    v = table(s, d, "embeddings")
    index = D.lsh_remove(D.lsh_index(v, "vec_id", "embedding", 4, 8, 64), v.filter("vec_id % 3 = 0"), "vec_id")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return D.lsh_query(index, asked, "q", "embedding", "vec_id", 4, 8, 64)


_SIM = "v AS (SELECT id, min(e) AS e FROM (SELECT id, pattern_signature::DOUBLE[] AS e FROM antibodies) WHERE id IS NOT NULL AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY id), l AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id < b.id)"


def _similar(s, d):
    v = table(s, d, "antibodies").select("id", F.col("pattern_signature").cast("array<double>").alias("v")).filter(F.size("v") == 64)
    return D.similar_vectors(v, "id", "v", 0.9)


@query("SELECT a, b, round(s, 5) AS similarity FROM l WHERE s >= 0.9", _SIM)
def join_self_similar(s, d):
    return _similar(s, d).withColumn("similarity", F.round("similarity", 5))


@query("+ u AS (SELECT a AS x, b AS y FROM l WHERE s >= 0.9 UNION SELECT b, a FROM l WHERE s >= 0.9), r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON u.x = r.y) SELECT x AS node, least(x, min(y)) AS cluster FROM r GROUP BY x", _SIM)
def g_cc_dedup(s, d):
    """Clusters of at least two patterns that a chain of similar pairs joins."""
    return connected_components(_similar(s, d).select("a", "b")).withColumnRenamed("component", "cluster")


@query("+ v AS (SELECT uri, mvcc_version AS version, arg_min(entry_json, ingested_at) AS j FROM context_versions WHERE uri IS NOT NULL GROUP BY uri, mvcc_version), p AS (SELECT uri, version, j, lag(j) OVER (PARTITION BY uri ORDER BY version) AS b FROM v), k AS (SELECT uri, version, j, b, unnest(list_distinct(list_concat(json_keys(j), json_keys(b)))) AS field FROM p WHERE json_valid(j) AND json_valid(b)) SELECT uri, version, field, json_extract_string(b, '$.' || field) AS old, json_extract_string(j, '$.' || field) AS new FROM k WHERE json_extract_string(b, '$.' || field) IS DISTINCT FROM json_extract_string(j, '$.' || field)", NONE)
def v_semdiff(s, d):
    v = table(s, d, "context_versions").filter("uri is not null").groupBy("uri", F.col("mvcc_version").alias("version")).agg(F.min_by("entry_json", "ingested_at").alias("j"))
    return D.field_changes(v, "uri", "version", "j")


@query("+ r AS (SELECT uri, coalesce(quality, 0.5e0) AS q, (SELECT count(*) FROM fx b WHERE coalesce(b.quality, 0.5e0) > coalesce(fx.quality, 0.5e0)) AS above FROM fx) SELECT uri, CASE WHEN q <= 0.22 THEN 'cull' WHEN above < ceil(0.35 * (SELECT count(*) FROM fx)) THEN 'elite' ELSE 'keep' END AS fate FROM r")
def mk_evolve(s, d):
    return D.generations(entries(s, d).select("uri", F.coalesce("quality", F.lit(0.5)).alias("q")), "q").select("uri", "fate")


@query("+ g AS (SELECT event_id + 1 AS checkpoint, lag(event_id + 1) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS before FROM events) SELECT checkpoint, checkpoint - before AS behind FROM g WHERE checkpoint - before > 8", NONE)
def st_lag(s, d):
    e = table(s, d, "events").withColumn("checkpoint", F.col("event_id") + 1).withColumn("before", F.lag("checkpoint").over(W.partitionBy(F.col("user_id") % 4).orderBy("event_id")))
    return e.select("checkpoint", (F.col("checkpoint") - F.col("before")).alias("behind")).filter("behind > 8")


_TREE = f"WITH RECURSIVE {problems._FIRST_PARENT} SELECT node, root, depth::INT AS depth FROM t"


@query(_TREE)
def g_phylogeny(s, d):
    return problems.p3_hierarchy(s, d).filter("state = 'tree'").select("node", "root", "depth")


query.queries["ln_tree"], query.oracles["ln_tree"] = g_phylogeny, query.oracles["g_phylogeny"]
_WS = "list_distinct(list_filter(regexp_split_to_array(lower(l0), '\\s+'), lambda x: x <> ''))"
_PAIRS = "len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))"
_CONFLICTS = f"cw AS (SELECT *, {_WS} AS w FROM cl), cp AS (SELECT a.uri AS a, b.uri AS b, {_PAIRS} AS s, a.quality AS qa, b.quality AS qb, a.mvcc_version AS ea, b.mvcc_version AS eb FROM cw a JOIN cw b ON a.tenant = b.tenant AND a.content_type = b.content_type AND a.uri < b.uri AND {contra_sql('a.l0', 'b.l0')})"


@query("SELECT a, b, round(s, 6) AS similarity, CASE WHEN s > 0.6 THEN 'Direct' ELSE 'Overlapping' END AS kind FROM cp WHERE s > 0.4 AND s <= 0.8", f"{CLX}, {_CONFLICTS}")
def mk_conflict(s, d):
    return K.text_conflicts(claims(s, d), ["tenant", "content_type"]).withColumn("similarity", F.round("similarity", 6))


query.queries["join_self_conflict"], query.oracles["join_self_conflict"] = mk_conflict, query.oracles["mk_conflict"]


@query("SELECT a, b, CASE WHEN ea > eb AND qa > qb THEN 'KeepFirst' WHEN eb > ea AND qb > qa THEN 'KeepSecond' ELSE 'Defer' END AS verdict FROM cp WHERE s > 0.4 AND s <= 0.8", f"{CLX}, {_CONFLICTS}")
def mk_arbitrate(s, d):
    """Verdict on every conflict; the version stands for the strength of evidence."""
    c = claims(s, d).select("uri", "quality", F.col("mvcc_version").alias("e"))
    p = K.text_conflicts(claims(s, d), ["tenant", "content_type"])
    p = p.join(c.select(F.col("uri").alias("a"), F.col("quality").alias("qa"), F.col("e").alias("ea")), "a").join(c.select(F.col("uri").alias("b"), F.col("quality").alias("qb"), F.col("e").alias("eb")), "b")
    return p.select("a", "b", K.resolve_conflict(F.col("qa"), F.col("qb"), F.col("ea"), F.col("eb")).alias("verdict"))


_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(l0), '[^\\p{L}\\p{N}_-]+'), lambda x: strlen(x) >= 3))"


@query(
    f"+ cw AS (SELECT *, {_TERMS} AS w, coalesce(quality, 0.5) AS q FROM cl WHERE content_type IN ('fact', 'belief', 'hypothesis') AND coalesce(valid_until > TIMESTAMP '2025-01-01', true)),"
    f" p AS (SELECT a.uri AS a, b.uri AS b, {_PAIRS} AS s, abs(a.q - b.q) AS delta, coalesce(list_has_any(a.evidence, b.evidence), false) AS same FROM cw a JOIN cw b ON a.content_type = b.content_type AND a.uri < b.uri AND {claims_sql('a.l0', 'b.l0')})"
    " SELECT a, b, round(s, 6) AS overlap, CASE WHEN round(delta, 9) >= 0.18 THEN 'InvalidateWeaker' WHEN same THEN 'RevalidateBoth' ELSE 'KeepBothContextual' END AS action, round(least(1.0, 0.6 * s + 0.4 * delta), 6) AS priority FROM p WHERE s >= 0.36",
    CLX,
)
def h_guard(s, d):
    return K.guard_plan(claims(s, d), now()).withColumns({c: F.round(c, 6) for c in ("overlap", "priority")})


QUERIES, ORACLES = query.queries, query.oracles
