"""Scans, browsing, predicates, ranking and joins as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import uri as U
from ..functions import vec as V
from ..operators import filters as P
from ..operators import ranking as R
from ..operators import scans as S
from ..tables import table
from .fixtures import FX, Catalog, entries, now

query = Catalog()
SEL = "uri, l0 AS content, {r} AS relevance, content_type"


@query("SELECT uri, l0 AS content, 0.9e0 AS relevance, content_type FROM fx WHERE content_type = 'fact' AND tenant LIKE 't-%'")
def scan_type(s, d):
    return S.hits(S.by_type(entries(s, d), "fact", F.col("tenant").startswith("t-")), 0.9)


@query("SELECT uri, l0 AS content, 0.8e0 AS relevance, content_type FROM fx WHERE uri = (SELECT min(regexp_extract(uri, '^uwu://[^/]+/agent/[^/]+')) FROM fx) OR starts_with(uri, (SELECT min(regexp_extract(uri, '^uwu://[^/]+/agent/[^/]+')) FROM fx) || '/')")
def scan_prefix(s, d):
    e = entries(s, d)
    p = e.agg(F.min(F.regexp_extract("uri", "^uwu://[^/]+/agent/[^/]+", 0))).first()[0]
    return S.hits(S.by_prefix(e, p), 0.8)


@query("SELECT uri, l0 AS content, 0.5e0 AS relevance, content_type FROM fx")
def scan_full(s, d):
    return S.hits(entries(s, d), 0.5)


@query("SELECT uri, CAST(NULL AS VARCHAR) AS x, content_type FROM fx WHERE content_type IN ('skill','procedure') AND contains(uri || '/', '/memory/skill/')")
def scan_helper(s, d):
    e = entries(s, d).filter(F.col("content_type").isin("skill", "procedure"))
    return e.filter(F.contains(F.concat("uri", F.lit("/")), F.lit("/memory/skill/"))).select("uri", F.lit(None).cast("string").alias("x"), "content_type")


@query("SELECT uri, tenant FROM fx WHERE split_part(uri, '/', 3) = (SELECT min(tenant) FROM fx)")
def scope_prefix(s, d):
    e = entries(s, d)
    return e.filter(P.in_tenant(e.agg(F.min("tenant")).first()[0])).select("uri", "tenant")


@query("+ p AS (SELECT uri FROM fx WHERE uri > 'uwu://t-m' ORDER BY uri LIMIT 51), q AS (SELECT uri FROM p ORDER BY uri LIMIT 50) SELECT uri, CASE WHEN (SELECT count(*) FROM p) > 50 THEN (SELECT max(uri) FROM q) END AS next_cursor FROM q")
def scan_by_prefix(s, d):
    return S.page(entries(s, d).select("uri"), "uri", "uwu://t-m", 50)


@query("+ p AS (SELECT uri FROM fx WHERE content_type = 'goal' ORDER BY uri LIMIT 21), q AS (SELECT uri FROM p ORDER BY uri LIMIT 20) SELECT uri, CASE WHEN (SELECT count(*) FROM p) > 20 THEN (SELECT max(uri) FROM q) END AS next_cursor FROM q")
def scan_by_type(s, d):
    return S.page(S.by_type(entries(s, d), "goal").select("uri"), "uri", None, 20)


query.queries["page_keyset"], query.oracles["page_keyset"] = scan_by_type, query.oracles["scan_by_type"]


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("uri"), "vec_id", F.col("embedding"), (F.col("label") % 2).alias("collection"), "label")


VEC = "q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT 'v' || vec_id AS uri, vec_id, embedding::DOUBLE[] AS e, label % 2 AS collection, label FROM embeddings)"


def _query_vector(s, d):
    return [float(x) for x in table(s, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


@query("SELECT uri, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, q WHERE collection = 0 ORDER BY list_cosine_similarity(v.e, q.e) DESC, uri LIMIT 20", VEC)
def vec_search(s, d):
    return S.vector_search(_vectors(s, d), _query_vector(s, d), 20, F.col("collection") == 0).select("uri", F.round("score", 6).alias("score"))


@query("SELECT 'v' || vec_id AS uri, len(embedding) = 64 AS ok FROM embeddings", "")
def vec_validate(s, d):
    return _vectors(s, d).select("uri", V.valid(F.col("embedding"), 64).alias("ok"))


@query("SELECT collection, count(*) AS n, min(len(e)) AS dim, min(len(e)) = max(len(e)) AS one_space FROM v GROUP BY collection", VEC)
def vec_space(s, d):
    v = _vectors(s, d).groupBy("collection").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("bigint").alias("dim"), (F.min(F.size("embedding")) == F.max(F.size("embedding"))).alias("one_space"))
    return v


@query("SELECT uri, label FROM v WHERE uri IN (SELECT 'v' || (event_id * 3) FROM events)", VEC)
def vec_get_many(s, d):
    asked = table(s, d, "events").select(F.concat(F.lit("v"), (F.col("event_id") * 3).cast("string")).alias("uri")).distinct()
    return _vectors(s, d).join(asked, "uri", "left_semi").select("uri", "label")


@query("SELECT uri, round(sqrt(list_dot_product(e, e)), 4) AS norm FROM v WHERE label <> 3", VEC)
def vec_port(s, d):
    kept = _vectors(s, d).filter("label <> 3")
    return kept.select("uri", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


_LS = """+ r AS (SELECT substr(uri, length('uwu://') + 1) AS rest, l0 FROM fx)
 SELECT split_part(rest, '/', 1) AS name, bool_or(contains(rest, '/')) AS is_dir, coalesce(max(CASE WHEN NOT contains(rest, '/') THEN l0 END), '') AS abstract FROM r GROUP BY 1"""


@query(_LS)
def fs_ls(s, d):
    return S.children(entries(s, d), "uwu:/")


@query(_LS)
def fs_ls_group(s, d):
    return S.children(entries(s, d), "uwu:/")


@query("SELECT uri, content_type FROM fx WHERE split_part(uri, '/', -1) LIKE '%a_' AND content_type = 'error'")
def fs_find(s, d):
    return S.find(entries(s, d), None, "*a?", "error").select("uri", "content_type")


@query("SELECT uri FROM fx WHERE split_part(uri, '/', -1) LIKE '_a%'")
def fs_glob(s, d):
    return S.find(entries(s, d), "uwu:/", "?a*").select("uri")


_GREP = "SELECT uri, length(CASE WHEN contains(lower(l0), 'index') THEN l0 ELSE l1 END) AS n FROM fx WHERE contains(lower(l0), 'index') OR contains(lower(l1), 'index')"


@query(_GREP)
def fs_grep(s, d):
    return S.grep(entries(s, d), "Index").select("uri", F.length("matched").alias("n"))


@query(_GREP.replace("index", "é"))
def fs_grep_uni(s, d):
    return S.grep(entries(s, d), "É").select("uri", F.length("matched").alias("n"))


_TREE = """+ b AS (SELECT string_split(substr(uri, 7), '/') AS s FROM fx), n AS (SELECT s, unnest(range(1, least(len(s), 3) + 1)) AS level FROM b)
 SELECT 'uwu://' || array_to_string(s[1:level], '/') AS node, level::INT AS level, bool_or(len(s) = level) AS is_entry FROM n GROUP BY ALL"""


@query(_TREE)
def fs_tree(s, d):
    return S.tree(entries(s, d), "uwu:/", 3)


@query(_TREE.replace("least(len(s), 3)", "least(len(s), 6)"))
def fs_tree_build(s, d):
    return S.tree(entries(s, d), "uwu:/", 6)


@query("SELECT uri, 'L1' AS level, coalesce(l1, l0) AS content FROM fx")
def fs_read(s, d):
    return S.read(entries(s, d), "L1")


@query("SELECT DISTINCT tenant FROM fx")
def list_tenants(s, d):
    return entries(s, d).select("tenant").distinct()


@query("+ w AS (SELECT DISTINCT uri FROM context_versions WHERE uri IS NOT NULL) SELECT w.uri, fx.uri IS NOT NULL AS found, l0 FROM w LEFT JOIN fx USING (uri)")
def batch_read(s, d):
    return S.read_many(entries(s, d), table(s, d, "context_versions").select("uri").filter("uri is not null").distinct())


@query("+ w AS (SELECT word AS pattern FROM common_words WHERE length(word) >= 6) SELECT DISTINCT pattern, uri FROM fx JOIN w ON contains(lower(l0), lower(pattern))")
def batch_grep(s, d):
    w = table(s, d, "common_words").filter(F.length("word") >= 6).select(F.col("word").alias("pattern"), F.lit(None).cast("string").alias("scope")).distinct()
    return S.grep_many(entries(s, d), w)


@query("SELECT tenant, count(*) AS n, min(uri) AS first_uri FROM fx WHERE content_type = 'fact' GROUP BY tenant")
def part_find(s, d):
    return S.by_type(entries(s, d), "fact").groupBy("tenant").agg(F.count("*").alias("n"), F.min("uri").alias("first_uri"))


@query("SELECT uri, regexp_matches(uri, '^uwu://[^/?#\\s][^?#\\s]*') AS ok, tenant, len(string_split(substr(uri, 7), '/')) AS n FROM fx")
def uri_parse(s, d):
    return entries(s, d).select("uri", U.is_valid(F.col("uri")).alias("ok"), U.tenant(F.col("uri")).alias("tenant"), F.size(U.segments(F.col("uri"))).cast("bigint").alias("n"))


@query("SELECT uri, mvcc_version || '' AS version, 'L' || (mvcc_version % 3) AS level FROM fx")
def uri_query(s, d):
    made = entries(s, d).withColumn("u", F.concat("uri", F.lit("?as_of="), F.col("mvcc_version"), F.lit("&level=L"), F.col("mvcc_version") % 3))
    q = U.query_params(F.col("u"))
    return made.select(U.without_query(F.col("u")).alias("uri"), q["as_of"].alias("version"), q["level"].alias("level"))


@query("SELECT uri, regexp_replace(uri, '/[^/]+$', '') AS parent, regexp_replace(uri, '/[^/]+$', '') || '/x' AS sibling, len(string_split(uri, '/')) - 3 AS depth FROM fx")
def uri_parent(s, d):
    u = F.col("uri")
    return entries(s, d).select("uri", U.parent(u).alias("parent"), U.join(U.parent(u), F.lit("/x")).alias("sibling"), U.depth(u).cast("bigint").alias("depth"))


@query("SELECT uri, split_part(uri, '/', 4) AS category FROM fx")
def uri_category(s, d):
    return entries(s, d).select("uri", U.category(F.col("uri")).alias("category"))


# predicates


def _keep(name, sql, *conditions):
    def run(s, d):
        return P.where(entries(s, d), [c() for c in conditions]).select("uri")

    run.__name__ = name
    query(f"+ n AS (SELECT t FROM t0) SELECT uri FROM fx, n WHERE {sql}")(run)


_VALID = "invalidated_by IS NULL AND valid_from <= t AND (valid_until IS NULL OR valid_until > t)"
_keep("p_type", "content_type = 'goal'", lambda: P.type_equals("goal"))
_keep("p_scope", "contains(uri || '/', '/agent/' || (SELECT 'agent-orloma38') || '/') OR false", lambda: P.in_agent("agent-orloma38"))
_keep("p_txtime", "updated_at BETWEEN TIMESTAMP '2024-06-01' AND t", lambda: P.written_between(F.lit("2024-06-01").cast("timestamp_ntz"), now()))
_keep("p_valid_at", _VALID, lambda: P.valid_at(now()))
_keep("p_validonly", _VALID, lambda: P.valid_at(now()))
_keep("p_valid_overlap", "valid_from <= t AND (valid_until IS NULL OR valid_until >= TIMESTAMP '2024-11-01')", lambda: P.valid_overlaps(F.lit("2024-11-01").cast("timestamp_ntz"), now()))
_keep("p_timeline", "valid_from <= t AND (valid_until IS NULL OR valid_until >= t)", lambda: P.timeline_valid(now()))
_keep("p_bitemporal", _VALID + " AND updated_at <= TIMESTAMP '2024-09-01'", lambda: P.known_and_valid(now(), F.lit("2024-09-01").cast("timestamp_ntz")))
_keep("p_tags", "list_contains(tags, 'en') AND list_contains(tags, 'audit')", lambda: P.has_tags("en", "audit"))
_keep("p_quality", "quality >= 0.5", lambda: P.quality_above(0.5))
_keep("filter", "content_type = 'fact' AND quality >= 0.3 AND " + _VALID, lambda: P.type_equals("fact"), lambda: P.quality_above(0.3), lambda: P.valid_at(now()))
_keep("pred_eval", "list_contains(tags, 'en') AND quality >= 0.2 AND updated_at <= t", lambda: P.has_tags("en"), lambda: P.quality_above(0.2), lambda: F.col("updated_at") <= now())


@query("SELECT uri, l0 AS content, coalesce(quality, 0.5e0) AS relevance, content_type FROM fx")
def proj_hit(s, d):
    return S.hits(entries(s, d), F.coalesce("quality", F.lit(0.5)))


@query("SELECT uri, md5(l0 || chr(10) || coalesce(l1, '') || chr(10) || coalesce(l2, '')) AS h FROM fx")
def proj_index(s, d):
    return entries(s, d).select("uri", F.md5(F.concat_ws("\n", "l0", F.coalesce("l1", F.lit("")), F.coalesce("l2", F.lit("")))).alias("h"))


@query("SELECT uri, coalesce(l0, '') AS sparse FROM fx")
def proj_sparse(s, d):
    return entries(s, d).select("uri", F.coalesce("l0", F.lit("")).alias("sparse"))


@query("SELECT uri, CASE WHEN ceil(length(coalesce(l2, '')) / 4) <= 400 THEN 'L2' WHEN ceil(length(coalesce(l1, '')) / 4) <= 100 THEN 'L1' ELSE 'L0' END AS level FROM fx")
def proj_budget(s, d):
    e = entries(s, d)
    return e.select("uri", F.when(T.approx_tokens(F.col("l2")) <= 400, "L2").when(T.approx_tokens(F.col("l1")) <= 100, "L1").otherwise("L0").alias("level"))


@query("SELECT uri, CASE WHEN length(l0) > 40 THEN substr(l0, 1, 40) || '...' ELSE l0 END AS preview FROM fx")
def proj_preview(s, d):
    return entries(s, d).select("uri", T.preview(F.col("l0"), 40).alias("preview"))


def _rules(s, d):
    e = entries(s, d).select(F.concat(F.lit("uwu://"), "tenant").alias("prefix")).distinct()
    return e.select("prefix", F.when(F.length("prefix") % 2 == 0, "allow").otherwise("deny").alias("effect"), F.lit(1).alias("priority"))


for _name in ("acl_check", "acl_filter"):

    def _acl(s, d):
        return P.allowed(entries(s, d), _rules(s, d)).select("uri")

    _acl.__name__ = _name
    query("SELECT uri FROM fx WHERE length('uwu://' || tenant) % 2 = 0")(_acl)


@query("SELECT uri FROM fx WHERE starts_with(uri, 'uwu://t-moti/')")
def pack_scope(s, d):
    return S.by_prefix(entries(s, d), "uwu://t-moti").select("uri")


@query("SELECT DISTINCT c.uri FROM context_entries c JOIN (SELECT split_part(uri, '/', 3) AS t, min(tenant_id) AS m FROM context_entries GROUP BY 1) x ON x.t = split_part(c.uri, '/', 3) WHERE c.tenant_id = x.m")
def tenant_bind(s, d):
    c = table(s, d, "context_entries").withColumn("t", U.tenant(F.col("uri")))
    home = c.groupBy("t").agg(F.min("tenant_id").alias("home"))
    return c.join(home, "t").filter("tenant_id = home").select("uri").distinct()


# ranking


def _ranked(s, d):
    return S.hits(entries(s, d), F.round((F.length("l0") % 37) / 37, 6)).join(entries(s, d).select("uri", "quality", "updated_at", "created_at", "tenant"), "uri")


RX = f"{FX}, rx AS (SELECT *, round((length(l0) % 37) / 37.0e0, 6) AS relevance FROM fx)"


def _sorted(name, by, sql):
    def run(s, d):
        return R.top(_ranked(s, d), 30, *R.order(by)).select("uri")

    run.__name__ = name
    query(f"SELECT uri FROM rx ORDER BY {sql}, uri LIMIT 30", RX)(run)


_sorted("sort", "relevance", "relevance DESC")
_sorted("sort_recency", "recency", "updated_at DESC")
_sorted("sort_quality", "quality", "quality DESC NULLS LAST")
_sorted("limit", "natural", "1")
query.oracles["limit"] = f"WITH {RX} SELECT uri FROM rx ORDER BY uri LIMIT 30"
_sorted("topk_rerank", "relevance", "relevance DESC")


def _children(s, d):
    r = _ranked(s, d)
    return [r.filter("relevance >= 0.5").select("uri", "relevance"), r.filter("quality >= 0.4").select("uri", (F.col("relevance") / 2).alias("relevance")), r.filter("content_type = 'nothing'").select("uri", "relevance")]


KIDS = f"{RX}, k AS (SELECT uri, relevance, 0 AS c FROM rx WHERE relevance >= 0.5 UNION ALL SELECT uri, relevance / 2, 1 FROM rx WHERE quality >= 0.4)"


@query("SELECT uri, round(relevance, 6) AS relevance FROM k", KIDS)
def union(s, d):
    return R.union(_children(s, d)).select("uri", F.round("relevance", 6).alias("relevance"))


@query("SELECT uri, round(max(relevance), 6) AS relevance FROM k GROUP BY uri", KIDS)
def dedup(s, d):
    return R.best_of_each(R.union(_children(s, d))).select("uri", F.round("relevance", 6).alias("relevance"))


@query("SELECT uri, round(max(relevance), 6) AS relevance FROM k GROUP BY uri HAVING count(DISTINCT c) = 2", KIDS)
def intersect(s, d):
    return R.intersect(_children(s, d)[:2]).select("uri", F.round("relevance", 6).alias("relevance"))


@query("SELECT uri, round(relevance, 6) AS relevance FROM k WHERE c = 0", KIDS)
def first(s, d):
    return R.first_non_empty(_children(s, d)[::-1][:1] + _children(s, d)).select("uri", F.round("relevance", 6).alias("relevance"))


@query("SELECT uri, round(max(0.35*relevance+0.20*coalesce(quality,0.5)+0.15*relevance+0.15*(mvcc_version%4)/3.0e0+0.10+0.05),6) AS score FROM rx GROUP BY uri ORDER BY max(0.35*relevance+0.20*coalesce(quality,0.5)+0.15*relevance+0.15*(mvcc_version%4)/3.0e0+0.10+0.05) DESC, uri LIMIT 25", RX)
def fed_topk(s, d):
    h = _ranked(s, d).join(entries(s, d).select("uri", "mvcc_version"), "uri")
    h = h.select("uri", F.col("relevance").alias("noisy"), F.coalesce("quality", F.lit(0.5)).alias("quality"), F.col("relevance").alias("reputation"), ((F.col("mvcc_version") % 4) / 3).alias("corroboration"), F.lit(1.0).alias("lineage"), F.lit(1.0).alias("licence"))
    return R.federated_top(h, 25).select("uri", F.round("score", 6).alias("score"))


@query("SELECT uri, round(0.58*relevance+0.24*coalesce(quality,0.5)+0.14*0.5+0.04*0.1,6) AS score FROM rx", RX)
def learned_rerank(s, d):
    return _ranked(s, d).select("uri", F.round(R.learned_score(F.col("relevance"), F.coalesce("quality", F.lit(0.5)), F.lit(0.5), F.lit(0.1)), 6).alias("score"))


@query("SELECT uri, round(0.4*relevance+0.3*exp(-floor(epoch(t - updated_at)/3600)/24.0e0/30)+0.3*0.8*coalesce(quality,0.5),6) AS score FROM rx, t0", RX)
def hybrid_score(s, d):
    age = F.floor(F.timestamp_diff("SECOND", F.col("updated_at"), now()) / 3600) / 24
    return _ranked(s, d).select("uri", F.round(R.hybrid_score(F.col("relevance"), age, F.lit(0.8), F.coalesce("quality", F.lit(0.5))), 6).alias("score"))


# joins


@query("SELECT fx.uri AS uri_left, v.uri AS uri_right FROM fx JOIN (SELECT DISTINCT uri FROM context_versions) v ON v.uri = fx.uri")
def join_hash(s, d):
    """Entries that have a history."""
    return R.equi_join(entries(s, d), table(s, d, "context_versions").select("uri").distinct(), "uri").drop("k")


@query("SELECT uri AS uri_left, min(uri) OVER (PARTITION BY sha256(l2)) AS uri_right FROM fx WHERE trim(l2) <> ''")
def join_content_hash(s, d):
    """Every entry beside the first one of the same content; copies are not paired with each other."""
    e = entries(s, d).filter("trim(l2) <> ''").select("uri", "l2", F.sha2("l2", 256).alias("h"))
    first = e.groupBy("h").agg(F.min("uri").alias("uri"), F.first("l2").alias("l2"))
    return R.equi_join(e, first, "content").drop("k")


@query("+ w AS (SELECT DISTINCT uri FROM context_versions WHERE uri IS NOT NULL) SELECT w.uri, fx.uri IS NOT NULL AS found, l0 FROM w LEFT JOIN fx USING (uri)")
def batch_read(s, d):
    return S.read_many(entries(s, d), table(s, d, "context_versions").select("uri").filter("uri is not null").distinct())


@query("+ w AS (SELECT word AS pattern FROM common_words WHERE length(word) >= 6) SELECT DISTINCT pattern, uri FROM fx JOIN w ON contains(lower(l0), lower(pattern))")
def batch_grep(s, d):
    w = table(s, d, "common_words").filter(F.length("word") >= 6).select(F.col("word").alias("pattern"), F.lit(None).cast("string").alias("scope")).distinct()
    return S.grep_many(entries(s, d), w)


@query("SELECT tenant, count(*) AS n, min(uri) AS first_uri FROM fx WHERE content_type = 'fact' GROUP BY tenant")
def part_find(s, d):
    return S.by_type(entries(s, d), "fact").groupBy("tenant").agg(F.count("*").alias("n"), F.min("uri").alias("first_uri"))


@query("SELECT uri, regexp_matches(uri, '^uwu://[^/?#\\s][^?#\\s]*') AS ok, tenant, len(string_split(substr(uri, 7), '/')) AS n FROM fx")
def uri_parse(s, d):
    return entries(s, d).select("uri", U.is_valid(F.col("uri")).alias("ok"), U.tenant(F.col("uri")).alias("tenant"), F.size(U.segments(F.col("uri"))).cast("bigint").alias("n"))


@query("SELECT uri, mvcc_version || '' AS version, 'L' || (mvcc_version % 3) AS level FROM fx")
def uri_query(s, d):
    made = entries(s, d).withColumn("u", F.concat("uri", F.lit("?as_of="), F.col("mvcc_version"), F.lit("&level=L"), F.col("mvcc_version") % 3))
    q = U.query_params(F.col("u"))
    return made.select(U.without_query(F.col("u")).alias("uri"), q["as_of"].alias("version"), q["level"].alias("level"))


@query("SELECT uri, regexp_replace(uri, '/[^/]+$', '') AS parent, regexp_replace(uri, '/[^/]+$', '') || '/x' AS sibling, len(string_split(uri, '/')) - 3 AS depth FROM fx")
def uri_parent(s, d):
    u = F.col("uri")
    return entries(s, d).select("uri", U.parent(u).alias("parent"), U.join(U.parent(u), F.lit("/x")).alias("sibling"), U.depth(u).cast("bigint").alias("depth"))


@query("SELECT uri, split_part(uri, '/', 4) AS category FROM fx")
def uri_category(s, d):
    return entries(s, d).select("uri", U.category(F.col("uri")).alias("category"))


# predicates


def _keep(name, sql, *conditions):
    def run(s, d):
        return P.where(entries(s, d), [c() for c in conditions]).select("uri")

    run.__name__ = name
    query(f"+ n AS (SELECT t FROM t0) SELECT uri FROM fx, n WHERE {sql}")(run)


_VALID = "invalidated_by IS NULL AND valid_from <= t AND (valid_until IS NULL OR valid_until > t)"
_keep("p_type", "content_type = 'goal'", lambda: P.type_equals("goal"))
_keep("p_scope", "contains(uri || '/', '/agent/' || (SELECT 'agent-orloma38') || '/') OR false", lambda: P.in_agent("agent-orloma38"))
_keep("p_txtime", "updated_at BETWEEN TIMESTAMP '2024-06-01' AND t", lambda: P.written_between(F.lit("2024-06-01").cast("timestamp_ntz"), now()))
_keep("p_valid_at", _VALID, lambda: P.valid_at(now()))
_keep("p_validonly", _VALID, lambda: P.valid_at(now()))
_keep("p_valid_overlap", "valid_from <= t AND (valid_until IS NULL OR valid_until >= TIMESTAMP '2024-11-01')", lambda: P.valid_overlaps(F.lit("2024-11-01").cast("timestamp_ntz"), now()))
_keep("p_timeline", "valid_from <= t AND (valid_until IS NULL OR valid_until >= t)", lambda: P.timeline_valid(now()))
_keep("p_bitemporal", _VALID + " AND updated_at <= TIMESTAMP '2024-09-01'", lambda: P.known_and_valid(now(), F.lit("2024-09-01").cast("timestamp_ntz")))
_keep("p_tags", "list_contains(tags, 'en') AND list_contains(tags, 'audit')", lambda: P.has_tags("en", "audit"))
_keep("p_quality", "quality >= 0.5", lambda: P.quality_above(0.5))
_keep("filter", "content_type = 'fact' AND quality >= 0.3 AND " + _VALID, lambda: P.type_equals("fact"), lambda: P.quality_above(0.3), lambda: P.valid_at(now()))
_keep("pred_eval", "list_contains(tags, 'en') AND quality >= 0.2 AND updated_at <= t", lambda: P.has_tags("en"), lambda: P.quality_above(0.2), lambda: F.col("updated_at") <= now())


@query("SELECT uri, l0 AS content, coalesce(quality, 0.5e0) AS relevance, content_type FROM fx")
def proj_hit(s, d):
    return S.hits(entries(s, d), F.coalesce("quality", F.lit(0.5)))


@query("SELECT uri, md5(l0 || chr(10) || coalesce(l1, '') || chr(10) || coalesce(l2, '')) AS h FROM fx")
def proj_index(s, d):
    return entries(s, d).select("uri", F.md5(F.concat_ws("\n", "l0", F.coalesce("l1", F.lit("")), F.coalesce("l2", F.lit("")))).alias("h"))


@query("SELECT uri, coalesce(l0, '') AS sparse FROM fx")
def proj_sparse(s, d):
    return entries(s, d).select("uri", F.coalesce("l0", F.lit("")).alias("sparse"))


@query("SELECT uri, CASE WHEN ceil(length(coalesce(l2, '')) / 4) <= 400 THEN 'L2' WHEN ceil(length(coalesce(l1, '')) / 4) <= 100 THEN 'L1' ELSE 'L0' END AS level FROM fx")
def proj_budget(s, d):
    e = entries(s, d)
    return e.select("uri", F.when(T.approx_tokens(F.col("l2")) <= 400, "L2").when(T.approx_tokens(F.col("l1")) <= 100, "L1").otherwise("L0").alias("level"))


@query("SELECT uri, CASE WHEN length(l0) > 40 THEN substr(l0, 1, 40) || '...' ELSE l0 END AS preview FROM fx")
def proj_preview(s, d):
    return entries(s, d).select("uri", T.preview(F.col("l0"), 40).alias("preview"))


def _rules(s, d):
    e = entries(s, d).select(F.concat(F.lit("uwu://"), "tenant").alias("prefix")).distinct()
    return e.select("prefix", F.when(F.length("prefix") % 2 == 0, "allow").otherwise("deny").alias("effect"), F.lit(1).alias("priority"))


for _name in ("acl_check", "acl_filter"):

    def _acl(s, d):
        return P.allowed(entries(s, d), _rules(s, d)).select("uri")

    _acl.__name__ = _name
    query("SELECT uri FROM fx WHERE length('uwu://' || tenant) % 2 = 0")(_acl)


@query("SELECT uri FROM fx WHERE starts_with(uri, 'uwu://t-moti/')")
def pack_scope(s, d):
    return S.by_prefix(entries(s, d), "uwu://t-moti").select("uri")


@query("SELECT a.uri, coalesce(b.l0, a.l0) AS text FROM fx a LEFT JOIN (SELECT * FROM fx WHERE content_type = 'profile') b ON b.uri = a.uri WHERE a.content_type IN ('profile', 'goal')")
def inherit_resolve(s, d):
    e = entries(s, d).filter(F.col("content_type").isin("profile", "goal"))
    own = e.filter("content_type = 'profile'").select("uri", F.col("l0").alias("own"))
    return e.join(own, "uri", "left").select("uri", F.coalesce("own", "l0").alias("text"))


@query("+ v AS (SELECT DISTINCT lang, min(word) AS w FROM common_words GROUP BY lang) SELECT 'uwu://{tenant}/tmpl' || lang AS template, replace('hello {w}', '{w}', w) AS text FROM v")
def tmpl_inst(s, d):
    v = table(s, d, "common_words").groupBy("lang").agg(F.min("word").alias("w"))
    return v.select(F.concat(F.lit("uwu://{tenant}/tmpl"), "lang").alias("template"), F.replace(F.lit("hello {w}"), F.lit("{w}"), F.col("w")).alias("text"))


@query("SELECT DISTINCT c.uri FROM context_entries c JOIN (SELECT split_part(uri, '/', 3) AS t, min(tenant_id) AS m FROM context_entries GROUP BY 1) x ON x.t = split_part(c.uri, '/', 3) WHERE c.tenant_id = x.m")
def tenant_bind(s, d):
    c = table(s, d, "context_entries").withColumn("t", U.tenant(F.col("uri")))
    home = c.groupBy("t").agg(F.min("tenant_id").alias("home"))
    return c.join(home, "t").filter("tenant_id = home").select("uri").distinct()


# ranking


def _ranked(s, d):
    return S.hits(entries(s, d), F.round((F.length("l0") % 37) / 37, 6)).join(entries(s, d).select("uri", "quality", "updated_at", "created_at", "tenant"), "uri")


RX = f"{FX}, rx AS (SELECT *, round((length(l0) % 37) / 37.0e0, 6) AS relevance FROM fx)"


def _sorted(name, by, sql):
    def run(s, d):
        return R.top(_ranked(s, d), 30, *R.order(by)).select("uri")

    run.__name__ = name
    query(f"SELECT uri FROM rx ORDER BY {sql}, uri LIMIT 30", RX)(run)


_sorted("sort", "relevance", "relevance DESC")
_sorted("sort_recency", "recency", "updated_at DESC")
_sorted("sort_quality", "quality", "quality DESC NULLS LAST")
_sorted("limit", "natural", "1")
query.oracles["limit"] = f"WITH {RX} SELECT uri FROM rx ORDER BY uri LIMIT 30"
_sorted("topk_rerank", "relevance", "relevance DESC")


def _children(s, d):
    r = _ranked(s, d)
    return [r.filter("relevance >= 0.5").select("uri", "relevance"), r.filter("quality >= 0.4").select("uri", (F.col("relevance") / 2).alias("relevance")), r.filter("content_type = 'nothing'").select("uri", "relevance")]


KIDS = f"{RX}, k AS (SELECT uri, relevance, 0 AS c FROM rx WHERE relevance >= 0.5 UNION ALL SELECT uri, relevance / 2, 1 FROM rx WHERE quality >= 0.4)"


@query("SELECT uri, round(relevance, 6) AS relevance FROM k", KIDS)
def union(s, d):
    return R.union(_children(s, d)).select("uri", F.round("relevance", 6).alias("relevance"))


@query("SELECT uri, round(max(relevance), 6) AS relevance FROM k GROUP BY uri", KIDS)
def dedup(s, d):
    return R.best_of_each(R.union(_children(s, d))).select("uri", F.round("relevance", 6).alias("relevance"))


@query("SELECT uri, round(max(relevance), 6) AS relevance FROM k GROUP BY uri HAVING count(DISTINCT c) = 2", KIDS)
def intersect(s, d):
    return R.intersect(_children(s, d)[:2]).select("uri", F.round("relevance", 6).alias("relevance"))


@query("SELECT uri, round(relevance, 6) AS relevance FROM k WHERE c = 0", KIDS)
def first(s, d):
    return R.first_non_empty(_children(s, d)[::-1][:1] + _children(s, d)).select("uri", F.round("relevance", 6).alias("relevance"))


@query("SELECT uri, round(max(0.35*relevance+0.20*coalesce(quality,0.5)+0.15*relevance+0.15*(mvcc_version%4)/3.0e0+0.10+0.05),6) AS score FROM rx GROUP BY uri ORDER BY max(0.35*relevance+0.20*coalesce(quality,0.5)+0.15*relevance+0.15*(mvcc_version%4)/3.0e0+0.10+0.05) DESC, uri LIMIT 25", RX)
def fed_topk(s, d):
    h = _ranked(s, d).join(entries(s, d).select("uri", "mvcc_version"), "uri")
    h = h.select("uri", F.col("relevance").alias("noisy"), F.coalesce("quality", F.lit(0.5)).alias("quality"), F.col("relevance").alias("reputation"), ((F.col("mvcc_version") % 4) / 3).alias("corroboration"), F.lit(1.0).alias("lineage"), F.lit(1.0).alias("licence"))
    return R.federated_top(h, 25).select("uri", F.round("score", 6).alias("score"))


@query("SELECT uri, round(0.58*relevance+0.24*coalesce(quality,0.5)+0.14*0.5+0.04*0.1,6) AS score FROM rx", RX)
def learned_rerank(s, d):
    return _ranked(s, d).select("uri", F.round(R.learned_score(F.col("relevance"), F.coalesce("quality", F.lit(0.5)), F.lit(0.5), F.lit(0.1)), 6).alias("score"))


@query("SELECT uri, round(0.4*relevance+0.3*exp(-floor(epoch(t - updated_at)/3600)/24.0e0/30)+0.3*0.8*coalesce(quality,0.5),6) AS score FROM rx, t0", RX)
def hybrid_score(s, d):
    age = F.floor(F.timestamp_diff("SECOND", F.col("updated_at"), now()) / 3600) / 24
    return _ranked(s, d).select("uri", F.round(R.hybrid_score(F.col("relevance"), age, F.lit(0.8), F.coalesce("quality", F.lit(0.5))), 6).alias("score"))


# joins


def _halves(s, d):
    e = entries(s, d)
    return e.filter("mvcc_version % 2 = 0"), e.filter("mvcc_version % 3 = 0")


@query("SELECT a.uri AS uri_left, b.uri AS uri_right FROM fx a JOIN fx b ON a.uri = b.uri WHERE a.mvcc_version % 2 = 0 AND b.mvcc_version % 3 = 0")
def join_hash(s, d):
    return R.equi_join(*_halves(s, d), "uri").drop("k")


@query("SELECT a.uri AS uri_left, b.uri AS uri_right FROM fx a JOIN fx b ON sha256(a.l2) = sha256(b.l2) WHERE a.mvcc_version % 2 = 0 AND b.mvcc_version % 3 = 0 AND trim(a.l2) <> ''")
def join_content_hash(s, d):
    a, b = _halves(s, d)
    return R.equi_join(a.filter("trim(l2) <> ''"), b, "content").drop("k")


@query("+ w AS (SELECT DISTINCT uri FROM context_versions WHERE uri IS NOT NULL) SELECT w.uri, coalesce(fx.l0, '(missing)') AS content FROM w LEFT JOIN fx USING (uri)")
def join_lookup(s, d):
    h = table(s, d, "context_versions").select("uri").filter("uri is not null").distinct()
    return h.join(entries(s, d).select("uri", "l0"), "uri", "left").select("uri", F.coalesce("l0", F.lit("(missing)")).alias("content"))


@query("+ w AS (SELECT lang, min(word) AS w FROM common_words GROUP BY lang) SELECT lang, count(*) AS n FROM fx JOIN w ON contains(l0, w) GROUP BY lang")
def join_nl(s, d):
    w = table(s, d, "common_words").groupBy("lang").agg(F.min("word").alias("w"))
    return entries(s, d).join(F.broadcast(w), F.contains("l0", "w")).groupBy("lang").agg(F.count("*").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
