"""Claims, guards, inheritance, templates, wiki pages, rebasing, retrieval by community as queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import beliefs as B
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import versioning as VS
from ..operators.hierarchy import paths, places
from ..scratch import keep, shared_dir
from ..sources import wiki
from ..tables import table
from .fixtures import CLX, CX, EX, FX, NOW, Catalog, claims, commits, edges, entries, now
from .q_graph import _rank_sql
from .q_scalars import claims_sql

query = Catalog()
_SPLIT = "list_filter(list_transform(regexp_split_to_array({c}, '[.;\\n。；]'), lambda s: trim(regexp_replace(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}\\s_=:!-]', ' ', 'g'), '\\s+', ' ', 'g'))), lambda s: s <> '')"
_DENY = ["not", "never", "no", "cannot", "can't", "does not", "do not", "without", "false", "禁用", "不能", "不会", "不是", "不支持", "无"]
_q = lambda m: m.replace("'", "''")
_CLAIM = "CASE " + " ".join(f"WHEN starts_with(s, '{_q(m)}') THEN substr(s, {len(m) + 1}) WHEN contains(s, ' {_q(m)} ') THEN substr(s, 1, instr(s, ' {_q(m)} ') - 1) || ' ' || substr(s, instr(s, ' {_q(m)} ') + {len(m) + 2})" for m in _DENY) + " ELSE s END"
_DENIED = "(" + " OR ".join(f"starts_with(s, '{_q(m)}') OR contains(s, ' {_q(m)} ')" for m in _DENY) + ")"
_LIT = f"""ls AS (SELECT uri, unnest({_SPLIT.format(c='l0')}) AS s FROM {{src}}),
 lk AS (SELECT *, CASE WHEN contains(s, '!=') THEN '!=' WHEN contains(s, '=') THEN '=' WHEN contains(s, ':') THEN ':' END AS sep FROM ls),
 lp AS (SELECT *, trim(substr(s, 1, instr(s, sep) - 1)) AS l, trim(substr(s, instr(s, sep) + length(sep))) AS r, list_filter(string_split({_CLAIM}, ' '), lambda w: w NOT IN ('', 'the', 'a', 'an', 'to', 'of', 'and', 'or', 'for', 'with', 'in', 'on', 'this', 'that', 'is', 'are', 'be', 'should', 'must', 'can', 'will')) AS w, {_DENIED} AS neg FROM lk),
 li AS (SELECT DISTINCT uri, CASE WHEN l <> '' AND r <> '' THEN l ELSE w[1] END AS subject, CASE WHEN l <> '' AND r <> '' THEN 'is' ELSE 'asserts' END AS relation, CASE WHEN l <> '' AND r <> '' THEN r WHEN len(w) = 1 THEN 'true' ELSE array_to_string(w[2:], ' ') END AS object, CASE WHEN l <> '' AND r <> '' THEN sep = '!=' ELSE neg END AS negated
  FROM lp WHERE (l <> '' AND r <> '') OR len(w) > 0)"""


@query("SELECT * FROM li", f"{CLX}, {_LIT.replace('{src}', 'cl')}")
def b_literals(s, d):
    return B.literals(claims(s, d), "uri", "l0")


@query(
    "SELECT a.uri AS incoming, b.uri AS existing, a.subject, a.object, round((coalesce(x.quality, 0.5) + coalesce(y.quality, 0.5)) / 2, 6) AS severity FROM li a JOIN li b ON a.subject = b.subject AND a.relation = b.relation AND a.object = b.object AND a.negated <> b.negated JOIN cl x ON x.uri = a.uri JOIN cl y ON y.uri = b.uri WHERE ends_with(a.uri, '/revised') AND NOT ends_with(b.uri, '/revised')",
    f"{CLX}, {_LIT.replace('{src}', 'cl')}",
)
def b_conflicts(s, d):
    c = claims(s, d).select("uri", "l0", F.coalesce("quality", F.lit(0.5)).alias("entrenchment"))
    new = F.endswith(F.col("uri"), F.lit("/revised"))
    return B.literal_conflicts(c.filter(~new), c.filter(new)).withColumn("severity", F.round("severity", 6))


_WS = "list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> ''))"


@query(f"+ z AS (SELECT a.uri, {claims_sql('a.l0', 'b.l0')} AS opposed, len(list_intersect({_WS.format(c='lower(a.l0)')}, {_WS.format(c='lower(b.l0)')})) / len(list_distinct(list_concat({_WS.format(c='lower(a.l0)')}, {_WS.format(c='lower(b.l0)')}))) AS j FROM cl a JOIN cl b ON b.uri = a.uri || '/revised' WHERE a.l0 <> b.l0) SELECT uri, round(j, 6) AS confidence FROM z WHERE opposed AND j >= 0.3", CLX)
def v_contra(s, d):
    """Entries whose revised text contradicts the present one."""
    c = claims(s, d)
    new = c.filter(F.endswith(F.col("uri"), F.lit("/revised"))).withColumn("uri", F.expr("left(uri, length(uri) - 8)"))
    return B.snapshot_contradictions(entries(s, d), new, 0.3).withColumn("confidence", F.round("confidence", 6))


_NEXT = "nx AS (SELECT uri AS f, lead(uri) OVER (PARTITION BY tenant, agent ORDER BY created_at, uri) AS t FROM fx), pr AS (SELECT tenant, arg_max(uri, (updated_at, uri)) AS product, arg_max(l0, (updated_at, uri)) AS text FROM fx GROUP BY tenant)"


@query(
    f"+ {_NEXT}, h AS (SELECT pr.tenant, product, fx.uri FROM pr JOIN fx ON fx.tenant = pr.tenant WHERE len(list_intersect({_WS.format(c='text')}, {_WS.format(c='l0')})) / len(list_distinct(list_concat({_WS.format(c='text')}, {_WS.format(c='l0')}))) >= 0.3), u AS (SELECT * FROM h UNION SELECT h.tenant, product, nx.t FROM h JOIN nx ON nx.f = h.uri WHERE nx.t IS NOT NULL) SELECT tenant, product, uri, 'backward-evolved from ' || product || ' (jaccard+graph)' AS summary FROM u"
)
def wr_backward(s, d):
    """The newest entry of each tenant as product; an agent's entries evolve in the order of their creation."""
    from pyspark.sql import Window as W

    e = entries(s, d)
    p = e.groupBy("tenant").agg(F.max_by(F.struct("uri", "l0"), F.struct("updated_at", "uri")).alias("p")).select("tenant", F.col("p.uri").alias("product"), F.col("p.l0").alias("text"))
    nxt = e.select(F.col("uri").alias("from"), F.lead("uri").over(W.partitionBy("tenant", "agent").orderBy("created_at", "uri")).alias("to")).filter("to is not null")
    return B.evolve_backward(p, e, nxt, "tenant")


@query("+ u AS (SELECT uri, substr(l0, 1, 160) AS query, round(1 - coalesce(quality, 0.5), 9) AS u FROM fx WHERE coalesce(valid_until > TIMESTAMP '2025-01-01', true)) SELECT uri, query, CASE WHEN u > 0.68 THEN 'FederatedDiscovery' ELSE 'LocalSearch' END AS action, u AS priority FROM u WHERE u >= 0.45 ORDER BY u DESC, uri LIMIT 64")
def h_curious(s, d):
    return B.curiosity(entries(s, d), now()).orderBy(F.desc("priority"), "uri", "action").limit(64)


@query(
    "+ n AS (SELECT tenant, agent, 'uwu://' || tenant || '/agent/' || agent AS scope, min(agent) OVER (PARTITION BY tenant) AS m FROM (SELECT DISTINCT tenant, agent FROM fx)), k AS (SELECT *, CASE WHEN m <> agent THEN m END AS parent FROM n) SELECT fx.uri, CASE WHEN fx.content_type IN ('goal', 'fact') OR parent IS NULL THEN fx.uri ELSE replace(fx.uri, scope, 'uwu://' || k.tenant || '/agent/' || parent) END AS effective, fx.content_type NOT IN ('goal', 'fact') AND parent IS NOT NULL AS from_parent FROM fx JOIN k ON k.tenant = fx.tenant AND k.agent = fx.agent WHERE fx.content_type <> 'profile'"
)
def inherit_resolve(s, d):
    """Agents inherit from the first agent of their tenant, but replace goals, merge facts and hide profiles."""
    e = entries(s, d).withColumn("agent", F.concat_ws("/", "tenant", "agent"))
    scope = F.concat(F.lit("uwu://"), F.replace("agent", F.lit("/"), F.lit("/agent/")))
    names = e.select("tenant", "agent").distinct()
    nodes = names.join(names.groupBy("tenant").agg(F.min("agent").alias("m")), "tenant").select("agent", scope.alias("scope"), F.when(F.col("m") != F.col("agent"), F.col("m")).alias("parent"))
    rules = F.array(*[F.struct(F.concat("scope", F.lit(f"/memory/{t}/")).alias("pattern"), F.lit(a).alias("action"), F.lit(i).alias("place")) for i, (t, a) in enumerate((("goal", "Replace"), ("fact", "Merge"), ("profile", "Hide")))])
    return B.inherited(e, nodes, nodes.select("agent", F.explode(rules).alias("r")).select("agent", "r.*"))


@query(
    "+ v AS (SELECT lang, min(word) AS first, max(word) AS last FROM common_words WHERE lang IS NOT NULL GROUP BY lang), t(u, a, c) AS (VALUES ('start/{first}', 'From {first} to {last} in {lang}', 'fact'), ('end/{last}', 'Ends with {last}', 'goal')) SELECT 'uwu://' || lang || '/' || replace(replace(replace(u, '{first}', first), '{last}', last), '{lang}', lang) AS uri, replace(replace(replace(a, '{first}', first), '{last}', last), '{lang}', lang) AS l0, c AS content_type FROM v, t"
)
def tmpl_inst(s, d):
    templates = s.createDataFrame([("start/{first}", "From {first} to {last} in {lang}", "fact"), ("end/{last}", "Ends with {last}", "goal")], "uri_template string, abstract_template string, content_type string")
    v = table(s, d, "common_words").filter("lang is not null").groupBy("lang").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    names = v.select(F.concat(F.lit("uwu://"), "lang").alias("scope"), F.create_map(F.lit("first"), "first", F.lit("last"), "last", F.lit("lang"), "lang").alias("vars"))
    return B.instantiate(templates, names)


@query("+ p AS (SELECT tenant AS peer, avg(coalesce(quality, 0.5)) AS u FROM fx GROUP BY tenant) SELECT peer, round(least(1.0, greatest(0.0, 0.5 + round(u, 9) * 0.0324 - 0.0162 + 0.06)), 6) AS score FROM p")
def fd_order(s, d):
    p = entries(s, d).groupBy(F.col("tenant").alias("peer")).agg(F.round(F.avg(F.coalesce("quality", F.lit(0.5))), 9).alias("utility"))
    return B.peer_order(p, "HighPrecision").withColumn("score", F.round("score", 6))


_SPACE = "'wiki__' || lower(hex(tenant)) || '__' || lower(hex(space))"


@query(
    f"+ p AS (SELECT coalesce(tenant_id, '') AS tenant, lower(trim(source)) AS space, CASE WHEN doc_id % 3 = 0 THEN 'uwu://elsewhere/wiki/' ELSE 'uwu://' || coalesce(tenant_id, '') || '/wiki/' END || lower(trim(source)) || '/' || doc_id AS id, doc_id FROM documents) SELECT DISTINCT id AS uri, tenant, space, {_SPACE} AS collection FROM p WHERE doc_id % 3 <> 0 AND tenant <> '' AND space IS NOT NULL AND NOT regexp_matches(tenant || space, '[/?#]') AND space NOT IN ('', '.', '..')",
    "z AS (SELECT 1)",
)
def wiki_bridge(s, d):
    """Documents as wiki pages of their tenant, with the source as space; every third claims another tenant's address and is refused."""
    t, space = F.coalesce("tenant_id", F.lit("")), F.lower(F.trim("source"))
    home = F.when(F.col("doc_id") % 3 == 0, F.lit("uwu://elsewhere/wiki/")).otherwise(F.concat(F.lit("uwu://"), t, F.lit("/wiki/")))
    p = table(s, d, "documents").select(t.alias("tenant"), space.alias("space"), F.concat(home, space, F.lit("/"), F.col("doc_id").cast("string")).alias("id"), "text")
    return wiki.bound_pages(p).select("uri", "tenant", "space", "collection").distinct()


@query(
    "+ o AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY committed_at DESC, id DESC) AS k FROM cx), b AS (SELECT x.scope, x.id AS head, y.id AS onto FROM o x JOIN o y ON y.scope = x.scope AND x.k = 1 AND y.k = 3),"
    " e AS (SELECT commit_id AS c, min(struct_pack(o := ordinal, p := parent_id)).p AS p FROM version_commit_parents WHERE parent_id IS NOT NULL AND commit_id IS NOT NULL GROUP BY commit_id),"
    " anc(scope, id) AS (SELECT scope, onto FROM b UNION SELECT anc.scope, ex.t FROM anc JOIN ex ON ex.f = anc.id),"
    " own(scope, id, back) AS (SELECT scope, head, 0 FROM b WHERE head NOT IN (SELECT id FROM anc a WHERE a.scope = b.scope) UNION ALL SELECT own.scope, e.p, back + 1 FROM own JOIN e ON e.c = own.id WHERE back < 1000 AND e.p NOT IN (SELECT id FROM anc a WHERE a.scope = own.scope))"
    " SELECT scope, id AS commit_id, back FROM own",
    f"{CX}, {EX}",
)
def v_rebase(s, d):
    """Commits of each scope's newest branch that a rebase onto its third newest commit would apply, by distance from the head (the farthest is applied first)."""
    from pyspark.sql import Window as W

    c = commits(s, d).withColumn("k", F.row_number().over(W.partitionBy("scope").orderBy(F.desc("committed_at"), F.desc("id"))))
    pairs = c.filter("k = 1").select("scope", F.col("id").alias("head")).join(c.filter("k = 3").select("scope", F.col("id").alias("onto")), "scope")
    tree = places(table(s, d, "version_commit_parents"), "commit_id", "parent_id", "ordinal", "ingested_at")
    return VS.to_rebase(pairs, paths(tree), edges(s, d))


_HUB = "hub AS (SELECT node FROM (SELECT f AS node FROM ex UNION ALL SELECT t FROM ex) GROUP BY node ORDER BY count(*) DESC, node LIMIT 1)"


@query(
    f"+ u0 AS (SELECT f AS a, t AS b FROM ex UNION SELECT t, f FROM ex), nb AS (SELECT node AS x FROM hub UNION SELECT b FROM u0 JOIN hub ON hub.node = a UNION SELECT v.b FROM u0 JOIN hub ON hub.node = a JOIN u0 v ON v.a = u0.b), {_rank_sql(32).replace(EX + ', a AS (SELECT DISTINCT f, t FROM ex)', 'a AS (SELECT DISTINCT f, t FROM ex WHERE f IN (SELECT x FROM nb) AND t IN (SELECT x FROM nb))')} SELECT x AS node, round(r, 6) AS rank FROM r32",
    f"{EX}, {_HUB}",
)
def g_central_local(s, d):
    """Rank within two steps, either way, of the node of most edges."""
    e = edges(s, d)
    hub = e.select(F.explode(F.array("from", "to")).alias("node")).groupBy("node").count().orderBy(F.desc("count"), "node").limit(1).select("node")
    return G.local_pagerank(e, hub, 2).withColumn("rank", F.round("rank", 6))


_HIT = "c AS (SELECT tenant, round(0.72 * (count(*) FILTER (contains(lower(l0), 'index')) / count(*)) + 0.2 * avg(coalesce(quality, 0.5)), 6) AS score FROM fx GROUP BY tenant ORDER BY 2 DESC, tenant LIMIT 8)"


@query(
    f"+ {_HIT}, n AS (SELECT fx.tenant, uri, l0, round(coalesce(quality, 0.5), 6) AS ns, row_number() OVER (PARTITION BY fx.tenant ORDER BY round(coalesce(quality, 0.5), 6) DESC, uri) AS i FROM fx) SELECT c.tenant AS community, '(summary)' AS uri, score AS relevance, 0::BIGINT AS tokens FROM c UNION ALL SELECT c.tenant, uri, round(least(1.0, greatest(0.05, score * 0.88 + ns * 0.12)), 6), greatest(1, ceil(length(l0) / 4))::BIGINT FROM c JOIN n ON n.tenant = c.tenant WHERE i <= 3"
)
def g_rag(s, d):
    """The best communities (tenants) with a summary each, and their best three nodes."""
    e = entries(s, d)
    c = e.groupBy("tenant").agg((F.count(F.when(F.contains(F.lower("l0"), F.lit("index")), 1)) / F.count("*")).alias("o"), F.avg(F.coalesce("quality", F.lit(0.5))).alias("q")).select("tenant", F.round(0.72 * F.col("o") + 0.2 * F.col("q"), 6).alias("score")).orderBy(F.desc("score"), "tenant").limit(8)
    n = e.select("tenant", "uri", "l0", F.round(F.coalesce("quality", F.lit(0.5)), 6).alias("ns")).join(F.broadcast(c), "tenant")
    n = R.per_group(n, ["tenant"], [F.desc("ns"), F.asc("uri")], 3)
    drill = n.select(F.col("tenant").alias("community"), "uri", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.col("score") * 0.88 + F.col("ns") * 0.12)), 6).alias("relevance"), F.greatest(F.lit(1), F.ceil(F.length("l0") / 4)).cast("bigint").alias("tokens"))
    return c.select(F.col("tenant").alias("community"), F.lit("(summary)").alias("uri"), F.col("score").alias("relevance"), F.lit(0).cast("bigint").alias("tokens")).unionByName(drill)


_FINITE = "len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0"


@query(f"+ v AS (SELECT id, min(e) AS e, max(severity) AS severity FROM (SELECT id, severity, pattern_signature::DOUBLE[] AS e FROM antibodies) WHERE id IS NOT NULL AND {_FINITE} GROUP BY id), q AS (SELECT a.id AS adopted, b.id AS suppressed, round(list_cosine_similarity(a.e, b.e), 6) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.id) AS k FROM v a JOIN v b ON a.severity = 'Critical' AND a.id <> b.id) SELECT adopted, suppressed, score FROM q WHERE k <= 9 AND score >= 0.5", "z AS (SELECT 1)")
def cs_rif(s, d):
    """What the adopted patterns (the critical ones) suppress: those of their ten nearest, themselves among them, of a similarity of a half or more."""
    good = V.valid(F.col("v"), 64) & F.exists("v", lambda x: x != 0)
    v = table(s, d, "antibodies").select("id", "severity", F.col("pattern_signature").cast("array<double>").alias("v")).filter("id is not null").filter(good).groupBy("id").agg(F.min("v").alias("v"), F.max("severity").alias("severity"))
    q = v.filter("severity = 'Critical'").select(F.col("id").alias("adopted"), F.col("v").alias("qv"))
    return R.nearest_in_blocks(q, v.select("id", "v"), "adopted", "qv", "id", "v", 9, 6).filter("score >= 0.5").select("adopted", F.col("id").alias("suppressed"), "score")


def _json_changes(left, right, path: str = "$") -> Iterator[str]:
    import json

    text = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    if isinstance(left, dict) and isinstance(right, dict):
        for k in sorted(left.keys() | right.keys()):
            at = f"{path}.{k}"
            if k in left and k in right:
                yield from _json_changes(left[k], right[k], at)
            elif k in left:
                yield f"- {at}: {text(left[k])}"
            else:
                yield f"+ {at}: {text(right[k])}"
    elif left != right or isinstance(left, bool) != isinstance(right, bool):
        yield f"~ {path}: {text(left)} -> {text(right)}"


def json_changes(left: pd.Series, right: pd.Series) -> pd.Series:
    """Changes between JSON texts, at any depth; null where one is null or no JSON."""
    import json

    def one(a, b):
        try:
            return list(_json_changes(json.loads(a), json.loads(b)))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype=object)


@query(
    "+ v AS (SELECT uri, mvcc_version AS version, arg_min(entry_json, ingested_at) AS j FROM context_versions WHERE uri IS NOT NULL GROUP BY uri, mvcc_version), p AS (SELECT uri, version, j, lag(j) OVER (PARTITION BY uri ORDER BY version) AS b FROM v), k AS (SELECT uri, version, j, b, unnest(list_distinct(list_concat(json_keys(j), json_keys(b)))) AS f FROM p WHERE json_valid(j) AND json_valid(b)), x AS (SELECT *, json_extract(b, '$.' || f) AS l, json_extract(j, '$.' || f) AS r FROM k) SELECT uri, version, CASE WHEN l IS NULL THEN '+ $.' || f || ': ' || r WHEN r IS NULL THEN '- $.' || f || ': ' || l ELSE '~ $.' || f || ': ' || l || ' -> ' || r END AS change FROM x WHERE l IS NULL OR r IS NULL OR l::VARCHAR <> r::VARCHAR",
    "z AS (SELECT 1)",
)
def f_jsondiff(s, d):
    """Changes from each version's entry to the next, at any depth."""
    from pyspark.sql import Window as W

    v = table(s, d, "context_versions").filter("uri is not null").groupBy("uri", F.col("mvcc_version").alias("version")).agg(F.min_by("entry_json", "ingested_at").alias("j"))
    p = v.withColumn("b", F.lag("j").over(W.partitionBy("uri").orderBy("version"))).filter("b is not null and j is not null")
    diff = F.pandas_udf(json_changes, "array<string>")
    return p.select("uri", "version", F.explode(diff("b", "j")).alias("change"))


def _archive(s, d):
    """Expired entries, written phase by phase; the manifest comes first and says what is due."""
    at = f"{shared_dir(s)}/palimpsest-archive-{uuid.uuid4().hex}"
    due = keep(entries(s, d).filter(F.coalesce("valid_until", now()) < now()), "due")
    due.select("uri", F.sha2("l0", 256).alias("hash")).write.parquet(f"{at}/manifest")
    due.select("uri", "tags").write.parquet(f"{at}/graph")
    due.select("uri", "l0", "l1").write.parquet(f"{at}/content")
    due.select("uri", "l2").write.parquet(f"{at}/blobs")
    return at


_DUE = "coalesce(valid_until, TIMESTAMP '2025-01-01') < TIMESTAMP '2025-01-01'"


@query(f"+ p(phase) AS (VALUES ('manifest'), ('graph'), ('content'), ('blobs')) SELECT phase, count(*) AS n, count(DISTINCT uri) AS n_uris FROM fx, p WHERE {_DUE} GROUP BY phase")
def lc_exec(s, d):
    at = _archive(s, d)
    return R.union([s.read.parquet(f"{at}/{p}").agg(F.lit(p).alias("phase"), F.count("*").alias("n"), F.countDistinct("uri").alias("n_uris")) for p in ("manifest", "graph", "content", "blobs")])


@query(f"SELECT uri, l0, l1, l2, tags, true AS intact FROM fx WHERE {_DUE}")
def lc_restore(s, d):
    """The archived entries put together again, checked against the manifest."""
    at = _archive(s, d)
    parts = [s.read.parquet(f"{at}/{p}") for p in ("content", "blobs", "graph", "manifest")]
    j = parts[0].join(parts[1], "uri").join(parts[2], "uri").join(parts[3], "uri")
    return j.select("uri", "l0", "l1", "l2", "tags", F.sha2("l0", 256).eqNullSafe(F.col("hash")).alias("intact"))


@query("SELECT label AS modality, count(*) AS encoded, count(*) AS written, round(avg(sqrt(list_dot_product(e, e))), 6) AS norm FROM (SELECT label, list_transform(list_reverse(embedding::DOUBLE[]), lambda x: 2 * x) AS e FROM embeddings) GROUP BY label", "")
def em_migrate(s, d):
    """Vectors encoded anew for another space (here twice as long and turned round), written there, and what was done by kind."""
    e = table(s, d, "embeddings").filter(F.size("embedding") > 0)
    new = keep(e.select("vec_id", "label", F.transform(F.reverse("embedding"), lambda x: 2 * x.cast("double")).alias("embedding")), "space")
    done = new.groupBy(F.col("label").alias("modality")).agg(F.count("*").alias("written"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("norm"))
    return e.groupBy(F.col("label").alias("modality")).agg(F.count("*").alias("encoded")).join(done, "modality").select("modality", "encoded", "written", "norm")


# fixed values: what a step of a plan costs
COSTS = {"type_scan": 0.001, "prefix_scan": 0.002, "vector": 0.01, "graph": 10.0, "filter": 1.1, "sort": 1.5, "hash_join": 5.0, "full_scan": 0.05}


@query("SELECT content_type, round(least(512, count(*)) * 0.001 * 1.1 * 1.5, 9) AS scan_filter_sort, round(512 * 0.01 + 10.0 * 2 * 4, 9) AS search_then_two_hops, round(least(512, count(*)) * 0.001 + 512 * 0.002 + 5.0, 9) AS joined, round(greatest(least(512, count(*)) * 0.001, 512 * 0.01), 9) AS parallel FROM fx WHERE content_type IS NOT NULL GROUP BY content_type")
def pl_cost(s, d):
    """What four plans over each type would cost: scan, filter and sort; a vector search and two hops along two kinds of edges; a join; two branches at once."""
    n = entries(s, d).filter("content_type is not null").groupBy("content_type").agg(F.count("*").alias("n"))
    scan, near = F.least(F.lit(512), F.col("n")) * COSTS["type_scan"], F.lit(512 * COSTS["vector"])
    plans = {"scan_filter_sort": scan * COSTS["filter"] * COSTS["sort"], "search_then_two_hops": near + COSTS["graph"] * 2 * 2**2, "joined": scan + 512 * COSTS["prefix_scan"] + COSTS["hash_join"], "parallel": F.greatest(scan, near)}
    return n.select("content_type", *[F.round(c, 9).alias(k) for k, c in plans.items()])


QUERIES, ORACLES = query.queries, query.oracles
