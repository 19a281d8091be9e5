"""Aggregations and windows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as VEC
from ..operators import aggregates as A
from ..operators import temporal as M
from ..operators.ordered import micros
from ..operators import ranking as R
from ..operators.ranking import per_group
from ..tables import table
from .fixtures import CX, DX, FX, NOW, OX, VX, Catalog, commits, deltas, entries, now, versions, votes

query = Catalog()
DAYS = f"(floor(trunc(epoch(TIMESTAMP '{NOW}' - updated_at)) / 3600) / 24)"
days = lambda: F.floor(F.timestamp_diff("SECOND", F.col("updated_at"), now()) / 3600) / 24
AX = "ax AS (SELECT user_id, count(*) AS n, max(ts) AS last, count(*) FILTER (event_type IN ('purchase','signup')) AS adopted, count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY user_id)"


def _access(s, d):
    of = lambda *t: F.count(F.when(F.col("event_type").isin(*t), 1))
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"), of("purchase", "signup").alias("adopted"), of("error").alias("rejected"))


@query("SELECT tenant, content_type, count(*) AS n, round(avg(len(string_split(uri, '/')) - 3), 6) AS depth FROM fx GROUP BY ALL")
def a_stats(s, d):
    return entries(s, d).groupBy("tenant", "content_type").agg(F.count("*").alias("n"), F.round(F.avg(F.size(F.split("uri", "/")) - 3), 6).alias("depth"))


_Q4 = f"CASE WHEN length(coalesce(l1, '')) > 0 THEN 0.9 ELSE 0.4 END AS c, least(1.0, greatest(0.05, exp(-{DAYS} / 30))) AS f, CASE WHEN strlen(l0) > 20 AND strlen(l0) < 2000 THEN 0.85 ELSE 0.5 END AS k, least(1.0, greatest(0.1, ln(mvcc_version + 1) / 5)) AS u"


@query(f"+ q AS (SELECT uri, {_Q4} FROM fx) SELECT uri, round(f, 6) AS freshness, round(0.25*c+0.25*f+0.2*k+0.3*u, 6) AS overall FROM q")
def a_quality4(s, d):
    return A.quality_four(entries(s, d), now(), F.col("mvcc_version")).select("uri", F.round("freshness", 6).alias("freshness"), F.round("overall", 6).alias("overall"))


@query("SELECT uri, round(0.20*0.5 + 0.15*CASE WHEN mvcc_version % 2 = 0 THEN 1.0 ELSE 0.5 END + 0.10*0.4 + 0.10*coalesce(quality, 0.5) + 0.15*CASE WHEN content_type = 'skill' THEN 1.0 ELSE 0.3 END + 0.10*0.2 + 0.20*least(mvcc_version, 3)/3, 6) AS score FROM fx")
def a_quality7(s, d):
    q = A.quality_seven(F.lit(0.5), F.col("mvcc_version") % 2, F.lit(0.4), F.col("quality"), F.col("content_type") == "skill", F.lit(0.2), F.col("mvcc_version"))
    return entries(s, d).select("uri", F.round(q, 6).alias("score"))


@query(f"+ i AS (SELECT user_id, n, floor(trunc(epoch(TIMESTAMP '2024-02-01' - last)) / 3600) / 24 AS days, CASE WHEN user_id % 2 = 0 THEN adopted / n END AS conf FROM ax) SELECT user_id, round((0.25*n/(n+5) + 0.25*exp(-days/30) + coalesce(0.25*conf, 0)) / (0.5 + CASE WHEN conf IS NULL THEN 0 ELSE 0.25 END), 6) AS composite, round(0.5 + CASE WHEN conf IS NULL THEN 0 ELSE 0.25 END, 6) AS completeness FROM i", AX)
def a_importance(s, d):
    a = _access(s, d)
    age = F.floor(F.timestamp_diff("SECOND", F.col("last"), F.lit("2024-02-01").cast("timestamp_ntz")) / 3600) / 24
    none = F.lit(None).cast("double")
    c, k = A.importance(F.col("n"), age, none, F.when(F.col("user_id") % 2 == 0, F.col("adopted") / F.col("n")), none)
    return a.select("user_id", F.round(c, 6).alias("composite"), F.round(k, 6).alias("completeness"))


_TALLY = "+ t AS (SELECT entry_id, count(*) FILTER (op = 'Upvote') AS up, count(*) FILTER (op = 'Downvote') AS down, count(*) FILTER (op = 'FlagOutdated') AS flags FROM ox GROUP BY entry_id)"


@query(_TALLY + " SELECT entry_id, up, down, flags, up - down AS net, round(CASE WHEN up + down > 0 THEN abs(up / (up + down) - 0.5) * 2 ELSE 0.0 END, 6) AS consensus FROM t", OX)
def a_tally(s, d):
    return A.tally(votes(s, d)).withColumn("consensus", F.round("consensus", 6))


@query(_TALLY + " SELECT entry_id, round(2 * abs(up / (up + down) - 0.5), 6) AS consensus FROM t WHERE up + down > 0", OX)
def a_consensus(s, d):
    return A.tally(votes(s, d)).filter("up + down > 0").select("entry_id", F.round("consensus", 6).alias("consensus"))


@query(_TALLY + " SELECT entry_id FROM t WHERE flags >= 2 AND down > up OR down >= 3 AND down > 2 * up", OX)
def a_delist(s, d):
    return A.tally(votes(s, d)).filter("(flags >= 2 and down > up) or (down >= 3 and down > 2 * up)").select("entry_id")


_REP = "+ p AS (SELECT user_id, adopted / n AS a, rejected AS r, n FROM ax), c AS (SELECT *, round(0.25*a + 0.25*0.6 + 0.20*0.5 + 0.15*(1 - least(r/10, 1.0)) + 0.10 + 0.05*least(n/10, 1.0), 6) AS composite FROM p)"


def _reputation(s, d):
    a = _access(s, d).withColumn("a", F.col("adopted") / F.col("n"))
    return a.withColumn("composite", F.round(A.reputation(F.col("a"), F.lit(0.6), F.lit(0.5), F.col("rejected"), F.lit(0), F.col("n")), 6))


@query(_REP + " SELECT user_id, composite FROM c", AX)
def a_reputation(s, d):
    return _reputation(s, d).select("user_id", "composite")


_LEVEL = "CASE WHEN composite >= 0.9 AND n >= 50 THEN 'Authority' WHEN n >= 10 AND a >= 0.8 THEN 'Validator' WHEN n >= 3 AND a >= 0.6 THEN 'Contributor' ELSE 'Newcomer' END"


@query(_REP + f" SELECT user_id, {_LEVEL} AS level, round(CASE {_LEVEL} WHEN 'Authority' THEN 0.2 WHEN 'Validator' THEN 0.12 WHEN 'Contributor' THEN 0.05 ELSE 0.0 END * exp(-r / 30 * 0.5), 6) AS bonus FROM c", AX)
def a_bond(s, d):
    level = A.bond(F.col("composite"), F.col("n"), F.col("a"))
    return _reputation(s, d).select("user_id", level.alias("level"), F.round(A.bond_bonus(level, F.col("rejected")), 6).alias("bonus"))


@query("SELECT entry_id, round(least(0.2, count(DISTINCT voter) / 4) + least(0.2, count(DISTINCT op) / 3) - least(0.3, 0.08 * count(*) FILTER (op = 'Downvote')), 6) AS bonus FROM ox GROUP BY entry_id", OX)
def a_corrob(s, d):
    v = votes(s, d).groupBy("entry_id").agg(F.countDistinct("voter").alias("x"), F.countDistinct("op").alias("y"), F.count(F.when(F.col("op") == "Downvote", 1)).alias("z"))
    return v.select("entry_id", F.round(A.corroboration_bonus(F.col("x"), F.col("y"), F.col("z")), 6).alias("bonus"))


@query("SELECT entry_id, count(DISTINCT voter) AS n, CASE WHEN count(DISTINCT voter) >= 3 THEN 'Established' WHEN count(DISTINCT voter) >= 2 THEN 'Corroborated' ELSE 'Single' END AS status FROM ox WHERE op = 'Upvote' GROUP BY entry_id", OX)
def a_converge(s, d):
    v = votes(s, d).filter("op = 'Upvote'").groupBy("entry_id").agg(F.countDistinct("voter").alias("n"))
    return v.withColumn("status", F.when(F.col("n") >= 3, "Established").when(F.col("n") >= 2, "Corroborated").otherwise("Single"))


@query("SELECT entry_id, count(*) AS n FROM ox WHERE op = 'Upvote' GROUP BY entry_id HAVING count(*) >= 3", OX)
def a_established(s, d):
    return votes(s, d).filter("op = 'Upvote'").groupBy("entry_id").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT tenant, round(avg(quality), 6) AS avg_quality, list_sort(list(DISTINCT content_type)) AS domains FROM fx GROUP BY tenant")
def a_disc_summary(s, d):
    return entries(s, d).groupBy("tenant").agg(F.round(F.avg("quality"), 6).alias("avg_quality"), F.array_sort(F.collect_set("content_type")).alias("domains"))


@query("SELECT count(*) AS n, count(DISTINCT tenant) AS tenants, count(DISTINCT agent) AS agents, count(quality) AS scored FROM fx")
def a_registry(s, d):
    return entries(s, d).agg(F.count("*").alias("n"), F.countDistinct("tenant").alias("tenants"), F.countDistinct("agent").alias("agents"), F.count("quality").alias("scored"))


@query("SELECT threat_type, count(DISTINCT id) AS n, round(avg(confidence), 4) AS confidence FROM (SELECT DISTINCT id, threat_type, confidence FROM antibodies) GROUP BY threat_type", "")
def a_immune(s, d):
    a = table(s, d, "antibodies").select("id", "threat_type", "confidence").distinct()
    return a.groupBy("threat_type").agg(F.countDistinct("id").alias("n"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("confidence"))


def _outcomes(s, d):
    return table(s, d, "events").select((F.least(F.col("value"), F.lit(99.0)) / 100).alias("p"), F.col("event_type").isin("purchase", "signup").cast("double").alias("y"), "user_id", "ts")


@query("+ b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS c, sum((p - y) * (p - y)) AS se, avg(p) AS mp, avg(y) AS my FROM x GROUP BY 1) SELECT sum(c) AS n, round(sum(se) / sum(c), 6) AS brier, round(sum(c * abs(mp - my)) / sum(c), 6) AS ece FROM b", "x AS (SELECT least(value, 99.0) / 100 AS p, (event_type IN ('purchase', 'signup'))::INT::DOUBLE AS y FROM events)")
def a_calib(s, d):
    return A.calibration(_outcomes(s, d), "p", "y").select("n", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


@query("SELECT round(least(3.0, greatest(0.5, avg(ln((0.01 + least(value, 99.0) / 102) / (1 - 0.01 - least(value, 99.0) / 102)) / 0.7))), 6) AS temperature FROM events", "")
def a_temp(s, d):
    p = 0.01 + F.least(F.col("value"), F.lit(99.0)) / 102
    return A.temperature(table(s, d, "events"), F.log(p / (1 - p)), F.lit(0.7)).select(F.round("temperature", 6).alias("temperature"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS latency, round(avg((event_type <> 'error')::INT), 6) AS reliability FROM events GROUP BY user_id", "")
def a_route(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("latency"), F.round(F.avg((F.col("event_type") != "error").cast("int")), 6).alias("reliability"))


@query("SELECT uri, count(*) AS n FROM dx WHERE op IN ('add', 'update') GROUP BY uri HAVING count(*) >= 3", DX)
def a_period(s, d):
    return deltas(s, d).filter("op in ('add','update')").groupBy("uri").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT scope, count(*) AS n, min(committed_at) AS first, max(committed_at) AS last FROM cx WHERE committed_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-09-01' GROUP BY scope", CX)
def a_timeline(s, d):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return commits(s, d).filter(F.col("committed_at").between(t("2024-03-01"), t("2024-09-01"))).groupBy("scope").agg(F.count("*").alias("n"), F.min("committed_at").alias("first"), F.max("committed_at").alias("last"))


@query("SELECT array_to_string(string_split(uri, '/')[3:5], '/') AS prefix, count(*) AS n FROM dx WHERE op = 'add' GROUP BY 1 HAVING count(*) >= 3", DX)
def a_cluster_prefix(s, d):
    return deltas(s, d).filter("op = 'add'").groupBy(F.array_join(F.slice(F.split("uri", "/"), 3, 3), "/").alias("prefix")).agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT uri, count(*) AS n FROM (SELECT DISTINCT uri, mvcc_version FROM context_versions WHERE uri IS NOT NULL AND uri NOT IN (SELECT uri FROM context_entries)) GROUP BY uri ORDER BY n DESC, uri LIMIT 20", "")
def a_blindspot(s, d):
    v = table(s, d, "context_versions").filter("uri is not null").select("uri", "mvcc_version").distinct()
    return v.join(table(s, d, "context_entries").select("uri"), "uri", "left_anti").groupBy("uri").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "uri").limit(20)


_TOP = "+ c AS (SELECT tenant, agent, count(*) AS c FROM fx GROUP BY ALL), t AS (SELECT tenant, arg_max(agent, (c, agent)) AS top, max(c) / sum(c) AS share, sum(c)::BIGINT AS n FROM c GROUP BY tenant)"


@query(_TOP + " SELECT tenant, top, round(share, 6) AS share, n FROM t WHERE share >= 0.2 AND n >= 3")
def a_speciation(s, d):
    return A.share_of_top(entries(s, d), "tenant", "agent").filter("share >= 0.2 and n >= 3").withColumn("share", F.round("share", 6))


@query("+ p AS (SELECT DISTINCT commit_id, uri FROM dx WHERE commit_id IS NOT NULL AND uri IS NOT NULL) SELECT a.uri AS a, b.uri AS b, count(*) AS n, round(1 - pow(0.8, count(*)), 6) AS strength FROM p a JOIN p b ON a.commit_id = b.commit_id AND a.uri < b.uri GROUP BY ALL", DX)
def a_cooccur(s, d):
    x = deltas(s, d).filter("commit_id is not null and uri is not null")
    return A.co_changed(x, "commit_id", "uri").withColumn("strength", F.round("strength", 6))


@query("SELECT parent_id AS uri, count(DISTINCT commit_id) AS n FROM version_commit_parents WHERE parent_id IN (SELECT id FROM version_commits) GROUP BY 1", "")
def a_depcount(s, d):
    p = table(s, d, "version_commit_parents").join(table(s, d, "version_commits").select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return p.groupBy(F.col("parent_id").alias("uri")).agg(F.countDistinct("commit_id").alias("n"))


HX = (
    "e AS (SELECT label % 2 AS g, vec_id, embedding::DOUBLE[] AS v FROM embeddings),"
    " x AS (SELECT g, i AS dim, v[i + 1] AS x FROM e, range(16) t(i)),"
    " c AS (SELECT g, dim, least(9, greatest(0, floor((x + 1) / 0.2)))::INT AS bin, count(*) AS c FROM x GROUP BY ALL),"
    " t AS (SELECT g, dim, sum(c) AS t, unnest(range(10))::INT AS bin FROM c GROUP BY g, dim),"
    " h AS (SELECT t.g, t.dim, t.bin, greatest(coalesce(c.c, 0) / t.t, 1e-6) AS share FROM t LEFT JOIN c ON c.g = t.g AND c.dim = t.dim AND c.bin = t.bin),"
    " nc AS (SELECT g, least(9, greatest(0, floor(sqrt(list_dot_product(v, v)) / 6.4)))::INT AS bin, count(*) AS c FROM e GROUP BY ALL),"
    " nt AS (SELECT g, sum(c) AS t, unnest(range(10))::INT AS bin FROM nc GROUP BY g),"
    " nh AS (SELECT nt.g, nt.bin, greatest(coalesce(nc.c, 0) / nt.t, 1e-6) AS share FROM nt LEFT JOIN nc ON nc.g = nt.g AND nc.bin = nt.bin),"
    " q AS (SELECT avg(s) AS psi FROM (SELECT a.dim, greatest(0, sum((b.share - a.share) * ln(b.share / a.share))) AS s FROM h a JOIN h b ON a.dim = b.dim AND a.bin = b.bin AND a.g = 0 AND b.g = 1 GROUP BY a.dim)),"
    " k AS (SELECT (greatest(0, sum(a.share * ln(a.share / b.share))) + greatest(0, sum(b.share * ln(b.share / a.share)))) / 2 AS kl FROM nh a JOIN nh b ON a.bin = b.bin AND a.g = 0 AND b.g = 1),"
    " z AS (SELECT g, list(m ORDER BY i) AS c FROM (SELECT g, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY g, i) GROUP BY g),"
    " w AS (SELECT (1 - list_cosine_similarity(a.c, b.c)) / 2 AS shift FROM z a JOIN z b ON a.g = 0 AND b.g = 1)"
)
DIMS = 16


def _vectors(s, d):
    return table(s, d, "embeddings").withColumn("g", F.col("label") % 2)


def _bins(s, d):
    """Histograms of the first ``DIMS`` dimensions, as many as the measure looks at."""
    x = _vectors(s, d).select("g", F.posexplode(F.slice("embedding", 1, DIMS)).alias("dim", "x"))
    return A.histogram(x, F.col("x").cast("double"), -1.0, 1.0, 10, ["g", "dim"])


def _norm_bins(s, d):
    return A.histogram(_vectors(s, d), VEC.norm(F.col("embedding")), 0.0, 64.0, 10, ["g"])


def _psi(s, d):
    return A.divergence(_bins(s, d), "g", 0, 1, ["dim"]).agg(F.avg("psi").alias("psi"))


def _kl(s, d):
    return A.divergence(_norm_bins(s, d), "g", 0, 1, []).select("kl")


@query("SELECT g, dim, bin, round(share, 6) AS share FROM h", HX)
def a_hist(s, d):
    return _bins(s, d).withColumn("share", F.round("share", 6))


@query("SELECT round(psi, 6) AS psi FROM q", HX)
def a_psi(s, d):
    return _psi(s, d).select(F.round("psi", 6).alias("psi"))


@query("SELECT round(kl, 6) AS kl FROM k", HX)
def a_kl(s, d):
    return _kl(s, d).select(F.round("kl", 6).alias("kl"))


@query("SELECT (SELECT count(*) FROM e WHERE g = 1) AS n, round(shift, 6) AS shift, round(psi, 6) AS psi, round(kl, 6) AS kl, CASE WHEN (SELECT count(*) FROM e WHERE g = 1) < 8 THEN 'Observe' WHEN psi >= 0.2 OR shift >= 0.18 THEN 'RebuildIndex' WHEN kl >= 0.15 THEN 'RetrainReranker' ELSE 'Observe' END AS action FROM q, k, w", HX)
def a_drift(s, d):
    """Psi over the dimensions, KL divergence of the norms and shift of the centroids between two halves of the vectors: three tables of one row each."""
    c = A.centroids(_vectors(s, d), "g", "embedding")
    shift = c.filter("g = 0").select(F.col("centroid").alias("a")).crossJoin(c.filter("g = 1").select(F.col("centroid").alias("b"))).select(VEC.cosine_distance(F.col("a"), F.col("b")).alias("shift"))
    n = _vectors(s, d).filter("g = 1").agg(F.count("*").alias("n"))
    one = n.crossJoin(shift).crossJoin(_psi(s, d)).crossJoin(_kl(s, d))
    return one.select("n", *[F.round(x, 6).alias(x) for x in ("shift", "psi", "kl")], A.drift_action(F.col("psi"), F.col("shift"), F.col("kl"), F.col("n")).alias("action"))


@query("SELECT label, list_transform(list(m ORDER BY i), lambda x: round(x, 5)) AS centroid FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label", "")
def a_centroid(s, d):
    return A.centroids(table(s, d, "embeddings"), "label", "embedding").select("label", F.transform("centroid", lambda x: F.round(x, 5)).alias("centroid"))


@query("+ c AS (SELECT entry_id, op, count(*) AS c FROM ox GROUP BY ALL) SELECT entry_id, round(CASE WHEN count(*) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) ELSE 0.0 END, 6) AS entropy FROM c GROUP BY entry_id", OX)
def a_entropy(s, d):
    return A.entropy(votes(s, d), "entry_id", "op").withColumn("entropy", F.round("entropy", 6))


@query("+ c AS (SELECT entry_id, op, count(*) AS c FROM ox GROUP BY ALL) SELECT entry_id, round(max(c) / sum(c), 6) AS majority, max(c) / sum(c) >= 0.6 AND sum(c) >= 3 AS accepted FROM c GROUP BY entry_id", OX)
def a_selfcons(s, d):
    c = votes(s, d).groupBy("entry_id", "op").agg(F.count("*").alias("c")).groupBy("entry_id").agg((F.max("c") / F.sum("c")).alias("m"), F.sum("c").alias("n"))
    return c.select("entry_id", F.round("m", 6).alias("majority"), ((F.col("m") >= 0.6) & (F.col("n") >= 3)).alias("accepted"))


@query("+ q AS (SELECT a.vec_id AS q, b.vec_id, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS k FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT q, max(hit::INT) AS hit, round(avg(hit::INT), 6) AS share FROM q WHERE k <= 10 GROUP BY q", "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)")
def a_recall(s, d):
    """Label agreement of the ten nearest of every query row (id divisible by 50) among all rows."""
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("embedding").alias("qe"))
    near = R.nearest_in_blocks(q, e.select("vec_id", "label", "embedding"), "q", "qe", "vec_id", "embedding", 10, 6)
    s10 = near.join(q.select("q", "ql"), "q").join(e.select("vec_id", "label"), "vec_id").withColumn("hit", (F.col("ql") == F.col("label")).cast("int"))
    return s10.groupBy("q").agg(F.max("hit").alias("hit"), F.round(F.avg("hit"), 6).alias("share"))


@query("+ t AS (SELECT scope, message, coalesce(lag(message) OVER (PARTITION BY scope ORDER BY committed_at, id) = message, false) AS again FROM cx) SELECT scope, count(*) AS n, count(*) FILTER (again) AS repeats, count(*) FILTER (trim(coalesce(message, '')) = '') AS empty FROM t GROUP BY scope", CX)
def a_sentinel(s, d):
    return A.thrash(commits(s, d), "scope", micros(F.col("committed_at")), [F.asc("id")], "message")


query.queries["w_thrash"], query.oracles["w_thrash"] = a_sentinel, query.oracles["a_sentinel"]


@query("+ s AS (SELECT uri, round(0.3 * (mvcc_version / 20) + 0.7 * coalesce(quality, 0.5), 9) AS k FROM fx) SELECT uri FROM s ORDER BY k, uri LIMIT (SELECT greatest(0, count(*) - 400) FROM s)")
def a_capacity(s, d):
    return A.capacity_victims(entries(s, d), 400, F.round(0.3 * (F.col("mvcc_version") / 20) + 0.7 * F.coalesce("quality", F.lit(0.5)), 9)).select("uri")


@query("SELECT tenant, round(avg((l1 IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (state_scope IS NOT NULL)::INT) / 3, 6) AS completeness FROM fx GROUP BY tenant")
def a_completeness(s, d):
    known = sum((F.col(c).isNotNull().cast("int") for c in ("l1", "quality", "state_scope")), F.lit(0))
    return entries(s, d).groupBy("tenant").agg(F.round(F.avg(known) / 3, 6).alias("completeness"))


# windows


@query("+ r AS (SELECT id, scope, row_number() OVER (PARTITION BY scope ORDER BY committed_at DESC, id DESC) AS rn FROM cx) SELECT id, scope, rn::INT AS rn FROM r WHERE rn > 3 AND NOT ((rn - 4) % 4 = 0 AND floor((rn - 4) / 4) < 5) AND id NOT IN (SELECT parent_id FROM version_commit_parents WHERE parent_id IS NOT NULL AND ordinal > 0)", CX)
def w_prune(s, d):
    kept = table(s, d, "version_commit_parents").filter("ordinal > 0 and parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    return M.prune(commits(s, d), kept, 3, 5, 4)


@query("SELECT uri, version, l0 FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY version DESC) AS k FROM vx) WHERE k = 1", VX)
def w_latest(s, d):
    return M.latest(versions(s, d), "uri", "version").select("uri", "version", "l0")


@query("SELECT uri, version, (row_number() OVER w)::INT AS n, lead(uri) OVER w IS NULL AS current FROM vx WINDOW w AS (PARTITION BY uri ORDER BY version)", VX)
def w_batch_version(s, d):
    return M.consecutive(versions(s, d), "uri", ["version"]).select("uri", "version", "n", "current")


@query("SELECT DISTINCT ON (agent) agent, uri FROM fx ORDER BY agent, uri")
def w_distinct_on(s, d):
    return entries(s, d).groupBy("agent").agg(F.min("uri").alias("uri"))


@query("SELECT uri, version, tx FROM vx WHERE uri = (SELECT min(uri) FROM vx) ORDER BY version LIMIT 100", VX)
def w_history(s, d):
    v = versions(s, d)
    return v.join(F.broadcast(v.agg(F.min("uri").alias("uri"))), "uri").orderBy("version").limit(100).select("uri", "version", "tx")


@query("+ g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, count(*) AS n, round(avg(gap) / 1e6, 3) AS mean_gap FROM g GROUP BY user_id", "z AS (SELECT 1)")
def w_intervals(s, d):
    return M.gaps(table(s, d, "events"), "user_id", "ts").withColumn("mean_gap", F.round("mean_gap", 3))


@query("+ t AS (SELECT scope, lag((op = 'delete')::INT) OVER (PARTITION BY scope ORDER BY log_pos) AS c, (op = 'add')::INT AS e FROM dx), g AS (SELECT scope, count(*) AS n, avg(CASE WHEN c = 1 THEN e END) AS p1, avg(CASE WHEN c = 0 THEN e END) AS p0 FROM t WHERE c IS NOT NULL GROUP BY scope) SELECT sum(n)::BIGINT AS n, round(sum(n * (p1 - p0)) / sum(n), 6) AS risk_difference FROM g WHERE p1 IS NOT NULL AND p0 IS NOT NULL", DX)
def c_risk(s, d):
    return M.lagged_effect(deltas(s, d), "scope", "log_pos", F.col("op") == "delete", F.col("op") == "add").withColumn("risk_difference", F.round("risk_difference", 6))


query.queries["w_lag_causal"], query.oracles["w_lag_causal"] = c_risk, query.oracles["c_risk"]

_T = lambda x: F.lit(x).cast("timestamp_ntz")


@query("SELECT uri, version FROM vx WHERE tx BETWEEN TIMESTAMP '2024-05-01' AND TIMESTAMP '2024-08-01'", VX)
def bt_between(s, d):
    return M.between(versions(s, d), _T("2024-05-01"), _T("2024-08-01")).select("uri", "version")


query.queries["w_temporal"], query.oracles["w_temporal"] = bt_between, query.oracles["bt_between"]
_LAST = "(SELECT *, row_number() OVER (PARTITION BY uri ORDER BY tx DESC, version DESC) AS k FROM vx WHERE {w}) WHERE k = 1"


@query("SELECT uri, version, tx FROM " + _LAST.format(w="tx <= TIMESTAMP '2024-08-01'"), VX)
def bt_asof(s, d):
    return M.as_of(versions(s, d), _T("2024-08-01")).select("uri", "version", "tx")


query.queries["scan_temporal"], query.oracles["scan_temporal"] = bt_asof, query.oracles["bt_asof"]


@query("SELECT uri, version FROM " + _LAST.format(w="tx <= TIMESTAMP '2024-10-01' AND valid_from <= TIMESTAMP '2024-07-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-07-01')"), VX)
def bt_bitemporal(s, d):
    return M.bitemporal_as_of(versions(s, d), _T("2024-10-01"), _T("2024-07-01")).select("uri", "version")


@query("SELECT uri, version FROM vx WHERE tx BETWEEN TIMESTAMP '2024-05-01' AND TIMESTAMP '2024-08-01' AND valid_from <= TIMESTAMP '2024-07-01' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '2024-06-01')", VX)
def bt_range(s, d):
    return M.bitemporal_between(versions(s, d), _T("2024-05-01"), _T("2024-08-01"), _T("2024-06-01"), _T("2024-07-01")).select("uri", "version")


@query("SELECT uri, version, tx, valid_from, valid_until FROM vx", VX)
def bt_evolution(s, d):
    return versions(s, d).select("uri", "version", "tx", "valid_from", "valid_until")


query.queries["bt_record"], query.oracles["bt_record"] = bt_evolution, query.oracles["bt_evolution"]


@query("SELECT uri, CASE WHEN content_type = 'error' THEN 'gone' ELSE invalidated_by END AS invalidated_by FROM fx")
def bt_mark(s, d):
    return entries(s, d).select("uri", F.when(F.col("content_type") == "error", "gone").otherwise(F.col("invalidated_by")).alias("invalidated_by"))


@query("SELECT v.uri, m.m + 1 AS version, v.l0 FROM vx v JOIN (SELECT uri, max(version) AS m FROM vx GROUP BY uri) m USING (uri) WHERE v.version = 2", VX)
def v_rollback(s, d):
    return M.rollback(versions(s, d), 2).select("uri", "version", "l0")


@query("SELECT a.uri, a.content_type AS type_a, b.content_type AS type_b FROM vx a JOIN vx b USING (uri) WHERE a.version = 1 AND b.version = 2 AND (a.l0 IS DISTINCT FROM b.l0 OR a.content_type IS DISTINCT FROM b.content_type)", VX)
def v_vdiff(s, d):
    return M.version_diff(versions(s, d), 1, 2).select("uri", "type_a", "type_b")


QUERIES, ORACLES = query.queries, query.oracles
