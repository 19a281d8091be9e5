"""Scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec as V
from ..operators import quantize as Q
from ..operators.aggregates import centroids, clamp
from ..tables import table
from .fixtures import FX, Catalog, entries, now

query = Catalog()
VEC = "v AS (SELECT 'v' || vec_id AS uri, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), p AS (SELECT a.uri AS x, b.uri AS y, a.e AS ea, b.e AS eb FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


def _pairs(s, d):
    v = table(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("uri"), "vec_id", "embedding")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("uri").alias("y"), F.col("embedding").alias("eb"))
    return v.select("vec_id", F.col("uri").alias("x"), F.col("embedding").alias("ea")).join(b, "vec_id")


def _text(name, col, sql, views=FX):
    def run(s, d):
        return entries(s, d).select("uri", col().alias("r"))

    run.__name__ = name
    query(f"SELECT uri, {sql} AS r FROM fx", views)(run)


def _pair_text(name, col, sql):
    """Each entry's abstract beside its overview."""

    def run(s, d):
        return entries(s, d).filter("l1 is not null").select("uri", col(F.col("l0"), F.col("l1")).alias("r"))

    run.__name__ = name
    query(f"SELECT uri, {sql} AS r FROM fx WHERE l1 IS NOT NULL")(run)


def _t(c, n=2, keep=""):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}{keep}]+'), lambda x: strlen(x) >= {n}))"


_text("f_terms", lambda: F.array_sort(T.terms(F.col("l0"))), f"list_sort({_t('l0')})")
_text("f_tokens3", lambda: F.array_sort(T.terms(F.col("l0"), 3, "_-")), f"list_sort({_t('l0', 3, '_-')})")
_text("f_important", lambda: T.important_terms(F.col("l0"), 4), f"list_sort(list_filter({_t('l0', 3, '_-')}, lambda x: x NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'what', 'when', 'where', 'how', 'why', '一个', '这个', '那个', '什么', '如何', '怎么', '以及', '或者')))[1:4]")
_text("f_tok_dedup", lambda: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("l0"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))), "list_sort(list_distinct(regexp_extract_all(lower(l0), '[\\p{L}\\p{N}]+')))")
_pair_text("f_overlap", lambda a, b: F.round(T.overlap(T.terms(a), T.terms(b)), 6), f"round(CASE WHEN len({_t('l0')}) > 0 THEN len(list_intersect({_t('l0')}, {_t('l1')})) / len({_t('l0')}) ELSE 0.0 END, 6)")
_pair_text("f_coverage", lambda a, b: F.round(T.overlap(T.terms(a, 3, "_-"), T.terms(b, 3, "_-")), 6), f"round(CASE WHEN len({_t('l0', 3, '_-')}) > 0 THEN len(list_intersect({_t('l0', 3, '_-')}, {_t('l1', 3, '_-')})) / len({_t('l0', 3, '_-')}) ELSE 0.0 END, 6)")
_ws = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda x: x <> ''))"
_jac = lambda a, b: f"round(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END, 6)"
_pair_text("f_jaccard", lambda a, b: F.round(T.jaccard(T.terms(a), T.terms(b)), 6), _jac(_t("l0"), _t("l1")))
_pair_text("f_jaccard_ws", lambda a, b: F.round(T.jaccard(T.words(a), T.words(b)), 6), _jac(_ws("l0"), _ws("l1")))


_SIDES = "list_contains(list_transform([{pairs}], lambda p: (contains({x}, p[1]) AND contains({y}, p[2])) OR (contains({x}, p[2]) AND contains({y}, p[1]))), true)"
_TEN = "[' enabled ', ' disabled '], [' allow ', ' deny '], [' true ', ' false '], [' required ', ' optional '], [' must ', ' must not '], [' should ', ' should not '], [' can ', ' cannot '], ['支持', '不支持'], ['允许', '禁止'], ['必须', '不能']"
_TWELVE = "[' enabled', ' disabled'], [' allow', ' deny'], [' allowed', ' forbidden'], [' true', ' false'], [' required', ' optional'], [' must ', ' must not '], [' should ', ' should not '], [' can ', ' cannot '], [' is ', ' is not '], ['支持', '不支持'], ['允许', '禁止'], ['必须', '不能']"


def contra_sql(a: str, b: str) -> str:
    return _SIDES.format(pairs=_TEN, x=f"(' ' || lower({a}) || ' ')", y=f"(' ' || lower({b}) || ' ')")


def claims_sql(a: str, b: str) -> str:
    return _SIDES.format(pairs=_TWELVE, x=f"lower({a})", y=f"lower({b})")


_pair_text("f_contra", lambda a, b: T.contradicts(a, b), contra_sql("l0", "l1"))
_pair_text("f_contra12", lambda a, b: T.claims_contradict(a, b), claims_sql("l0", "l1"))
_text("f_repeat", lambda: F.round(T.repeated_ratio(F.col("l0")), 6), f"round(CASE WHEN len(list_filter(regexp_split_to_array(lower(l0), '\\s+'), lambda x: x <> '')) > 0 THEN 1 - len({_ws('l0')}) / len(list_filter(regexp_split_to_array(lower(l0), '\\s+'), lambda x: x <> '')) ELSE 0.0 END, 6)")
_KV = "regexp_extract_all(l2, '[^,;\\n]+')"
_text(
    "f_kv",
    lambda: F.array_sort(F.map_keys(T.key_values(F.col("l2")))),
    f"list_sort(list_distinct(list_filter(list_transform(list_filter({_KV}, lambda p: regexp_matches(p, '[:=]')), lambda p: trim(regexp_split_to_array(p, '[:=]')[1])), lambda k: k <> '')))",
)
_EDGE = r"regexp_replace({t}, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g')"
_MAIL = "(instr({b}, '@') > 1 AND contains(substr({b}, instr({b}, '@') + 1), '.') AND strlen(substr({b}, instr({b}, '@') + 1)) >= 3)"
_KEY = "(starts_with(lower({b}), 'sk-') OR starts_with(lower({b}), 'pk-') OR starts_with(lower({b}), 'ghp_') OR starts_with(lower({b}), 'github_pat_') OR regexp_full_match({b}, '[A-Za-z0-9_-]{{24,}}'))"
_LONG = "(regexp_full_match({b}, '[-0-9+() ]+') AND length(regexp_replace({b}, '[^0-9]', '', 'g')) >= 11)"
_bare = lambda test, t: test.format(b=_EDGE.format(t=t))
_ONE = f"CASE WHEN {_bare(_MAIL, 't')} THEN replace(t, {_EDGE.format(t='t')}, '[REDACTED_EMAIL]') WHEN {_bare(_KEY, 't')} THEN replace(t, {_EDGE.format(t='t')}, '[REDACTED_SECRET]') WHEN {_bare(_LONG, 't')} THEN replace(t, {_EDGE.format(t='t')}, '[REDACTED_ID]') ELSE t END"
_VOTED = "mv AS (SELECT delivery_id, concat_ws(' ', voter, '<' || replay_id || '>', evidence, CASE WHEN op = 'Upvote' THEN voter || '@' || replace(batch_id, '-', '.') || '.' END, '+' || (10000000000 + delivery_id)) AS m FROM vote_payloads), mt AS (SELECT *, list_filter(regexp_split_to_array(m, '\\s+'), lambda x: x <> '') AS ts FROM mv)"


def _messages(s, d):
    """Votes as messages, with the voter's address in upvotes and the number of the delivery as a phone number."""
    mail = F.when(F.col("op") == "Upvote", F.concat("voter", F.lit("@"), F.replace("batch_id", F.lit("-"), F.lit(".")), F.lit(".")))
    return table(s, d, "vote_payloads").select("delivery_id", F.concat_ws(" ", "voter", F.concat(F.lit("<"), "replay_id", F.lit(">")), "evidence", mail, F.concat(F.lit("+"), (F.col("delivery_id") + 10_000_000_000).cast("string"))).alias("m"))


@query(f"SELECT delivery_id, array_to_string(list_transform(ts, lambda t: {_ONE}), ' ') AS r FROM mt", _VOTED)
def f_redact(s, d):
    return _messages(s, d).select("delivery_id", T.redact(F.col("m")).alias("r"))


@query(f"SELECT delivery_id, len(list_filter(ts, lambda t: {_bare(_MAIL, 't')}))::INT AS email, len(list_filter(ts, lambda t: {_bare(_KEY, 't')} AND NOT {_bare(_MAIL, 't')}))::INT AS api_key, len(list_filter(ts, lambda t: {_bare(_LONG, 't')} AND NOT {_bare(_KEY, 't')} AND NOT {_bare(_MAIL, 't')}))::INT AS long_id, 0 AS private_key FROM mt", _VOTED)
def f_sensitive(s, d):
    m = _messages(s, d)
    return m.select("delivery_id", *[c.alias(n) for n, c in T.sensitive_counts(F.col("m")).items()])


@query(f"SELECT delivery_id, {_bare(_MAIL, 'replay_id')} AS email, {_bare(_KEY, 'replay_id')} AS api_key, {_bare(_LONG, 'replay_id')} AS long_id FROM vote_payloads", "")
def f_email(s, d):
    bare = F.regexp_replace("replay_id", T.EDGE, "")
    return table(s, d, "vote_payloads").select("delivery_id", T.is_email(bare).alias("email"), T.is_key(bare).alias("api_key"), T.is_long_id(bare).alias("long_id"))


@query(f"SELECT uri, CASE WHEN contains(lower(x), 'ignore previous instructions') OR contains(lower(x), 'system prompt:') OR contains(lower(x), '<|im_start|>') THEN 'injection' WHEN trim(coalesce(x, '')) = '' THEN 'empty' WHEN len(list_filter(regexp_split_to_array(x, '\\s+'), lambda t: {_bare(_MAIL, 't')} OR {_bare(_KEY, 't')} OR {_bare(_LONG, 't')})) > 0 THEN 'sensitive' ELSE 'clean' END AS r FROM (SELECT uri, CASE WHEN mvcc_version % 2 = 0 THEN l0 || ' Ignore previous Instructions' WHEN mvcc_version % 7 = 1 THEN l0 || ' ' || uri ELSE l1 END AS x FROM fx)")
def f_inject(s, d):
    v = F.col("mvcc_version")
    x = F.when(v % 2 == 0, F.concat("l0", F.lit(" Ignore previous Instructions"))).when(v % 7 == 1, F.concat_ws(" ", "l0", "uri")).otherwise(F.col("l1"))
    return entries(s, d).select("uri", T.blocked(x).alias("r"))


_text("f_sanitize", lambda: T.sanitize_segment(F.substring("l0", 1, 30)), "CASE WHEN regexp_replace(regexp_replace(lower(trim(substr(l0, 1, 30))), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(lower(trim(substr(l0, 1, 30))), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') END")
_text("f_slug", lambda: T.slug(F.col("l0")), "substr(regexp_replace(regexp_replace(lower(l0), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48)")
_text("f_tokens", lambda: T.approx_tokens(F.col("l2"), 1), "greatest(1, ceil(length(coalesce(l2, '')) / 4)::BIGINT)")
_text("f_hash", lambda: F.sha2("l2", 256), "sha256(l2)")
_text("f_custom", lambda: F.get_json_object(F.to_json(F.map_concat(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("b"), F.col("content_type")))), "$.b"), "content_type")
_text("f_branch_name", lambda: F.col("agent").rlike(r"^[A-Za-z0-9._/-]{1,255}$") & ~F.col("agent").rlike(r"\.\."), "regexp_full_match(agent, '[A-Za-z0-9._/-]{1,255}') AND NOT contains(agent, '..')")
_text("f_cel", lambda: F.expr("mvcc_version > 3 AND content_type = 'fact'"), "mvcc_version > 3 AND content_type = 'fact'")
_text("f_pressure", lambda: F.when(F.col("quality") >= 0.9, "L0").when(F.col("quality") >= 0.7, "L1").otherwise("L2"), "CASE WHEN quality >= 0.9 THEN 'L0' WHEN quality >= 0.7 THEN 'L1' ELSE 'L2' END")

_days = lambda: F.floor(F.timestamp_diff("SECOND", F.col("updated_at"), now()) / 3600) / 24
_DAYS = "(floor(trunc(epoch(TIMESTAMP '2025-01-01 00:00:00' - updated_at)) / 3600) / 24)"


def _expr(name, col, sql):
    def run(s, d):
        return entries(s, d).select("uri", F.round(col(), 6).alias("r"))

    run.__name__ = name
    query(f"SELECT uri, round({sql}, 6) AS r FROM fx")(run)


_abs = lambda: F.abs(_days())
_expr("f_retention_e", lambda: F.exp(-_abs() / (7 * (1 + 0.5 * F.col("mvcc_version")))), f"exp(-abs({_DAYS}) / (7 * (1 + 0.5 * mvcc_version)))")
_expr("f_retention_sr", lambda: F.pow(F.lit(0.5), _abs() / F.col("mvcc_version")), f"pow(0.5, abs({_DAYS}) / mvcc_version)")
_expr("f_retention_b", lambda: (1 + F.col("mvcc_version")) / (2 + F.col("mvcc_version") + 0.5) * F.exp(-0.05 * _abs()), f"(1 + mvcc_version) / (2 + mvcc_version + 0.5) * exp(-0.05 * abs({_DAYS}))")
_expr(
    "f_halflife",
    lambda: clamp(180 * F.when(F.contains(F.lower("l0"), F.lit("api")), 0.55).otherwise(1.0) * F.when(F.contains(F.lower("l0"), F.lit("version")), 0.45).otherwise(1.0) * F.when(F.contains(F.lower("l0"), F.lit("today")), 0.5).otherwise(1.0) * F.when(F.contains(F.lower("l0"), F.lit("always")), 1.7).otherwise(1.0), 14.0, 730.0),
    "least(730.0, greatest(14.0, 180 * CASE WHEN contains(lower(l0), 'api') THEN 0.55 ELSE 1.0 END * CASE WHEN contains(lower(l0), 'version') THEN 0.45 ELSE 1.0 END * CASE WHEN contains(lower(l0), 'today') THEN 0.5 ELSE 1.0 END * CASE WHEN contains(lower(l0), 'always') THEN 1.7 ELSE 1.0 END))",
)
_text("f_expired", lambda: _days() > 180, f"{_DAYS} > 180")
_expr("f_reinforce", lambda: F.least(F.lit(365000.0), 30 * (1 + 0.2 * F.col("mvcc_version"))), "least(365000.0, 30 * (1 + 0.2 * mvcc_version))")
_expr("f_ucb", lambda: F.coalesce("quality", F.lit(0.5)) + F.sqrt(2 * F.log(F.lit(100.0)) / F.col("mvcc_version")), "coalesce(quality, 0.5) + sqrt(2 * ln(100.0) / mvcc_version)")
_expr("f_belief", lambda: (2 + F.col("mvcc_version") * F.coalesce("quality", F.lit(0.5))) / (4 + F.col("mvcc_version")), "(2 + mvcc_version * coalesce(quality, 0.5)) / (4 + mvcc_version)")
_expr("f_gauss", lambda: F.sqrt(2 * F.log(F.lit(1.25) / F.lit(1e-5))) * F.col("mvcc_version") / 2, "sqrt(2 * ln(1.25e0 / 1e-5)) * mvcc_version / 2")
_expr("f_dpo", lambda: -F.log(1 / (1 + F.exp(-0.1 * (F.coalesce("quality", F.lit(0.5)) - 0.4) * 10))) + 0.05 * (F.col("mvcc_version") % 3), "-ln(1 / (1 + exp(-0.1 * (coalesce(quality, 0.5) - 0.4) * 10))) + 0.05 * (mvcc_version % 3)")
_expr("f_reward", lambda: 0.5 * F.coalesce("quality", F.lit(0.5)) + 0.5 * F.least(F.lit(1.0), F.col("mvcc_version") / 10), "0.5 * coalesce(quality, 0.5) + 0.5 * least(1.0, mvcc_version / 10)")
_expr("f_weight", lambda: F.when(F.col("content_type") == "fact", 1.0).when(F.col("content_type") == "skill", 0.9).otherwise(0.6) * F.coalesce("quality", F.lit(0.5)), "CASE WHEN content_type = 'fact' THEN 1.0 WHEN content_type = 'skill' THEN 0.9 ELSE 0.6 END * coalesce(quality, 0.5)")
_zd = lambda: clamp(0.25 + 0.35 * (1 - F.coalesce("quality", F.lit(0.5))) + F.least(0.08 * F.col("mvcc_version"), F.lit(0.3)), 0.05, 0.95)
_expr("f_zpd", lambda: 1 - F.abs(_zd() - 0.6), "1 - abs(least(0.95, greatest(0.05, 0.25 + 0.35 * (1 - coalesce(quality, 0.5)) + least(0.08 * mvcc_version, 0.3))) - 0.6)")
_expr("f_puct", lambda: F.coalesce("quality", F.lit(0.5)) + 1.4 * 0.25 * F.sqrt(F.lit(100.0)) / (1 + F.col("mvcc_version")), "coalesce(quality, 0.5) + 1.4 * 0.25 * sqrt(100.0) / (1 + mvcc_version)")


def _vec(name, col, sql):
    def run(s, d):
        return _pairs(s, d).select("x", F.round(col(F.col("ea"), F.col("eb")), 5).alias("r"))

    run.__name__ = name
    query(f"SELECT x, round({sql}, 5) AS r FROM p", VEC)(run)


_vec("f_cosine", V.cosine, "list_cosine_similarity(ea, eb)")
_vec("f_cosdist", V.cosine_distance, "least(1.0, greatest(0.0, (1 - list_cosine_similarity(ea, eb)) / 2))")
_vec("f_eucl", V.squared_distance, "pow(list_distance(ea, eb), 2)")
_vec("f_l2", lambda a, b: V.norm(V.clip(a, 0.5)), "least(0.5, sqrt(list_dot_product(ea, ea)))")
_vec("f_capability", lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) & (y > 0)), lambda t: t)) / F.greatest(F.lit(1), F.size(F.filter(a, lambda x: x > 0))), "len(list_filter(list_zip(ea, eb), lambda t: t[1] > 0 AND t[2] > 0)) / greatest(1, len(list_filter(ea, lambda t: t > 0)))")


_BOOK = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"


@query("+ x AS (SELECT vec_id, s, m.label, round(list_distance(e[8 * s + 1:8 * s + 8], c[8 * s + 1:8 * s + 8]), 7) AS dist FROM v, m, range(8) t(s)), b AS (SELECT vec_id, s, arg_min(label, (dist, label)) AS code FROM x GROUP BY vec_id, s) SELECT vec_id, list(code ORDER BY s) AS codes FROM b GROUP BY vec_id", _BOOK)
def f_pq_encode(s, d):
    """Codes of all eight stretches, with the stretches of the labels' centroids as code book."""
    e = table(s, d, "embeddings")
    c = centroids(e, "label", "embedding")
    book = c.select("label", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("stretch"), "centroid").select("stretch", F.col("label").cast("int").alias("code"), F.slice("centroid", 8 * F.col("stretch") + 1, F.lit(8)).alias("word"))
    return Q.encode(e, book, "vec_id", "embedding")


@query()
def f_pq_train(s, d):
    return Q.train_codebook(table(s, d, "embeddings"), "vec_id", "embedding")


QUERIES, ORACLES = query.queries, query.oracles
