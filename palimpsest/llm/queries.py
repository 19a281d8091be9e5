"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import keep
from ..tables import table
from .knn import nearest, similar_pairs
from .mixing import Mix, mix_sources
from .near_dup import NearDuplicates, document_pairs, duplicate_groups, near_duplicates
from .packing import container_report, pack_documents, packing_check
from .quality import STATS, text_quality, text_statistics
from .split import rejoined, split_long


def entry_text() -> Column:
    """An entry's full text or, where that is blank, its abstract."""
    return F.when(F.col("l2_full_text").rlike(r"[^\s\p{Z}]"), F.col("l2_full_text")).otherwise(F.col("l0_abstract"))


def _near(spark: SparkSession, d: str, threshold: float) -> NearDuplicates:
    return near_duplicates(table(spark, d, "context_entries"), "uri", entry_text(), threshold)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return document_pairs(_near(spark, d, 0.7)).select(F.col("id_a").alias("uri_a"), F.col("id_b").alias("uri_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(_near(spark, d, 0.7)).withColumnRenamed("id", "uri")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every distinct long text of an entry; an entry of several texts has pieces of each."""
    return split_long(table(spark, d, "context_entries").select("uri", "l2_full_text").distinct(), "uri", "l2_full_text", 6000, 200)


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The long texts put together again from their pieces; of an entry of several texts the smallest."""
    one = table(spark, d, "context_entries").filter(F.length("l2_full_text") > 6000).groupBy("uri").agg(F.min("l2_full_text").alias("t"))
    return rejoined(split_long(one, "uri", "t", 6000, 200), "uri", 200).select("uri", (F.col("longest") <= 6000).alias("fits"), "n_chars", "hash")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries that come out in more than one piece."""
    cut = split_long(table(spark, d, "context_entries"), "uri", "l2_full_text", 6000, 200)
    return cut.filter("piece > 0").select("uri").distinct()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    entries, bodies = table(spark, d, "context_entries"), table(spark, d, "antibodies")
    parsed = F.from_json("custom_json", "embedding_vector array<double>")["embedding_vector"]
    return entries.select(F.lit("context_entries").alias("set"), F.col("uri").alias("key"), parsed.alias("vec")).unionByName(
        bodies.select(F.lit("antibodies").alias("set"), F.col("id").alias("key"), F.col("pattern_signature").cast("array<double>").alias("vec"))
    )


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest(_vectors(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(nearest(_vectors(spark, d)), 0.9).withColumnRenamed("set", "vec_table")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), "doc_id", "text", 2048)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return container_report(keep(p8_pack(spark, d), "packed"), 2048)


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    return packing_check(keep(p8_pack(spark, d), "packed"), "doc_id", 2048)


def _mix(spark: SparkSession, d: str) -> Mix:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).schedule


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether no document is used more than allowed, every copy has a slot of its source's, and shares sum up."""
    m = _mix(spark, d)
    used = m.schedule.groupBy("source").agg(F.max("copy").alias("last"), F.min(F.col("slot").isNotNull()).alias("placed"), F.sum("n_tokens").alias("put"), F.count_distinct("slot").alias("slots"), F.count_distinct("block").alias("blocks"))
    s = m.shares.join(used, "source", "left")
    kept = (F.coalesce("last", F.lit(-1)) < F.col("max_repeats")) & F.coalesce("placed", F.lit(True)) & (F.coalesce("put", F.lit(0)) == F.col("tokens")) & F.coalesce(F.col("slots") == F.col("blocks"), F.lit(True))
    return s.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", kept.alias("kept"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_quality(spark, d).filter("is_junk").select("doc_id").distinct()


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "documents"), "doc_id", "text", "lang", table(spark, d, "common_words"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = text_statistics(table(spark, d, "documents"), "doc_id", "text", "lang", table(spark, d, "common_words"))
    return stats.select("doc_id", "lang", "n_words", *[F.round(c, 6).alias(c) for c in STATS[1:]])


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pieces, p2_rejoined, p4_found, p4_neighbours, p8_pack, p8_containers, p8_check, p9_mix, p9_shares, p9_check, p10_found, p10_quality, p10_statistics)}

_WORDS = "list_distinct(regexp_extract_all(lower(CASE WHEN regexp_matches(coalesce(l2_full_text, ''), '\\S') THEN l2_full_text ELSE l0_abstract END), '[\\p{L}\\p{N}]+'))"

_STATS = """
 WITH cw AS (SELECT lang AS l, list(DISTINCT word) AS listed FROM common_words WHERE word IS NOT NULL GROUP BY lang),
 d AS (SELECT doc_id, lang, text, regexp_replace(text, '\\s', '', 'g') AS solid, regexp_extract_all(lower(text), '\\p{L}+') AS w,
   list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents),
 s AS (SELECT doc_id, lang, CASE WHEN solid <> '' THEN len(w) END AS n_words,
   CASE WHEN solid <> '' AND len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) END AS mean_word_length,
   CASE WHEN solid <> '' THEN length(regexp_replace(solid, '[\\p{L}\\p{N}]', '', 'g')) / length(solid) END AS symbol_ratio,
   CASE WHEN solid <> '' THEN len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…]["''”»)\\]]*$'))) / len(lines) END AS line_end_ratio,
   CASE WHEN solid <> '' AND len(w) > 0 THEN len(list_filter(w, lambda x: coalesce(list_contains(listed, x), false))) / len(w) END AS common_ratio
  FROM d LEFT JOIN cw ON cw.l = d.lang)
"""

_VECTORS = """
 WITH v AS (SELECT 'context_entries' AS t, uri AS k, TRY_CAST(TRY_CAST(custom_json AS JSON)->'embedding_vector' AS DOUBLE[]) AS e FROM context_entries
   UNION ALL SELECT 'antibodies', id, pattern_signature::DOUBLE[] FROM antibodies),
 f AS (SELECT t, k, min(e) AS e FROM v WHERE k IS NOT NULL AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY t, k),
 u AS (SELECT t, k, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM f),
 p AS (SELECT a.t, a.k AS x, b.k AS y, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.t = b.t AND a.k <> b.k),
 r AS (SELECT *, row_number() OVER (PARTITION BY t, x ORDER BY s DESC, y) AS i FROM p)
"""

ORACLES = {
    "p2_rejoined": "SELECT uri, true AS fits, length(min(l2_full_text)) AS n_chars, md5(min(l2_full_text)) AS hash FROM context_entries WHERE length(l2_full_text) > 6000 GROUP BY uri",
    "p8_check": "SELECT DISTINCT doc_id, true AS whole, true AS fits FROM documents",
    "p9_check": "SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, round(sum(coalesce(target_share, 0)), 9) AS target_share, max(coalesce(max_repeats, 1)) AS max_repeats, true AS kept FROM mix_targets WHERE source IS NOT NULL GROUP BY 1",
    "p4_found": _VECTORS + " SELECT DISTINCT t AS vec_table, least(x, y) AS key_a, greatest(x, y) AS key_b FROM r WHERE i <= 5 AND s >= 0.9",
    "p2_found": "SELECT DISTINCT uri FROM context_entries WHERE length(l2_full_text) > 6000",
    "p10_statistics": _STATS + "SELECT doc_id, lang, n_words, round(mean_word_length, 6) AS mean_word_length, round(symbol_ratio, 6) AS symbol_ratio, round(line_end_ratio, 6) AS line_end_ratio, round(common_ratio, 6) AS common_ratio FROM s",
    "p10_found": _STATS + "SELECT DISTINCT doc_id FROM s WHERE n_words = 0 OR (line_end_ratio < 0.5)::INT + (common_ratio < 0.25)::INT + (symbol_ratio > 0.12)::INT + (mean_word_length < 3 OR mean_word_length > 8)::INT >= 2",
    "p1_found": f"""
 WITH s AS (SELECT DISTINCT uri, {_WORDS} AS w FROM context_entries WHERE uri IS NOT NULL),
 p AS (SELECT a.uri AS x, b.uri AS y, len(a.w) AS m, len(b.w) AS n, len(list_intersect(a.w, b.w)) AS k FROM s a JOIN s b ON a.uri < b.uri AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w))
 SELECT DISTINCT x AS uri_a, y AS uri_b FROM p WHERE k > 0 AND 10 * k >= 7 * (m + n - k)""",
    "p1_groups": f"""
 WITH RECURSIVE s AS (SELECT DISTINCT uri, list_sort({_WORDS}) AS w FROM context_entries WHERE uri IS NOT NULL),
 c AS (SELECT w, min(uri) AS h, count(*) AS n FROM s WHERE len(w) > 0 GROUP BY w),
 p AS (SELECT a.h AS x, b.h AS y, len(a.w) AS m, len(b.w) AS n, len(list_intersect(a.w, b.w)) AS k FROM c a JOIN c b ON a.w <> b.w AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w)),
 l AS (SELECT x, y FROM p WHERE k > 0 AND 10 * k >= 7 * (m + n - k)),
 r(x, y) AS (SELECT h, h FROM c UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
 g AS (SELECT x, min(y) AS g FROM r GROUP BY x)
 SELECT s.uri, c.h AS class_id, g.g AS group_id, (SELECT count(*) FROM l WHERE l.x = c.h) AS n_links, c.n AS n_copies FROM s JOIN c ON c.w = s.w JOIN g ON g.x = c.h""",
}
