"""Statistics that tell running prose from lists, tables and junk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import keep

STATS = ("n_words", "mean_word_length", "symbol_ratio", "line_end_ratio", "common_ratio")
RANKS = [i / 100 for i in range(101)]
MOST_WORDS = 100_000
# limits of running prose: statistic, smallest and largest value
LIMITS = (("line_end_ratio", 0.5, None), ("common_ratio", 0.25, None), ("symbol_ratio", None, 0.12), ("mean_word_length", 3.0, 8.0))

_WORD = regex.compile(r"\p{L}+")
_SYMBOL = re.compile(r"[^\w\s]|_")
_END = re.compile(r"[.!?…][\"'”»)\]]*\Z")


def measure(text: str, common: frozenset[str]) -> tuple | None:
    """The statistics of one text, None if it is blank."""
    solid = len("".join(text.split()))
    if not solid:
        return None
    words = _WORD.findall(text.lower())
    lines = [s for line in text.split("\n") if (s := line.strip())]
    n = len(words)
    ends = sum(1 for s in lines if _END.search(s[-12:]) or s[-1] in "\"'”»)]" and _END.search(s))
    return (n, sum(map(len, words)) / n if n else None, len(_SYMBOL.findall(text)) / solid, ends / len(lines), sum(map(common.__contains__, words)) / n if n else None)


def text_statistics(df: DataFrame, id_col: str, text_col: str, lang_col: str, common_words: DataFrame) -> DataFrame:
    """Statistics of each text, read whole: id, lang, then ``STATS``; null for null and blank texts.

    ``common_words`` (lang, word) must be a list of bounded size (checked); it is sent to the executors. There is a grid a language; they are few by nature.
    """
    listed = common_words.filter("lang is not null and word is not null").limit(MOST_WORDS + 1).collect()
    if len(listed) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} common words")
    by_lang: dict[str, frozenset[str]] = {lang: frozenset(r["word"] for r in listed if r["lang"] == lang) for lang in {r["lang"] for r in listed}}
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = frozenset()
        for b in batches:
            got = [measure(t, by_lang.get(lang, none)) if t else None for lang, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = list(zip(*(g or (None,) * len(STATS) for g in got))) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[1:]]], ["id", "lang", *STATS])

    return df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang string, n_words bigint, " + ", ".join(f"{s} double" for s in STATS[1:])).withColumnRenamed("id", id_col)


def text_quality(df: DataFrame, id_col: str, text_col: str, lang_col: str, common_words: DataFrame, tail: float = 0.01) -> DataFrame:
    """Statistics with each one's percentile and robust z-score within its language, tail flags and verdict.

    Every statistic gets a KLL sketch per language (null is a language of its
    own); sketches merge, so partitions are sketched where they lie. From the
    sketch come a grid of 101 quantiles, the median and the quartiles. ``<stat>_pct``: highest
    grid quantile not above the value; ``<stat>_z``: distance from the median in
    units of IQR/1.349, null where the quartiles are equal. ``tails``: the statistics in the lowest or highest
    ``tail`` of the language. ``is_junk``: there is text but no word, or two or more statistics lie in the tail that a limit of running prose cuts off, by
    percentile, and, checked exactly, beyond that limit. Null and blank texts have null statistics and are not junk.
    """
    stats = keep(text_statistics(df, id_col, text_col, lang_col, common_words), "quality")
    sketches = stats.groupBy("lang").agg(*[F.kll_sketch_agg_double(F.col(s).cast("double")).alias(s) for s in STATS])
    ranks = F.array(*[F.lit(r) for r in RANKS])
    grids = sketches.select(F.col("lang").alias("of_lang"), *[F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, ranks)).alias(f"{s}_grid") for s in STATS])
    grids = keep(grids, "grids")
    x = stats.join(F.broadcast(grids), F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    low, high = round(100 * tail), round(100 * (1 - tail))
    reached = lambda s, v: F.greatest(F.lit(0.0), (F.size(F.filter(F.col(f"{s}_grid"), lambda q: q <= v)) - 1) / 100)
    extra, tails = [], []
    for s in STATS:
        v, g = F.col(s).cast("double"), F.col(f"{s}_grid")
        extra.append(F.when(v.isNotNull(), reached(s, v)).alias(f"{s}_pct"))
        extra.append(F.when(g[75] > g[25], (v - g[50]) / ((g[75] - g[25]) / 1.349)).alias(f"{s}_z"))
        tails.append(F.when((v < g[low]) | (v > g[high]), F.lit(s)))
    # a value beyond a limit has a percentile at or beyond the limit's, whatever the error of the sketch
    beyond, broken = F.lit(0), F.lit(0)
    for s, least, most in LIMITS:
        v = F.col(s)
        tail_of, over = F.lit(False), F.lit(False)
        if least is not None:
            tail_of, over = tail_of | (reached(s, v) <= reached(s, F.lit(least))), over | (v < least)
        if most is not None:
            tail_of, over = tail_of | (reached(s, v) >= reached(s, F.lit(most))), over | (v > most)
        beyond = beyond + F.coalesce(tail_of & v.isNotNull(), F.lit(False)).cast("int")
        broken = broken + F.coalesce(over, F.lit(False)).cast("int")
    junk = F.coalesce((F.col("n_words") == 0) | (beyond >= 2) & (broken >= 2), F.lit(False))
    return x.select(id_col, "lang", *STATS, *extra, F.array_compact(F.array(*tails)).alias("tails"), junk.alias("is_junk"))
