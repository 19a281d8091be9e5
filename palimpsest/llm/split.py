"""Cutting long texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("section", "paragraph", "sentence", "word", "character")
# what ends a unit of each level; the cut falls behind the match
ENDS = (
    re.compile(r"\f|(?:\r\n|\n|\r)(?=[ \t]*(?:\r\n|\n|\r))*(?=#{1,6}[ \t]|[-=*_]{3,}[ \t]*(?:\r|\n|$))"),
    re.compile(r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+"),
    re.compile(r"[.!?…][\"'”»)\]]*\s+|(?:\r\n|\n|\r)"),
    re.compile(r"\s+"),
)


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part what belongs together."""
    return text[at - 1 : at + 1] == "\r\n" or unicodedata.combining(text[at]) != 0 or text[at] in "‍️" or text[at - 1] == "‍"


def atoms(text: str, most: int, start: int = 0, end: int | None = None, level: int = 0) -> Iterator[tuple[int, int, int]]:
    """Consecutive (start, end, level of the cut behind it) of at most ``most`` characters, on the highest level that allows it."""
    end = len(text) if end is None else end
    if end - start <= most:
        if end > start:
            yield start, end, max(0, level - 1)
        return
    if level == len(ENDS):
        while end - start > most:
            cut = start + most
            low = max(start + 1, cut - 32)
            while cut > low and _joined(text, cut):
                cut -= 1
            if cut == low and _joined(text, cut):
                cut = start + most
            yield start, cut, level
            start = cut
        yield start, end, level - 1
        return
    at = start
    for m in ENDS[level].finditer(text, start, end):
        if at < m.end() < end:
            yield from atoms(text, most, at, m.end(), level + 1)
            at = m.end()
    yield from atoms(text, most, at, end, level + 1)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, level of the cut) of the pieces: at most ``limit`` characters, each but the first starting ``overlap`` before the end of the last."""
    out, start, end, how = [], 0, 0, 0
    for _, b, level in atoms(text, limit - overlap):
        if b - start > limit:
            out.append((start, end, how))
            start = end - overlap
        end, how = b, level
    if end > start:
        out.append((start, end, 0))
    return out


def split_long(df: DataFrame, id_col: str, text_col: str, limit: int = 6000, overlap: int = 200) -> DataFrame:
    """Pieces of the texts of over ``limit`` characters (code points).

    A text is split by section, what is still too long by paragraph, then
    sentence, word and character; the parts are packed greedily up to the limit, and every
    piece but the first repeats the last ``overlap`` characters of the one before. So
    the first piece and the others without their first ``overlap`` characters make
    up the text. Sections begin at a form feed, a heading or a rule. Where a piece ends between
    characters, no line end (CR LF), combining mark or joined symbol is cut apart. Where it starts is settled by the
    overlap, which is exact in code points: that may be within a word or a combined character.

    Result: the id, piece (from 0), start, end, cut (level of the boundary at its end), text. Texts up to
    the limit and null texts have no pieces; each row is cut by itself, so repeated rows
    give repeated pieces. Other columns are not read.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be less than half the limit")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                rows = [(i, *p) for i, text in enumerate(some.column(1).to_pylist()) for p in [(k, s, e, LEVELS[c], text[s:e]) for k, (s, e, c) in enumerate(pieces(text, limit, overlap))]]
                if rows:
                    i, k, s, e, c, t = zip(*rows)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(i)), pa.array(k, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(c), pa.array(t)], [id_col, "piece", "start", "end", "cut", "text"])

    long = df.select(id_col, text_col).filter(F.length(text_col) > limit)
    return long.mapInArrow(run, f"`{id_col}` {kind}, piece int, start int, end int, cut string, text string")


def rejoined(pieces_: DataFrame, id_col: str, overlap: int = 200) -> DataFrame:
    """Per id, for one text each: n_pieces, longest piece, and the number of characters and hash of the text put together again."""
    own = F.struct("piece", F.when(F.col("piece") == 0, F.col("text")).otherwise(F.expr(f"substring(text, {overlap + 1})")).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda p: p["t"]), "")
    g = pieces_.groupBy(id_col).agg(F.count("*").alias("n_pieces"), F.max(F.length("text")).alias("longest"), whole.alias("whole"))
    return g.select(id_col, "n_pieces", "longest", F.length("whole").alias("n_chars"), F.md5("whole").alias("hash"))
