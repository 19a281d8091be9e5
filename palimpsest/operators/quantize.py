"""Product quantisation: a code book per stretch of the vector, and codes by nearest word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4_096
MOST_WORDS = 1_000


def _far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """The first row, then always the one farthest from those taken."""
    taken, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(taken) < k:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[taken[-1]]) ** 2).sum(axis=1))
    return x[taken].copy()


def means(x: np.ndarray, k: int, rounds: int = 24) -> np.ndarray:
    """``k`` centres of the rows by k-means; a centre that nobody is nearest to becomes a row."""
    c, last = _far_apart(x, k), None
    for _ in range(rounds):
        own = np.argmin((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), axis=1)
        if last is not None and (own == last).all():
            break
        last = own
        for j in range(k):
            mine = own == j
            c[j] = x[mine].mean(axis=0) if mine.any() else x[j % len(x)]
    return c


def train_codebook(df: DataFrame, key: str, vec: str, stretches: int = 8, words: int = 16, sample: int = SAMPLE) -> DataFrame:
    """Code book: stretch, code, word. Fitted on at most about ``sample`` vectors taken by the hash of their key (all rows are encoded with it); each stretch by a task of its own."""
    n = max(1, df.count())
    some = df.filter(F.col(vec).isNotNull() & (F.size(vec) >= stretches)).filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))
    size = F.size(vec)
    cut = F.transform(F.sequence(F.lit(0), F.lit(stretches - 1)), lambda i: F.slice(vec, F.floor(i * size / stretches).cast("int") + 1, (F.floor((i + 1) * size / stretches) - F.floor(i * size / stretches)).cast("int")))
    parts = some.select(F.col(key).cast("string").alias("k"), F.posexplode(cut).alias("stretch", "x"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("k")["x"].tolist()).astype(np.float64)
        c = means(x, min(words, len(x)))
        return pd.DataFrame({"stretch": int(rows["stretch"].iloc[0]), "code": range(len(c)), "word": [w.tolist() for w in c]})

    return parts.groupBy("stretch").applyInPandas(fit, "stretch int, code int, word array<double>")


def encode(df: DataFrame, book: DataFrame, key: str, vec: str) -> DataFrame:
    """The nearest word of every stretch: key, codes; ties (to seven digits) by the smaller code. The book, refused over ``MOST_WORDS`` words a stretch, goes to every task; null vectors have null codes."""
    rows = book.groupBy("stretch").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    if rows[0] is None or rows[0] > MOST_WORDS or rows[1] > MOST_WORDS:
        raise ValueError("no code book, or too large a one")
    t = book.toPandas().sort_values(["stretch", "code"])
    books = [(np.array(g["code"]), np.stack(g["word"].tolist()).astype(np.float64)) for _, g in t.groupby("stretch")]
    sent = df.sparkSession.sparkContext.broadcast(books)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
            codes, at = [], 0
            for names, c in sent.value:
                x = v[:, at : at + c.shape[1]]
                at += c.shape[1]
                d = np.round(np.sqrt(np.maximum(0, ((x[:, None, :] - c[None]) ** 2).sum(axis=2))), 7)
                codes.append(names[d.argmin(axis=1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.stack(codes, axis=1).tolist(), pa.list_(pa.int32()))], [key, "codes"])

    known = df.filter(F.col(vec).isNotNull()).select(key, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(run, f"`{key}` {kind}, codes array<int>")
    return known.unionByName(df.filter(F.col(vec).isNull()).select(key, F.lit(None).cast("array<int>").alias("codes")))
