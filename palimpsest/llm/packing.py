"""Packing texts into containers of a fixed number of tokens: minimum bin slack."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import keep
from .tokens import TOKENIZER, numbered_copies, token_counts

SHARD_TOKENS = 1 << 22


def fullest(room: int, lengths: list[int], stock: dict[int, list]) -> list[int]:
    """The lengths, each no more often than in stock, whose sum comes closest to ``room`` from below.

    Bit s of a number is set if s can be reached; adding an item is one shift.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(len(stock[n]), room // n)):
            new = (reach | (reach << n)) & mask
            if new == reach:
                break
            steps.append((n, reach))
            reach = new
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> at & 1:
            taken.append(n)
            at -= n
    return taken


def pack(items: list[tuple], capacity: int) -> list[list[tuple]]:
    """Containers of (size, ...) items, each size from 1 to ``capacity``. The largest item left opens a container; the fullest combination that fits beside it closes it."""
    stock: dict[int, list] = defaultdict(list)
    for item in sorted(items, reverse=True):
        stock[item[0]].append(item)
    lengths = sorted(stock, reverse=True)
    out = []
    while lengths:
        first = lengths[0]
        bin_ = [stock[first].pop()]
        if not stock[first]:
            lengths.pop(0)
        for n in fullest(capacity - first, lengths, stock):
            bin_.append(stock[n].pop())
            if not stock[n]:
                lengths.remove(n)
        out.append(bin_)
    return out


def pack_documents(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Where each document's tokens lie: id, part, token_from, token_to, container, offset, n_tokens.

    Documents are spread evenly by hash over shards of about ``shard_tokens``
    tokens, so shards stay of one size whatever the data; each shard is packed by
    itself. A document over the capacity fills containers of its own and leaves one rest;
    no other is cut. Documents without tokens (null or empty text) come out with a null
    container. Repeated rows are packed each. The result depends on ids and texts alone, not on files or partitions.
    """
    key = F.col(id_col)
    kind = df.schema[id_col].dataType.simpleString()
    sizes = keep(token_counts(df.select(key.alias("id"), F.col(text_col).alias("text")), "text", tokenizer), "tokens")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    spread = numbered_copies(sizes).withColumn("shard", F.pmod("h", F.lit(shards)))
    names = ["id", "part", "token_from", "token_to", "container", "offset", "n_tokens"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        rows = rows.sort_values(["n_tokens", "h"], kind="stable")
        items, out, n_bins = [], [], 0
        for row, (doc, n) in enumerate(zip(rows["id"].tolist(), rows["n_tokens"].tolist())):
            full = n // capacity
            for k in range(full):
                out.append((doc, k, k * capacity, (k + 1) * capacity, n_bins, 0, capacity))
                n_bins += 1
            if n % capacity:
                items.append((n % capacity, row, doc, full))
            elif not n:
                out.append((doc, 0, 0, 0, None, None, 0))
        for bin_ in pack(items, capacity):
            offset = 0
            for n, _, doc, part in bin_:
                out.append((doc, part, part * capacity, part * capacity + n, n_bins, offset, n))
                offset += n
            n_bins += 1
        t = pd.DataFrame(out, columns=names)
        t["container"] = t["container"].astype("Int64") + (shard << 32)
        t["offset"] = t["offset"].astype("Int64")
        return t

    schema = f"id {kind}, part int, token_from bigint, token_to bigint, container bigint, offset bigint, n_tokens bigint"
    return spread.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("id", id_col)


def packing_check(packed: DataFrame, id_col: str, capacity: int = 2048) -> DataFrame:
    """Per document whether its parts cover its tokens once and in order (``whole``, repeats of an id counted each) and fit their containers without lying on each other (``fits``)."""
    w = W.partitionBy("container").orderBy("offset")
    laid = packed.withColumn("end", F.coalesce(F.lag(F.col("offset") + F.col("n_tokens")).over(w), F.lit(0)))
    ok = F.col("container").isNull() & (F.col("n_tokens") == 0) | (F.col("offset") == F.col("end")) & (F.col("offset") + F.col("n_tokens") <= capacity)
    inside = laid.select(id_col, "part", "token_from", "token_to", "n_tokens", F.coalesce(ok, F.lit(False)).alias("ok"))
    covers = (F.col("token_to") - F.col("token_from") == F.col("n_tokens")) & (F.col("token_from") == F.col("part").cast("bigint") * capacity)
    parts = inside.groupBy(id_col).agg((F.min(covers) & (F.count_distinct("part") == F.max("part") + 1)).alias("whole"), F.min("ok").alias("fits"))
    return parts


def container_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, share of room used, containers filled to the last token."""
    bins = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return bins.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"), F.count(F.when(F.col("used") == capacity, 1)).alias("n_full"))
