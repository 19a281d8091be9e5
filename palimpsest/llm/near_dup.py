"""Near-duplicate texts by bit-sliced comparison of word-set sketches.

Two texts are near-duplicates if the Jaccard similarity of their sets of words
is at least a threshold t. No such pair is lost:

* Texts with the same set form a class; only classes are compared.
* Words are put in a global order, rare ones first. Two sets with similarity t
  or more share a word among the first ``n - ceil(t n) + 1`` of each (prefix
  filter), so only classes that share such a word meet.
* A set's sketch has B bits, each the parity of the set's words hashed to it. The
  Hamming distance of two sketches is at most the size of the symmetric
  difference, which for similar sets is at most ``(1-t)/(1+t) (n1+n2)``: the
  radius. 64 sketches are stored vertically, bit plane by bit plane, in one
  64-bit word per plane; carry-save adders count 64 distances at once and a
  block is abandoned as soon as all of them exceed the radius.
* What is left is verified on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import keep

SLICES = 64
HOT_WORD = 20_000
BUFFER = 65_536
CHUNK = 16_384
SMALLEST, LARGEST = 256, 4096
COPIES_IN_FULL = 50
POSTINGS = 32_768
WORDS_AT_ONCE = 400_000


@dataclass(frozen=True)
class NearDuplicates:
    """members: id, class_id (texts with the same set of words); pairs: a, b, similarity of different classes, a < b; texts: id, class_id, text_id (equal texts)."""

    members: DataFrame
    pairs: DataFrame
    texts: DataFrame


def word_set(text: Column) -> Column:
    """Sorted hashes of the distinct words (runs of letters and digits, lower case)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _count_code(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of eight steps an octave; 0 and 1 stay exact."""
    return np.where(counts < 2, counts, 1 + np.ceil(8 * np.log2(np.maximum(counts, 2)))).clip(0, 255).astype(np.uint8)


def _bucket(words: np.ndarray, bits: int) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def word_counts(classes: DataFrame, n_classes: int) -> tuple[np.ndarray, int]:
    """How many sets hold a word, at least: code per hash bucket. Of fixed size (at most 16 MB), whatever the vocabulary."""
    bits = min(24, max(12, (64 * max(1, n_classes)).bit_length() - 1))
    width = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            total += np.bincount(_bucket(b.column(0).flatten().to_numpy(zero_copy_only=False), bits), minlength=1 << bits)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some])})

    def code(rows: pd.DataFrame) -> pd.DataFrame:
        # at most ``width`` rows, whatever the number of tasks that counted
        total = np.zeros(width, np.int64)
        total[rows["bucket"].to_numpy() % width] = rows["n"]
        return pd.DataFrame({"slice": [int(rows["bucket"].iloc[0]) // width], "codes": [_count_code(total).tobytes()]})

    sums = classes.select("words").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    parts = sums.groupBy(F.floor(F.col("bucket") / width).alias("part")).applyInPandas(code, "slice int, codes binary").collect()
    codes = np.zeros(1 << bits, np.uint8)
    for p in parts:
        codes[p["slice"] * width : (p["slice"] + 1) * width] = np.frombuffer(p["codes"], np.uint8)
    return codes, bits


_POST = "word long, kind int, lo int, hi int, n int, part int, cid long, sketch binary"


def _sketches(words: np.ndarray, doc: np.ndarray, n_docs: int, bits: int) -> np.ndarray:
    """Parity sketches, one row of bytes a document."""
    at = doc * bits + (words.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n_docs * bits) & 1).astype(np.uint8).reshape(n_docs, bits), axis=1, bitorder="little")


def _postings(classes: DataFrame, codes: np.ndarray, bits: int, t: float) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(codes.tobytes())

    def post(cid: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        n_docs = len(cid)
        doc = np.repeat(np.arange(n_docs), sizes)
        code = table[_bucket(words, bits)]
        order = np.lexsort(((code.astype(np.uint64) << np.uint64(56)) | (words.view(np.uint64) >> np.uint64(8)), doc))
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        rank = np.arange(len(words)) - np.repeat(starts, sizes)
        prefix = sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 1
        take = (rank < np.repeat(prefix, sizes)) & (code[order] > 1)
        w, d, c = words[order][take], doc[take], code[order][take]
        level = np.maximum(0, np.ceil(np.log(np.maximum(sizes, 1) / SMALLEST) / math.log(4) - 1e-12)).astype(np.int64)
        top = round(math.log(LARGEST / SMALLEST, 4))
        edge = (sizes >= t * SMALLEST * 4.0 ** level - 1e-9) & (level < top)
        level = np.minimum(level, top)
        rows = []
        for k in range(top + 1):
            mine = (level == k) | (edge & (level + 1 == k))
            if not mine.any():
                continue
            new = np.cumsum(mine) - 1
            of = mine[doc]
            sketch = _sketches(words[of], new[doc[of]], int(mine.sum()), SMALLEST * 4**k)
            here = mine[d]
            rows.append((w[here], np.full(here.sum(), k), d[here], c[here], sketch[new[d[here]]]))
        for w_, k_, d_, c_, s_ in rows:
            # a hot word is cut into parts by document; every two parts meet in a group of their own
            parts = np.maximum(1, np.ceil(np.exp2((c_.astype(np.float64) - 1) / 8) / HOT_WORD)).astype(np.int64)
            part = (cid[d_].view(np.uint64) % parts.astype(np.uint64)).astype(np.int64)
            ends = np.cumsum(parts)
            at = 0
            while at < len(w_):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS, "right")))
                n = parts[at:stop]
                again = np.repeat(np.arange(at, stop), n)
                other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                at = stop
                mine = part[again]
                sketch = np.ascontiguousarray(s_[again])
                width = sketch.shape[1]
                cols = {
                    "word": pa.array(w_[again], pa.int64()),
                    **{name: pa.array(v.astype(np.int32)) for name, v in (("kind", k_[again]), ("lo", np.minimum(mine, other)), ("hi", np.maximum(mine, other)), ("n", sizes[d_][again]), ("part", mine))},
                    "cid": pa.array(cid[d_][again], pa.int64()),
                    "sketch": pa.Array.from_buffers(pa.binary(), len(again), [None, pa.py_buffer((np.arange(len(again) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(sketch.tobytes())]),
                }
                yield pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(np.diff(whole.column(1).offsets.to_numpy()).astype(np.int64))
            at = 0
            while at < whole.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_AT_ONCE, "right")))
                b = whole.slice(at, stop - at)
                at = stop
                lists = b.column(1)
                yield from post(b.column(0).to_numpy(), np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)), np.diff(lists.offsets.to_numpy()).astype(np.int64))

    return classes.select("cid", "words").mapInArrow(run, _POST)


def _adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: bitwise sum and carry of three words."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _exceeds(counters: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose vertical counter is over the radius of their block."""
    more = np.zeros_like(counters[0])
    same = ~more
    for k in range(max(len(counters), int(radius.max(initial=0)).bit_length()) - 1, -1, -1):
        r = (-((radius >> k) & 1)).astype(np.int64).view(np.uint64)
        c = counters[k] if k < len(counters) else np.zeros_like(more)
        more |= same & c & ~r
        same &= ~(c ^ r)
    return more


def sliced_matches(sketch: np.ndarray, first: np.ndarray, last: np.ndarray, radius_of) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), first[i] <= j < last[i], whose sketches differ in at most radius_of(i, largest j) bits.

    ``sketch``: rows of bytes. Rows are put in blocks of 64; each query row meets
    the blocks that hold its candidates.
    """
    m, bits = len(sketch), sketch.shape[1] * 8
    pad = -m % 64
    flat = np.unpackbits(sketch, axis=1, bitorder="little")
    planes = np.empty((bits, (m + pad) // 64), np.uint64)
    for at in range(0, m, 4096):
        part = flat[at : at + 4096]
        part = np.pad(part, ((0, -len(part) % 64), (0, 0))).reshape(-1, 64, bits).transpose(2, 0, 1)
        planes[:, at // 64 : at // 64 + part.shape[1]] = np.ascontiguousarray(np.packbits(part, axis=2, bitorder="little")).view(np.uint64)[..., 0]
    own = np.ascontiguousarray(flat.T)
    del flat
    some = np.flatnonzero(last > first)
    n_blocks = (last[some] - 1) // 64 - first[some] // 64 + 1
    ends = np.cumsum(n_blocks)
    found_i, found_j = [], []
    full = ~np.uint64(0)
    at = 0
    while at < len(some):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        q = np.repeat(some[at:stop], n_blocks[at:stop])
        before = np.repeat(ends[at:stop] - n_blocks[at:stop], n_blocks[at:stop])
        block = first[q] // 64 + np.arange(len(q)) + (ends[at - 1] if at else 0) - before
        at = stop
        lo = np.maximum(first[q] - block * 64, 0).astype(np.uint64)
        hi = np.minimum(last[q] - block * 64, 64)
        alive = (full << lo) & (full >> (64 - hi).astype(np.uint64))
        radius = radius_of(q, block * 64 + hi - 1)
        low = [np.zeros(len(q), np.uint64) for _ in range(3)]
        high: list[np.ndarray] = []
        for p in range(0, bits, 8):
            x = [planes[p + k].take(block) ^ (np.uint64(0) - own[p + k].take(q).astype(np.uint64)) for k in range(8)]
            low[0], a = _adder(low[0], x[0], x[1])
            low[0], b = _adder(low[0], x[2], x[3])
            low[1], c = _adder(low[1], a, b)
            low[0], a = _adder(low[0], x[4], x[5])
            low[0], b = _adder(low[0], x[6], x[7])
            low[1], d = _adder(low[1], a, b)
            low[2], carry = _adder(low[2], c, d)
            for k in range(len(high)):
                high[k], carry = high[k] ^ carry, high[k] & carry
            if carry.any():
                high.append(carry)
            if p % 32 == 24 and (p + 8) > int(radius.min(initial=0)):
                alive &= ~_exceeds(low + high, radius)
                left = alive != 0
                if not left.all():
                    q, block, alive, radius = q[left], block[left], alive[left], radius[left]
                    low, high = [v[left] for v in low], [v[left] for v in high]
                    if not len(q):
                        break
        if len(q):
            alive &= ~_exceeds(low + high, radius)
            lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(lanes)
            found_i.append(q[r])
            found_j.append(block[r] * 64 + lane)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _candidates(postings: DataFrame, t: float) -> DataFrame:
    factor = (1 - t) / (1 + t)

    def compare(kind: np.ndarray, group: np.ndarray, n: np.ndarray, part: np.ndarray, same: np.ndarray, cid: np.ndarray, sketch: pa.Array) -> pa.RecordBatch:
        out_a, out_b = [], []
        for k in np.unique(kind):
            rows = np.flatnonzero(kind == k)
            size, g = n[rows], group[rows]
            width = SMALLEST * 4 ** int(k) // 8
            s = np.frombuffer(sketch.take(pa.array(rows)).buffers()[2], np.uint8)[: len(rows) * width].reshape(-1, width)
            place = g * (1 << 32) + size
            last = np.searchsorted(place, g * (1 << 32) + np.floor(size / t + 1e-9).astype(np.int64), "right")
            i, j = sliced_matches(s, np.arange(1, len(rows) + 1), last, lambda q, e, size=size: np.floor(factor * (size[q] + size[e]) + 1e-9).astype(np.int64))
            i, j = rows[i], rows[j]
            ok = (cid[i] != cid[j]) & (same[i] | (part[i] != part[j]))
            out_a.append(np.minimum(cid[i], cid[j])[ok])
            out_b.append(np.maximum(cid[i], cid[j])[ok])
        pairs = np.unique(np.stack((np.concatenate(out_a), np.concatenate(out_b)), axis=1), axis=0)
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def arrays(t_: pa.Table):
            get = lambda c: t_.column(c).to_numpy()
            kind, word, lo, hi = get("kind"), get("word"), get("lo"), get("hi")
            new = np.ones(len(kind), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (word[1:] != word[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            return kind, np.cumsum(new) - 1, get("n").astype(np.int64), get("part"), lo == hi, get("cid"), t_.column("sketch").combine_chunks()

        def flush(t_: pa.Table) -> pa.RecordBatch:
            kind, group, n, part, same, cid, sketch = arrays(t_)
            counts = np.bincount(group)
            use = counts[group] > 1
            if not use.all():
                keep_rows = np.flatnonzero(use)
                kind, group, n, part, same, cid = kind[use], group[use], n[use], part[use], same[use], cid[use]
                sketch = sketch.take(pa.array(keep_rows))
            if not len(kind):
                return pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            return compare(kind, group, n, part, same, cid, sketch)

        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows >= BUFFER:
                _, group, *_ = arrays(held)
                whole = int(np.searchsorted(group, group[-1]))
                if whole:
                    yield flush(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield flush(held)

    sorted_ = postings.repartition("kind", "word", "lo", "hi").sortWithinPartitions("kind", "word", "lo", "hi", "n")
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and one set of words a class. Different sets that hash alike are hashed again, so a class is a set."""
    seed = 0
    while True:
        rows = keep(rows, "words")
        classes = keep(rows.groupBy(F.col("class_id").alias("cid")).agg(F.min("words").alias("words"), F.max("words").alias("last")).select("cid", "words", (F.col("words") != F.col("last")).alias("clash")), "classes")
        clash = classes.filter("clash").select(F.col("cid").alias("class_id"), "clash")
        if clash.isEmpty():
            return rows, classes.select("cid", "words")
        seed += 1
        rows = rows.join(clash, "class_id", "left").select("id", "words", "text_id", F.when(F.col("clash"), F.xxhash64(F.lit(seed), "words")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(df: DataFrame, id_col: str, text: Column, threshold: float = 0.8) -> NearDuplicates:
    """Classes of equal word sets, and all pairs of classes with a similarity of ``threshold`` or more.

    A hot word (over ``HOT_WORD`` sets) is cut into parts, and every two parts
    meet in a task of their own. Null, blank and word-less texts belong to no class. Repeated rows of one
    id make one member per distinct text. Texts are read whole.
    """
    rows = df.select(F.col(id_col).alias("id"), word_set(text).alias("words"), F.md5(text).alias("text_id")).filter(F.col("id").isNotNull() & (F.size("words") > 0)).withColumn("class_id", F.xxhash64("words"))
    rows, classes = _classes(rows)
    members = rows.select("id", "class_id").distinct()
    codes, bits = word_counts(classes, classes.count())
    found = keep(_candidates(_postings(classes, codes, bits, threshold), threshold), "candidates")
    ids = found.select(F.col("a").alias("cid")).unionByName(found.select(F.col("b").alias("cid"))).distinct()
    sets = keep(classes.join(ids, "cid", "left_semi"), "sets")
    both = found.join(sets.select(F.col("cid").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    pairs = both.select("a", "b", (common / (F.size("wa") + F.size("wb") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)
    return NearDuplicates(members, keep(pairs, "pairs"), rows.select("id", "class_id", "text_id").distinct())


def document_pairs(found: NearDuplicates) -> DataFrame:
    """Pairs of ids (id_a < id_b), distinct. Of over ``COPIES_IN_FULL`` ids with the very same text, every one is paired with the smallest, and only that one with other texts; all other pairs are written out, large classes in salted parts."""
    sizes = found.texts.groupBy("class_id", "text_id").agg(F.count("*").alias("n"), F.min("id").alias("head"))
    m = found.texts.join(sizes, ["class_id", "text_id"])
    heads = m.filter((F.col("n") <= COPIES_IN_FULL) | (F.col("id") == F.col("head"))).select("class_id", "id").distinct()
    parts = heads.groupBy("class_id").agg(F.count("*").alias("k")).filter("k > 1").select("class_id", F.least(F.lit(64), F.ceil(F.col("k") / 1000)).cast("int").alias("parts"))
    few = heads.join(parts, "class_id")
    left = few.select("class_id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("x"))
    right = few.select("class_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("y"))
    inside = left.join(right, ["class_id", "part"]).select("x", "y")
    star = m.filter((F.col("n") > COPIES_IN_FULL) & (F.col("id") != F.col("head"))).select(F.col("head").alias("x"), F.col("id").alias("y"))
    across = found.pairs.join(heads.select(F.col("class_id").alias("a"), F.col("id").alias("x")), "a").join(heads.select(F.col("class_id").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    every = inside.unionByName(star).unionByName(across).filter("x <> y")
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def duplicate_groups(found: NearDuplicates) -> DataFrame:
    """One row per id and text class: id, class_id and group_id (smallest id of the class and of its connected classes), n_links (similar other classes), n_copies."""
    comp = connected_components(found.pairs, "a", "b").select(F.col("node").alias("class_id"), "component")
    links = found.pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    classes = found.members.groupBy("class_id").agg(F.count("*").alias("n_copies"), F.min("id").alias("head"))
    classes = classes.join(comp, "class_id", "left").join(links, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    groups = classes.groupBy("component").agg(F.min("head").alias("group_id"))
    each = classes.join(groups, "component").select("class_id", "head", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return found.members.join(each, "class_id").select("id", F.col("head").alias("class_id"), "group_id", "n_links", "n_copies")
