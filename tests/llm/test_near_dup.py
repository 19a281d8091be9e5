import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import near_dup
from palimpsest.llm.near_dup import document_pairs, duplicate_groups, near_duplicates, sliced_matches

W = re.compile(r"[^\W_]+")


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            words = r.choice(rows)[1].split()
            for _ in range(r.randrange(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocab)
        else:
            words = [r.choice(vocab[:60] if r.random() < 0.6 else vocab) for _ in range(r.choice([3, 10, 40, 300, 900]))]
        rows.append((f"d{i}", " ".join(words)))
    return rows


def brute(rows, t):
    sets = {}
    for k, x in rows:
        if k is not None and x is not None and W.findall(x.lower()):
            sets.setdefault(k, []).append(frozenset(W.findall(x.lower())))
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(len(x & y) / len(x | y) >= t for x in sets[a] for y in sets[b])}


def pairs(spark, rows, t):
    df = spark.createDataFrame(rows, "id string, text string").withColumn("class_id", F.lit("clash"))
    return {tuple(r) for r in document_pairs(near_duplicates(df, "id", F.col("text"), t)).collect()}


@pytest.mark.parametrize("t", [0.5, 0.7, 0.8, 1.0])
def test_against_all_pairs(spark, t):
    rows = corpus(1)
    assert pairs(spark, rows, t) == brute(rows, t)


def test_hot_words_are_cut_up(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT_WORD", 8)
    monkeypatch.setattr(near_dup, "BUFFER", 64)
    rows = corpus(2)
    assert pairs(spark, rows, 0.7) == brute(rows, 0.7)


def test_many_tasks_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "POSTINGS", 5)
    monkeypatch.setattr(near_dup, "WORDS_AT_ONCE", 50)
    rows = corpus(3)
    sets = spark.createDataFrame([(i, sorted({hash(w) for w in x.split()})) for i, (_, x) in enumerate(rows)], "cid long, words array<long>")
    codes, bits = near_dup.word_counts(sets.repartition(300), len(rows))
    once, _ = near_dup.word_counts(sets.coalesce(1), len(rows))
    assert (codes == once).all() and codes.max() > 1 and len(codes) == 1 << bits
    assert pairs(spark, rows, 0.7) == brute(rows, 0.7)


def test_sets_whose_hashes_clash(spark, monkeypatch):
    rows = [("a", "one two three four"), ("b", "four three two one"), ("c", "six seven"), ("d", "one two three four five")]
    plain = F.xxhash64
    monkeypatch.setattr(near_dup.F, "xxhash64", lambda *c: F.lit(5).cast("long") if isinstance(c[0], str) and c[0] == "words" else plain(*c))
    assert pairs(spark, rows, 0.7) == brute(rows, 0.7)


def test_nulls_blanks_repeats_and_long_texts(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [("a", None), ("b", ""), ("c", " .,"), (None, "one two"), ("d", "one two"), ("d", "one two"), ("e", "TWO, one!"), ("f", long), ("g", long + " more"), ("h", "Élan élan"), ("i", "élan")]
    assert pairs(spark, rows, 0.7) == {("d", "e"), ("f", "g"), ("h", "i")}
    assert pairs(spark, [], 0.7) == set()


def test_many_copies_make_a_star(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "COPIES_IN_FULL", 3)
    rows = [(f"c{i}", "same words here") for i in range(6)] + [("z", "same words here too")]
    got = pairs(spark, rows, 0.7)
    assert got == {("c0", f"c{i}") for i in range(1, 6)} | {("c0", "z")}


def test_different_texts_of_a_class_make_no_star(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "COPIES_IN_FULL", 3)
    rows = [(f"p{i}", " ".join(w)) for i, w in enumerate(itertools.permutations(["same", "words", "here"]))] + [(f"q{i}", "here words, same") for i in range(4)] + [("z", "same words here too")]
    ids = [f"p{i}" for i in range(6)] + ["q0", "z"]
    assert pairs(spark, rows, 0.7) == set(itertools.combinations(ids, 2)) | {("q0", f"q{i}") for i in range(1, 4)}


def test_groups(spark):
    rows = [("a", "p q r s"), ("b", "p q r s"), ("c", "p q r s t"), ("d", "p q r s t u"), ("e", "other")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: (r["group_id"], r["n_links"], r["n_copies"]) for r in duplicate_groups(near_duplicates(df, "id", F.col("text"), 0.8)).collect()}
    assert len({got[x][0] for x in "abcd"}) == 1 and got["e"][0] != got["a"][0]
    assert (got["a"][1:], got["c"][1:], got["e"][1:]) == ((1, 2), (2, 1), (0, 1))


def test_sliced_distances():
    r = np.random.default_rng(0)
    m, bits = 300, 256
    s = np.packbits(r.random((m, bits)) < 0.5, axis=1, bitorder="little")
    s[100:140] = s[7]
    s[120:140, 0] ^= 255
    radius = r.integers(0, 140, m)
    first, last = np.arange(m) + 1, np.minimum(m, np.arange(m) + r.integers(1, 200, m))
    i, j = sliced_matches(s, first, last, lambda q, e: radius[q])
    b = np.unpackbits(s, axis=1)
    exp = {(x, y) for x in range(m) for y in range(first[x], last[x]) if (b[x] != b[y]).sum() <= radius[x]}
    assert set(zip(i.tolist(), j.tolist())) == exp and len(i) == len(exp)
