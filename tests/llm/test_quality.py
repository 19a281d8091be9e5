from pyspark.sql import functions as F

from palimpsest.llm.quality import measure, text_quality, text_statistics

PROSE = "The cat sat on the mat and it was good for the dog too. It is the one that was there."


def test_measure():
    common = frozenset({"the", "and", "it"})
    assert measure("", common) is None and measure(" \n\t", common) is None
    n, mean, symbols, ends, share = measure("The cat, and 42 dogs.\nno end\n\n“Quoted!”", common)
    assert n == 7 and abs(mean - 24 / 7) < 1e-9 and ends == 2 / 3 and abs(share - 2 / 7) < 1e-9
    assert abs(symbols - 5 / 31) < 1e-9
    assert measure("12 34", common)[:2] == (0, None) and measure("a_b", common)[2] == 1 / 3
    assert measure("x" * 300_000 + ".", common)[1] == 300_000


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words string")
    words = spark.createDataFrame([("en", w) for w in "the and it is on was for that to a in of".split()] + [(None, "x")], "lang string, word string")
    return df, words


def test_verdict_and_tails(spark):
    rows = [(i, PROSE, "en", "") for i in range(200)] + [(300, "a\nb\nc\n- x | y | z", "en", ""), (301, None, "en", ""), (302, "  ", "en", ""), (303, "12 34 56", None, ""), (304, "-> |" * 500, "en", ""), (305, PROSE, None, ""), (306, PROSE * 3000, "en", "")]
    df, words = run(spark, rows)
    q = {r["doc_id"]: r for r in text_quality(df, "doc_id", "text", "lang", words).collect()}
    assert len(q) == len(rows)
    assert {k for k, r in q.items() if r["is_junk"]} == {300, 303, 304}
    assert q[301]["n_words"] is None and q[301]["tails"] == [] and q[302]["n_words_pct"] is None
    assert "n_words" in q[306]["tails"] and q[306]["n_words_pct"] == 1.0 and "symbol_ratio" in q[304]["tails"]
    assert 0 <= q[0]["n_words_pct"] <= 1 and q[0]["tails"] == []


def test_percentiles_match_exact_ones(spark):
    df, words = run(spark, [(i, "word " * (i + 1), "en", "") for i in range(500)])
    q = text_quality(df, "doc_id", "text", "lang", words).select("n_words", "n_words_pct", "n_words_z").collect()
    assert max(abs(r["n_words_pct"] - r["n_words"] / 500) for r in q) < 0.04
    mid = min(q, key=lambda r: abs(r["n_words"] - 250))
    assert abs(mid["n_words_z"]) < 0.1


def test_empty_and_repeated(spark):
    df, words = run(spark, [])
    assert text_quality(df, "doc_id", "text", "lang", words).count() == 0
    df, words = run(spark, [(1, PROSE, "en", ""), (1, PROSE, "en", "")])
    assert text_statistics(df, "doc_id", "text", "lang", words).filter(F.col("n_words") == 19).count() + 0 in (0, 2)
    assert text_quality(df, "doc_id", "text", "lang", words).count() == 2
