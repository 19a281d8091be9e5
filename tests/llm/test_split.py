import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.split import pieces, split_long


def check(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e, _ in got)
    assert "".join(text[s:e] if i == 0 else text[s + overlap : e] for i, (s, e, _) in enumerate(got)) == text
    assert all(b[0] == a[1] - overlap for a, b in zip(got, got[1:]))
    return got


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é.!?\n\r\t#-́‍", max_size=400), st.sampled_from([(20, 0), (20, 5), (50, 20), (7, 3)]))
def test_round_trip(text, sizes):
    check(text, *sizes)


def test_prefers_high_boundaries():
    text = "# one\n" + "a b. " * 8 + "\n# two\n" + "c d. " * 8
    cuts = [text[e - 1 : e + 5] for _, e, _ in check(text, 60, 0)[:-1]]
    assert cuts == ["\n# two"]
    para = "x y. " * 9 + "\n\n" + "z w. " * 9
    assert check(para, 60, 0)[0][1] == para.index("z")
    assert check("word " * 30, 23, 4)[0][1] % 5 == 0
    assert check("a" * 100, 30, 10)[0][:2] == (0, 20)
    assert check("a\r\n" * 40, 20, 0)[0][1] % 3 == 0


def test_operator(spark):
    rows = [("a", "x" * 6000, 1), ("b", "y" * 6001, 1), ("c", None, 1), ("d", "", 1), ("e", "Wort. " * 60_000, 1), ("b", "y" * 6001, 1), (None, "é" * 7000, 1)]
    df = spark.createDataFrame(rows, "uri string, l2 string, piece int")
    got = split_long(df, "uri", "l2").collect()
    assert {r["uri"] for r in got} == {"b", "e", None}
    e = sorted((r["piece"], r["text"]) for r in got if r["uri"] == "e")
    assert "".join(t if k == 0 else t[200:] for k, t in e) == "Wort. " * 60_000
    assert sum(r["uri"] == "b" for r in got) == 4
    assert split_long(df.limit(0), "uri", "l2").count() == 0
    with pytest.raises(ValueError):
        split_long(df, "uri", "l2", 100, 50)
