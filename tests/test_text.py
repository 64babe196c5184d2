import unicodedata

import pytest
from pyspark.sql import functions as F

from kronika.functions import jsonx
from kronika.functions import text as T
from kronika.functions.similarity import alike, plain_normalize, ratio, text_similarity


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text", ["Đuro Žužul", "ﬁne ½ … Ĳ", "é ̖x", "", "Straße ÀÇÃO", "ǅ ʼn ﬀ ㎏", "ščćžđ ŠČĆŽĐ"])
def test_normalize_is_decomposition_without_marks(spark, text):
    assert one(spark, T.normalize, text) == plain_normalize(text)


def test_normalize_latin_blocks(spark):
    chars = [chr(c) for c in range(0x20, 0x2100) if not unicodedata.category(chr(c)).startswith("C") and chr(c) not in "İΣ"]
    df = spark.createDataFrame([(c,) for c in chars], "x string").select("x", T.normalize(F.col("x")).alias("y"))
    assert [(r.x, r.y) for r in df.collect() if r.y != plain_normalize(r.x)] == []


def test_null_stays_null(spark):
    assert one(spark, T.normalize, None) is None
    assert one(spark, T.tokens, None) == []
    assert one(spark, T.count_words, None) == 0


@pytest.mark.parametrize("text", ["a  b\tc\n", "\x1c a   b", " ", "x" * 5000])
def test_words_are_python_words(spark, text):
    assert one(spark, T.words, text) == text.split()
    assert one(spark, T.compact, text) == " ".join(text.split())


@pytest.mark.parametrize("title, slug", [("Đuro Žužul_1", "uro-zuzul-1"), ("Š", "s-rag"), ("---", "book"), ("Rat & mir", "rat-mir")])
def test_slug(spark, title, slug):
    assert one(spark, T.slug_name, title) == slug


@pytest.mark.parametrize("pages, label", [
    ([1, 2, 3, 7, 9, 10], "pp. 1-3, 7, 9-10"), ([12], "p. 12"), ([12, 13], "pp. 12-13"), ([], "page unknown"), (None, "page unknown"), ([3, 2], "pp. 3, 2"),
])
def test_citation(spark, pages, label):
    assert one(spark, T.page_citation, pages, "array<int>") == label


@pytest.mark.parametrize("a, b, days", [("1944-01-31", "1944-02-01", 1), ("1944-02-29", "1944-03-01", 3), ("1943-12-31", "1944-01-01", 1), ("1944", "1944-01-01", None)])
def test_date_distance(spark, a, b, days):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.date_distance(F.col("a"), F.col("b")).alias("d")).first()["d"] == days


@pytest.mark.parametrize("raw, out", [
    ('x ```json {"a":1,} ``` y', '{"a":1}'), ("no json", None), (None, None), ('say {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("} {", None),
])
def test_json_object(spark, raw, out):
    assert one(spark, jsonx.json_object_text, raw) == out


def test_similarity(spark):
    pairs = [("", ""), ("", "x"), ("Assault on Selca", "Raid on Nerežišća"), (None, "a"), ("abc" * 100, "abd" * 90)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", text_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == ratio(r.a, r.b)
        assert all(alike(r.a, r.b, x) == (r.s >= x) for x in (0.0, 0.3, 0.55, 0.75, 0.9, 1.0))
    assert ratio("", "") == 1.0 and ratio("", "x") == 0.0


def test_notes(spark):
    df = spark.createDataFrame([("a b", "a  b"), ("", "x"), ("x" * 500, "y" * 500)], "a string, b string")
    got = [r[0] for r in df.select(T.combine_notes(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == ["a b", "x"] and len(got[2]) == 700 and got[2].endswith("...")
    assert one(spark, T.trim_note, "Kept. The date is estimated. Also kept!") == "Kept. Also kept!"
    assert one(spark, T.trim_note, "All estimated.") == "All estimated."
    assert one(spark, T.duration, 3725.9, "double") == "1:02:05" and one(spark, T.duration, -3.0, "double") == "00:00"
