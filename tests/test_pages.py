import random

import pytest
from pyspark.sql import functions as F

from kronika.config import ChunkSpec
from kronika.operators import chunking, cleaning, validation


def loop(words, c, o):
    """The chunker as a loop over a buffer."""
    out, buffer = [], []
    for w in words:
        buffer.append(w)
        if len(buffer) == c:
            out.append(buffer)
            buffer = buffer[c - o :]
    if buffer and (not out or len(buffer) > o):
        out.append(buffer)
    return out


def test_clean_page(spark):
    page = "12\nPRVA GLAVA\nBataljon je krenuo prema obali i zau-\nzeo polozaj na brdu.\nZatim je nastavio prema selu\n3) Vidi arhiv\nnastavak biljeske"
    inline = "Bataljon je krenuo prema selu i zauzeo polozaj na brdu. 12) Vidi arhiv\ndrugi red"
    df = spark.createDataFrame([("b", 1, page), ("b", 2, inline), ("b", 3, ""), ("b", 4, None), ("b", 5, "A-\nB\r\n\r\nc")], "book string, page_number int, text string")
    r = {x.page_number: x for x in cleaning.clean(df).collect()}
    assert r[1].text == "PRVA GLAVA\n\nBataljon je krenuo prema obali i zauzeo polozaj na brdu. Zatim je nastavio prema selu"
    assert (r[1].word_count, r[1].footnotes, r[1].footnote_lines, r[1].dehyphenations, r[1].merges) == (17, "3) Vidi arhiv\nnastavak biljeske", 2, 1, 2)
    assert r[2].footnotes == "12) Vidi arhiv\ndrugi red" and r[2].text.endswith("brdu.")
    assert (r[3].text, r[3].footnotes, r[4].text, r[4].word_count) == ("", None, "", 0)
    report = cleaning.cleaning_report(cleaning.clean(df)).first()
    assert (report.pages_processed, report.pages_with_footnotes_removed, report.total_dehyphenations) == (5, 2, 1)


@pytest.mark.parametrize("line, yes", [("PRVA GLAVA", True), ("12.", True), ("Prva Glava", False), ("ŠTAB – VIS", False), ("A-B (1943)", True)])
def test_heading(spark, line, yes):
    assert spark.createDataFrame([(line,)], "x string").select(cleaning.is_heading_text(F.col("x"))).first()[0] is yes


@pytest.mark.parametrize("c, o", [(4, 1), (7, 3), (10, 0)])
def test_book_chunks_are_those_of_the_loop(spark, c, o):
    rng = random.Random(c)
    books = {b: [(p, " ".join(f"{b}{p}w{i}" for i in range(rng.choice([0, 1, 2, 9, 30])))) for p in rng.sample(range(1, 3000), 12)] for b in "xyz"}
    rows = [(b, p, t) for b, ps in books.items() for p, t in ps]
    df = spark.createDataFrame(rows + rows[:5], "book string, page_number int, text string")
    got = {(r.book, r.chunk_id): (r.text, r.source_pages) for r in chunking.chunk_books(df, ChunkSpec(c, o)).collect()}
    want = {}
    for b, ps in books.items():
        stream = [(w, p) for p, t in sorted(ps) for w in t.split()]
        for i, part in enumerate(loop(stream, c, o), 1):
            want[b, i] = (" ".join(w for w, _ in part), list(dict.fromkeys(p for _, p in part)))
    assert got == want
    texts = chunking.chunk_texts(df.where("text <> ''"), ["book", "page_number"], spec=ChunkSpec(c, o))
    assert texts.where("word_count > %d" % c).count() == 0


def test_chunk_parameters_and_empty_tables(spark):
    for bad in ((0, 0), (4, -1), (4, 4)):
        with pytest.raises(ValueError):
            ChunkSpec(*bad)
    empty = spark.createDataFrame([], "book string, page_number int, text string")
    assert chunking.chunk_books(empty).count() == 0 and cleaning.clean(empty).count() == 0


def test_validation(spark):
    rows = [("b", 1, "a b c", 3), ("b", 2, "b c d", 9), ("b", 4, "", 0), ("b", 5, "x y", None), ("b", 5, "x y", None)]
    df = spark.createDataFrame(rows, "book string, chunk_id int, text string, word_count int")
    s = validation.summary(df, 4).first()
    assert (s.chunks, s.min_words, s.max_words, s.short_chunks, s.empty_chunks, s.count_mismatches) == (4, 0, 9, 2, 1, 2)
    assert [(r.expected, r.actual) for r in validation.gaps(df).collect()] == [(3, 4)]
    assert validation.overlap_breaks(df, 2).collect() == []
    assert [tuple(r) for r in validation.overlap_breaks(df, 1).collect()] == [("b", 1, 2, 1, 3)]
