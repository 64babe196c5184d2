"""Problem 4: values that were read in the wrong character encoding.

Every distinct clean word of the corpus is garbled in every way that encodings are mistaken for each other,
and the words of the damaged fields are joined with these forms. Clean characters are words of one letter
here: their garbled forms find and restore what is left, words the corpus holds nowhere else.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronika.session import durable

# Characters beyond ASCII that clean texts of the corpus languages are written with.
LETTERS = "čćđšžČĆĐŠŽäöüßÄÖÜàèéìòùÀÈÉÌÒÙçãõáâêíóôúÇÃÕÁÂÊÍÓÔÚ"
MARKS = "–—‘’‚“”„«»…"

#: Encodings that are mistaken for one another: (written in, read as). "x2" is the first pair done twice.
CHAINS: list[tuple[str, str]] = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "iso8859-2"), ("utf-8", "mac_roman"),
    ("utf-8", "mac_latin2"), ("utf-8", "cp852"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1250", "cp1252"),
    ("cp1250", "latin-1"), ("iso8859-2", "cp1252"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("cp852", "cp1250"), ("cp852", "cp1252"),
    ("cp1250", "cp852"), ("cp1252", "cp1250"), ("cp1252", "cp852"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"),
    ("cp1250", "cp437"), ("cp1250", "mac_roman"), ("mac_latin2", "cp1250"), ("mac_latin2", "cp1252"), ("cp1250", "cp1251"),
]
DOUBLE = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250")]
#: Forms from which the original can't be told without the corpus: what a letter is replaced by.
LOSSY = ["?", "�", "�+"]

_SEPARATORS = r"[\x00-\x20/\\_().,;:+\-&\"'!\[\]0-9]+"


@cache
def _table(encoding: str) -> dict[int, str]:
    """What each byte is read as. Bytes an encoding does not define stay as control characters, as lenient readers leave them."""
    return {b: bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)}


def _read(data: bytes, encoding: str) -> str:
    return data.decode("latin-1").translate(_table(encoding))


def garble(word: str) -> dict[str, str]:
    """All garbled forms of a word that differ from it: {form: name of the chain}; the first chain wins."""
    out: dict[str, str] = {}
    for name, a, b in [*((f"{a}>{b}", a, b) for a, b in CHAINS)]:
        try:
            form = _read(word.encode(a), b)
        except UnicodeEncodeError:
            continue
        out.setdefault(form, name)
        if (a, b) in DOUBLE:
            out.setdefault(_read(form.encode(a), b), f"{name} twice")
    for mark in LOSSY:
        per = (lambda c, m=mark: m[0] * (len(c.encode()) if m.endswith("+") else 1))
        out.setdefault("".join(c if c.isascii() else per(c) for c in word), f"lost to {mark[0]}")
    out.pop(word, None)
    return out


def _sequences() -> dict[str, str]:
    """Garbled forms of single characters that are longer than one character, so that none is a letter of its own."""
    out: dict[str, str] = {}
    for c in LETTERS + MARKS:
        for form, chain in garble(c).items():
            if len(form) > 1 and not chain.startswith("lost"):
                out.setdefault(form, c)
    return out


def corpus_words(texts: list[Column], frames: list[DataFrame]) -> DataFrame:
    """`(word, n)`: distinct words with a letter beyond ASCII, of any text. Counted where they lie, then merged."""
    pattern = r"[\p{L}\p{M}]*[\p{L}&&[^\x00-\x7F]][\p{L}\p{M}]*"
    parts = [
        f.select(F.explode(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), F.lit(0))).alias("word"))
        for t, f in zip(texts, frames)
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def clean(word: Column) -> Column:
    return word.rlike(f"^[A-Za-z{LETTERS}]+\\z")


def garbled_forms(words: DataFrame) -> DataFrame:
    """`(word, n, in_texts)` to `(form, word, chain, n, in_texts, variant)`; variants are the words in capitals
    and with a capital first letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for word, n, in_texts in zip(b["word"], b["n"], b["in_texts"]):
                for w in {word, word.upper(), word[:1].upper() + word[1:]}:
                    for form, chain in garble(w).items():
                        # a single letter may stand by itself; a mark is not read as one
                        if (len(w) > 1 or w in MARKS or not chain.startswith("lost")) and not (w in MARKS and form in LETTERS):
                            rows.append((form, w, chain, n, in_texts, w != word))
            yield pd.DataFrame(rows, columns=["form", "word", "chain", "n", "in_texts", "variant"])

    marks = words.sparkSession.createDataFrame([(m, 1, True) for m in MARKS], "word string, n bigint, in_texts boolean")
    schema = "form string, word string, chain string, n bigint, in_texts boolean, variant boolean"
    # few words make many forms: spread them evenly, whatever files or counts they come from
    spread = words.where(clean(F.col("word"))).unionByName(marks).repartition(words.sparkSession.sparkContext.defaultParallelism * 2, "word")
    return spread.mapInPandas(run, schema)


def _long(metadata: DataFrame, fields: list[str]) -> DataFrame:
    rows = metadata.where("book is not null").select("book", *fields).distinct()
    return rows.select("book", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select(
        "book", "x.field", "x.value"
    ).where("value is not null")


def _nfc(text: Column) -> Column:
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)

    return F.pandas_udf(compose, "string")(text)


def damaged_words(metadata: DataFrame, corpus: list[tuple[DataFrame, str]], fields: list[str]) -> DataFrame:
    """`(book, field, value, token, original, chain)` of every damaged word of the fields; original is null where
    the corpus does not tell it.

    A word that the corpus texts hold as it stands is taken for clean. Of several originals the one the
    corpus holds most often is taken, then the first in order. Values in decomposed Unicode are composed first.
    """
    values = _long(metadata, fields).withColumn("value", _nfc(F.col("value")))
    tokens = (
        values.where(F.col("value").rlike(r"[^\x00-\x7F]|\?"))
        .select("book", "field", "value", F.explode(F.array_distinct(F.split("value", _SEPARATORS))).alias("token"))
        .where(F.col("token").rlike(r"[^\x00-\x7F]|\?"))
    )
    texts = durable(corpus_words([F.col(c) for _, c in corpus], [f for f, _ in corpus]))
    own = corpus_words([F.col("value")], [values])
    words = (
        texts.withColumn("in_texts", F.lit(True)).unionByName(own.withColumn("in_texts", F.lit(False)))
        .groupBy("word").agg(F.sum("n").alias("n"), F.bool_or("in_texts").alias("in_texts"))
    )
    # capitals are spelt in texts as in titles
    known = texts.select(F.lower("word").alias("low")).distinct()
    suspects = tokens.select("token").distinct().withColumn("low", F.lower("token")).join(known, "low", "left_anti").drop("low")
    # how often each letter of LETTERS stands in the texts: as many rows as there are letters
    letter = texts.select(F.explode(F.split("word", "")).alias("c"), "n").where(F.col("c").isin(list(LETTERS)))
    often = {r["c"]: r["n"] for r in letter.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    rate = F.create_map(*[F.lit(x) for c in LETTERS for x in (c, often.get(c, 0))])
    rarest = lambda w: F.array_min(F.transform(
        F.filter(F.split(w, ""), lambda c: c.rlike(r"[^\x00-\x7F]")), lambda c: F.coalesce(F.try_element_at(rate, c), F.lit(0))
    ))
    # of two words that could each be the garbled form of the other, the one with the rarer letters is the form
    likely = F.col("in_texts") | F.coalesce(rarest(F.col("word")) > rarest(F.col("token")), F.lit(True))
    suspects = durable(suspects)
    best = durable(
        suspects.join(garbled_forms(words), F.col("token") == F.col("form")).where(likely)
        .groupBy("token").agg(F.min_by(F.struct("word", "chain"), F.struct((-F.col("n")).alias("n"), "variant", "chain", "word")).alias("hit"))
    )
    seq = _sequences()
    long_first = "|".join(re.escape(x) for x in sorted(seq, key=lambda x: (-len(x), x)))

    @F.pandas_udf("string")
    def restore(s: pd.Series) -> pd.Series:
        """The word with every garbled character put back, read twice if need be."""
        finder = re.compile(long_first)

        def one(t: str) -> str | None:
            for _ in range(2):
                new = finder.sub(lambda m: seq[m[0]], t)
                if new == t:
                    break
                t = new
            return t if all(c.isascii() or c in LETTERS or c in MARKS for c in t) and "?" not in t else None

        return s.map(one)

    # of one letter: a garbled sequence, a control character, the mark for a lost one, or a ? in front of or between letters
    char = (
        F.col("token").rlike(f"{long_first}|[\\x80-\\x9F\\uFFFD]")
        | F.col("token").rlike(r"\?\p{L}") | F.col("token").rlike(r"[†‡¦¬§¹¾æðÐÆ]")
    )
    rest = suspects.join(best, "token", "left_anti").where(char).select("token", F.lit(None).cast("struct<word:string,chain:string>").alias("hit"))
    hits = best.unionByName(rest).select("token", F.coalesce("hit.word", restore("token")).alias("original"), F.coalesce("hit.chain", F.lit("by character")).alias("chain"))
    lone = (F.col("token") != "?") | F.col("value").contains(" ? ")
    return tokens.where(lone).join(hits, "token").select("book", "field", "value", "token", "original", "chain")


FIELDS = ["book_title", "source_pdf"]


def found(metadata: DataFrame, corpus: list[tuple[DataFrame, str]], fields: list[str] = FIELDS) -> DataFrame:
    """`(book, field)` of each damaged value. Null values, books and empty tables give no row."""
    return damaged_words(metadata, corpus, fields).select("book", "field").distinct()


def restored(metadata: DataFrame, corpus: list[tuple[DataFrame, str]], fields: list[str] = FIELDS) -> DataFrame:
    """`(book, field, value, restored, whole)`: damaged values with the known originals put in; whole tells
    whether every damaged word could be had back."""
    d = damaged_words(metadata, corpus, fields)
    pairs = d.groupBy("book", "field", "value").agg(
        F.array_sort(F.collect_set(F.struct((-F.length("token")).alias("k"), "token", "original"))).alias("fix"),  # words of one value
        F.bool_and(F.col("original").isNotNull()).alias("whole"),
    )
    put = F.aggregate("fix", F.col("value"), lambda v, x: F.when(x["original"].isNull(), v).otherwise(F.replace(v, x["token"], x["original"])))
    return pairs.select("book", "field", "value", put.alias("restored"), "whole")
