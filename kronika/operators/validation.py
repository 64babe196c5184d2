"""Checks of a table of chunks, per book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronika.functions import text as T
from kronika.operators.order import chunk_once, preceded

MIN_WORDS, OVERLAP = 200, 120


def _once(chunks: DataFrame) -> DataFrame:
    """A chunk loaded twice is one chunk."""
    return chunk_once(chunks).select("book", "chunk_id", "text", "word_count")


def summary(chunks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per book: sizes as stored, and how many chunks are short, empty or wrongly counted. A null stored
    count is none of the sizes, and wrong."""
    n = T.count_words(F.col("text"))
    return _once(chunks).withColumn("n", n).groupBy("book").agg(
        F.count(F.lit(1)).alias("chunks"), F.coalesce(F.min("word_count"), F.lit(0)).alias("min_words"),
        F.coalesce(F.max("word_count"), F.lit(0)).alias("max_words"), F.coalesce(F.avg("word_count"), F.lit(0.0)).alias("avg_words"),
        F.count_if(F.col("word_count") < min_words).alias("short_chunks"), F.count_if(F.col("n") == 0).alias("empty_chunks"),
        F.count_if(F.coalesce(F.col("word_count") != F.col("n"), F.lit(True))).alias("count_mismatches"),
    )


def gaps(chunks: DataFrame) -> DataFrame:
    """`(book, expected, actual)` where an id does not follow the one before; the count goes on from the actual id."""
    ids = preceded(chunks.where("chunk_id is not null").select("book", "chunk_id").distinct(), ["book"], "chunk_id", ["chunk_id"], "before")
    return ids.withColumn("expected", F.coalesce("before.chunk_id", F.lit(0)) + 1).where("expected <> chunk_id").select(
        "book", "expected", F.col("chunk_id").alias("actual")
    )


def overlap_breaks(chunks: DataFrame, expected: int = OVERLAP) -> DataFrame:
    """`(book, previous_id, chunk_id, compared, shorter)` where the last words of a chunk are not the first ones of
    the next. Only the words that are compared go through the window."""
    c = _once(chunks).where("chunk_id is not null").select("book", "chunk_id", T.words(F.col("text")).alias("w"))
    c = c.select("book", "chunk_id", F.size("w").alias("n"), F.slice("w", 1, expected).alias("head"), F.slice("w", F.greatest(F.size("w") - expected + 1, F.lit(1)), expected).alias("tail"))
    c = preceded(c, ["book"], "chunk_id", ["chunk_id", "n", "tail"], "before")
    c = c.withColumns({"pid": F.col("before.chunk_id"), "pn": F.col("before.n"), "ptail": F.col("before.tail")})
    m = F.least(F.lit(expected), "n", "pn")
    c = c.where("pid is not null").withColumn("compared", m).where("compared > 0")
    last = F.slice("ptail", F.size("ptail") - F.col("compared") + 1, F.col("compared"))
    return c.where(last != F.slice("head", F.lit(1), F.col("compared"))).select(
        "book", F.col("pid").alias("previous_id"), "chunk_id", "compared", F.least("n", "pn").alias("shorter")
    )
