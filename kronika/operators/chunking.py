"""Overlapping word windows, over single texts and over the word stream of a whole book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronika.config import ChunkSpec
from kronika.functions import text as T

#: Pages whose word counts are summed in one task before the sums of such spans are.
SPAN = 1_000


def chunk_count(words: Column, spec: ChunkSpec) -> Column:
    """Chunks of a stream: all whole ones, and a rest where it is the only one or longer than the overlap."""
    whole = F.when(words >= spec.words, F.floor((words - spec.words) / spec.step) + 1).otherwise(0)
    rest = words - whole * spec.step
    return (whole + ((rest > 0) & ((whole == 0) | (rest > spec.overlap))).cast("int")).cast("int")


def chunk_texts(df: DataFrame, key: list[str], text: str = "text", spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """Each text on its own: `(*key, chunk_id, text, word_count)`, chunk_id from 1. Closed form, no shuffle.
    Null and blank texts give no chunk."""
    w = df.select(*key, T.words(F.col(text)).alias("w")).withColumn("k", chunk_count(F.size("w"), spec))
    at = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.slice("w", i * spec.step + 1, spec.words))
    return w.where("k > 0").select(*key, F.posexplode(at).alias("pos", "piece")).select(
        *key, (F.col("pos") + 1).alias("chunk_id"), F.array_join("piece", " ").alias("text"), F.size("piece").alias("word_count")
    )


def chunk_books(pages: DataFrame, spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """`(book, page_number, text)` to `(book, chunk_id, source_pages, text, word_count)` over the words of a book
    in the order of its pages.

    Every page finds the chunks its words lie in from its place in the stream, a running sum of word counts in
    two steps (within spans of pages, then over spans), so that a book of any size is spread over tasks; a chunk
    is put together from at most `spec.words` words. A page given twice counts once, with its greatest text;
    pages without words stand in no chunk.
    """
    p = pages.where("book is not null and page_number is not null").groupBy("book", "page_number").agg(F.max("text").alias("text"))
    p = p.select("book", "page_number", T.words(F.col("text")).alias("w")).withColumn("n", F.size("w").cast("bigint")).where("n > 0")
    p = p.withColumn("span", F.floor(F.col("page_number") / SPAN))
    spans = p.groupBy("book", "span").agg(F.sum("n").alias("t"))
    before = lambda *cols: Window.partitionBy(*cols[:-1]).orderBy(cols[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "book", "span", F.coalesce(F.sum("t").over(before("book", "span")), F.lit(0)).alias("base"),
        F.sum("t").over(Window.partitionBy("book")).alias("total"),
    )
    p = p.withColumn("inner", F.coalesce(F.sum("n").over(before("book", "span", "page_number")), F.lit(0)))
    p = p.join(spans, ["book", "span"]).withColumn("o", F.col("base") + F.col("inner"))
    chunks = chunk_count(F.col("total"), spec)
    # chunk i holds the words from i * step to i * step + words
    first = F.greatest(F.ceil((F.col("o") - spec.words + 1) / F.lit(spec.step)), F.lit(0)).cast("bigint")
    last = F.least(F.floor((F.col("o") + F.col("n") - 1) / F.lit(spec.step)), chunks.cast("bigint") - 1).cast("bigint")
    p = p.withColumns({"first": first, "last": last}).where("last >= first")
    p = p.select("book", "page_number", "w", "o", "n", F.explode(F.sequence("first", "last")).alias("i"))
    start = F.greatest(F.col("i") * spec.step - F.col("o"), F.lit(0))
    end = F.least(F.col("i") * spec.step + spec.words - F.col("o"), F.col("n"))
    p = p.where(end > start).select("book", "i", "page_number", F.slice("w", (start + 1).cast("int"), (end - start).cast("int")).alias("part"))
    c = p.groupBy("book", "i").agg(F.array_sort(F.collect_list(F.struct("page_number", "part"))).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda x: x["part"]))
    return c.select(
        "book", (F.col("i") + 1).cast("int").alias("chunk_id"), F.array_distinct(F.transform("parts", lambda x: x["page_number"])).alias("source_pages"),
        F.array_join(joined, " ").alias("text"), F.size(joined).alias("word_count"),
    )
