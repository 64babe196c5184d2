"""Pages that arrive over time: cleaned as they come, chunked when a book is asked for.

Cleaning is per page, a plain projection of the stream into a table that only grows: the file sink writes every page
exactly once, and nothing is read from a place that is written to. Chunks of a book follow its word stream, so they are
made by the batch operator, once for all the batches since: a book that got pages in a thousand batches is chunked once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kronika.config import ChunkSpec
from kronika.operators.chunking import chunk_books
from kronika.operators.cleaning import clean
from kronika.session import durable
from kronika.sources.files import PAGES, page_number

CHUNKS = "chunk_id int, source_pages array<int>, text string, word_count int, upto timestamp, book string"


def read_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(pages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Cleaned pages to the table, with the time of their batch as `seen`; runs until it has read what is there. A page
    without a number is an error."""
    cleaned = clean(pages.withColumn("page_number", page_number())).withColumn("seen", F.current_timestamp())
    return cleaned.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """Each page once, as it was seen last; of several of one batch the one with the greatest text."""
    t = spark.read.parquet(table)
    others = [c for c in t.columns if c not in ("book", "page_number")]
    newest = F.max_by(F.struct(*others), F.struct("seen", F.coalesce("text", F.lit(""))))
    return t.groupBy("book", "page_number").agg(newest.alias("x")).select("book", "page_number", "x.*")


def chunk_new(spark: SparkSession, table: str, chunks: str, spec: ChunkSpec = ChunkSpec()) -> int:
    """Chunks anew the books that got pages since they were chunked last, each into its own part of the table `chunks`;
    how many they were. A run that is lost in between leaves a book as it was or as it is now, and is made up for by the next."""
    seen = spark.read.parquet(table).groupBy("book").agg(F.max("seen").alias("upto"))
    p = spark._jvm.org.apache.hadoop.fs.Path(chunks)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        done = spark.read.schema(CHUNKS).parquet(chunks).groupBy("book").agg(F.max("upto").alias("done"))
        seen = seen.join(done, "book", "left").where("done is null or done < upto").drop("done")
    seen = durable(seen)
    if n := seen.count():
        made = chunk_books(latest(spark, table).join(seen, "book", "left_semi"), spec).join(seen, "book")
        made.repartition("book", F.floor(F.col("chunk_id") / 10_000)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(chunks)
    return n
