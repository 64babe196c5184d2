"""Readers and writers at the edge of the engine. Inside, tables are Parquet; JSON is an exchange format."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kronika.functions import text as T
from kronika.models import LinePdfParser, PdfParser

PAGES = "book string, page_number int, page int, text string, word_count int"
CHUNKS = "book string, chunk_id int, source_pages array<int>, text string, word_count int"
EVENT = (
    "struct<date:string,place:string,coordinates:struct<lat:string,lng:string>,operation:string,division:string,notes:string,"
    "source_chunk_ids:array<int>,source_pages:array<int>>"
)
BATCH = f"book string, batch_id int, chunk_ids array<int>, source_pages array<int>, provider string, model string, movements array<{EVENT}>, notes array<string>, raw_response string, repair_attempts int"
DOCUMENT = (
    "book string, brigade_id bigint, brigade_name string, movements array<struct<date:string,place:string,coordinates:struct<lat:double,lng:double>,"
    "operation:string,division:string,notes:string>>, notes string, source string"
)
METADATA = "book string, book_title string, source_pdf string, page_count int, output_jsonl string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, anything else that is no object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_documents(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One document a file, with `file_name`, by which the documents are in order."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(pattern)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"))


def page_number() -> Column:
    """`page_number`, else `page`, else an error."""
    return F.coalesce("page_number", "page", F.raise_error(F.lit("a page has neither page_number nor page")).cast("int"))


def page_map(pages: DataFrame, order: str) -> DataFrame:
    """`(book, page_number, text)`: the last record of each page in the given order."""
    return pages.groupBy("book", "page_number").agg(F.max_by("text", order).alias("text"))


def book_title(title: Column, book: Column) -> Column:
    """The title as it is written, or the book's name where it is missing or blank."""
    return F.when(T.strip(F.coalesce(title, F.lit(""))) != "", title).otherwise(book)


def events_of(batches: DataFrame) -> DataFrame:
    """Events of batch documents `(book, batch_id, movements)` as rows with `ord`, their place over all batches."""
    e = batches.select("book", "batch_id", F.posexplode("movements").alias("pos", "e"))
    return e.select("book", (F.col("batch_id").cast("bigint") * 1_000_000 + F.col("pos")).alias("ord"), "e.*")


def notes_of(batches: DataFrame) -> DataFrame:
    n = batches.select("book", "batch_id", F.posexplode("notes").alias("pos", "note"))
    return n.select("book", (F.col("batch_id").cast("bigint") * 1_000_000 + F.col("pos")).alias("ord"), "note")


def catalog(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """`(slug, title, chunk_count, source_pdf)` of every book with chunks. A chunk loaded twice counts once; of several
    metadata rows of a book the greatest title and path are taken."""
    m = metadata.where("book is not null").groupBy("book").agg(F.max("book_title").alias("t"), F.max("source_pdf").alias("source_pdf"))
    c = chunks.groupBy("book").agg(F.count_distinct("chunk_id").alias("chunk_count"))
    return c.join(m, "book", "left").select(
        F.col("book").alias("slug"), book_title(F.col("t"), F.col("book")).alias("title"), "chunk_count", "source_pdf"
    )


def read_pdfs(spark: SparkSession, pattern: str, parser: PdfParser | None = None) -> DataFrame:
    """`(book, source_pdf, page_number, text, word_count)`: files are spread over tasks, each parsed where it is read."""
    parser = parser or LinePdfParser()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (path, i, text or "") for path, content in zip(f["path"], f["content"]) for i, text in enumerate(parser.pages(content), 1)
            ]
            yield pd.DataFrame(rows, columns=["source_pdf", "page_number", "text"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    pages = files.mapInPandas(run, "source_pdf string, page_number int, text string")
    name = F.regexp_replace(F.element_at(F.split("source_pdf", "/"), -1), r"\.[^.]*\z", "")
    return pages.select(T.slug_filename(name).alias("book"), "source_pdf", "page_number", "text", T.count_words(F.col("text")).alias("word_count"))


# ---------------------------------------------------------------- sinks


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def pretty(df: DataFrame) -> DataFrame:
    """Each row as one indented JSON document."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def batch_file(batch_id: Column, kind: str = "batch") -> Column:
    return F.format_string(f"campaign_{kind}_%04d.json", batch_id)


def raw_file(batch_id: Column) -> Column:
    return F.format_string("campaign_batch_%04d.raw.txt", batch_id)


def append_new(df: DataFrame, path: str, keys: list[str], overwrite: bool = False) -> int:
    """Rows whose keys the table at `path` does not have yet are added to it; how many they were. Keys that are given
    twice are added once. `overwrite` replaces the table."""
    spark = df.sparkSession
    df = df.dropDuplicates(keys)
    exists = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = exists.getFileSystem(spark._jsc.hadoopConfiguration())
    if overwrite or not fs.exists(exists):
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path).count()
    before = spark.read.parquet(path)
    n = before.count()
    df.join(before.select(*keys), keys, "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - n


# ---------------------------------------------------------------- settings (driver)


def load_env(*folders: str, name: str = ".env") -> dict[str, str]:
    """`KEY=value` lines of the first file found; what is already set is not overridden."""
    for folder in folders:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            out = {}
            with open(path, encoding="utf-8") as f:
                for line in f:
                    key, eq, value = line.strip().partition("=")
                    if eq and not key.startswith("#"):
                        out[key.strip()] = value.strip().strip("\"'")
                        os.environ.setdefault(key.strip(), out[key.strip()])
            return out
    return {}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Campaign documents as `pretty` writes them, one or several a file: each ends with a brace at the start of a line."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)(?<=^\})\r?\n")).alias("v")).where(F.trim("v") != "")
    return text.select(F.from_json("v", DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def load_documents(spark: SparkSession, path: str | None) -> dict:
    """The first of the documents written to a folder before, without its events; empty where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return {}
    row = read_documents(spark, path).drop("movements").orderBy("book").first()
    return row.asDict() if row else {}


def load_template(*paths: str | None) -> dict:
    """The first file there is, else an empty document."""
    for path in paths:
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return json.load(f)
    return {"brigade_id": None, "brigade_name": "", "movements": [], "notes": "", "source": ""}
