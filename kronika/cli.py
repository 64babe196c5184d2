"""Command line: `python -m kronika.cli <command>`. Tables are Parquet folders; pages and chunks are read from JSON lines too."""

from __future__ import annotations

import argparse
import os

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronika.config import ChunkSpec, profile
from kronika.models import PROVIDERS, LinePdfParser, PdfPlumberParser
from kronika.operators import cleaning, chunking, validation
from kronika.plans import campaign, engine
from kronika.plans.server import server
from kronika.session import build, ship
from kronika.sources import files as S


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not os.path.exists(path) and "*" not in path and ":" not in path:
        raise FileNotFoundError(path)
    return S.read_jsonl(spark, path, schema) if path.endswith((".jsonl", ".json")) else spark.read.parquet(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kronika")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), [c.add_argument(*a, **k) for a, k in args]][0]
    io = [(("input",), {}), (("--output",), {"required": True})]
    add("extract", *io, (("--parser",), {"choices": ["pdf", "text"], "default": "pdf"}))
    add("clean", *io, (("--report",), {}))
    add("chunk", *io, (("--chunk-words",), {"type": int, "default": 800}), (("--overlap-words",), {"type": int, "default": 120}))
    add("validate", io[0], (("--min-words",), {"type": int, "default": 200}), (("--expected-overlap",), {"type": int, "default": 120}))
    add("index", *io, (("--batch-size",), {"type": int, "default": 32}), (("--reset",), {"action": "store_true"}))
    ask = [(("index",), {}), (("book",), {}), (("question",), {"nargs": "?"}), (("--top-k",), {"type": int}), (("--candidate-k",), {"type": int}),
           (("--skip-rerank",), {"action": "store_true"}), (("--fast",), {"action": "store_true"}), (("--deep",), {"action": "store_true"}),
           (("--provider",), {}), (("--model",), {"default": ""}), (("--show-sources",), {"action": "store_true"})]
    add("ask", *ask)
    add("serve", (("index",), {}), (("--metadata",), {}), (("--host",), {"default": "127.0.0.1"}), (("--port",), {"type": int, "default": 8000}))
    mode = (("mode",), {"choices": ["run", "consolidate", "all"]})
    model = [(("--provider",), {"default": "openai"}), (("--model",), {"default": ""}), (("--name",), {"default": ""}), (("--parallel",), {"type": int, "default": 4})]
    asked = [*model, (("--work-dir",), {"required": True}), (("--overwrite",), {"action": "store_true"}), (("--output",), {}), (("--template",), {}), (("--source",), {"default": ""})]
    number = lambda *names: [((n,), {"type": int}) for n in names]
    add("build", mode, (("--chunks",), {}), (("--metadata",), {}), *asked, *number("--start-batch", "--end-batch"),
        (("--batch-size",), {"type": int, "default": 8}), (("--max-retries",), {"type": int, "default": 2}))
    add("verify", mode, (("--build-dir",), {}), *asked, *number("--start-group", "--end-group"), (("--max-group-size",), {"type": int, "default": 6}))
    add("polish", io[0], *io[1:], *model, (("--work-dir",), {"required": True}), (("--batch-size",), {"type": int, "default": 20}))
    return p


def build_events(spark: SparkSession, a: argparse.Namespace, client) -> None:
    if a.mode != "consolidate":
        titles = read(spark, a.metadata, S.METADATA).select("book", S.book_title(F.col("book_title"), F.col("book")).alias("title")) if a.metadata else None
        campaign.extract(
            read(spark, a.chunks, S.CHUNKS), a.work_dir, client, a.provider, a.model, a.batch_size, a.start_batch, a.end_batch, a.overwrite,
            a.max_retries, a.parallel, titles, a.name,
        )
    if a.mode != "run":
        consolidate(campaign.extracted(spark, a.work_dir), a)


def verify_events(spark: SparkSession, a: argparse.Namespace, client) -> None:
    if a.mode != "consolidate":
        events = S.events_of(campaign.payloads(campaign.extracted(spark, a.build_dir)))
        campaign.verify(events, a.work_dir, client, a.provider, a.model, a.max_group_size, a.start_group, a.end_group, a.overwrite, a.parallel, a.name)
    if a.mode != "run":
        consolidate(campaign.verified(spark, a.work_dir), a, True)


def consolidate(answers: DataFrame, a: argparse.Namespace, filtered: bool = False) -> None:
    """The document; what neither the template nor the command line says is taken from the one that lies at the output."""
    before = S.load_documents(answers.sparkSession, a.output)
    doc = campaign.consolidate(answers, S.load_template(a.template), a.source, filtered, before)
    S.pretty(doc).write.mode("overwrite").text(a.output)


def polish_events(spark: SparkSession, a: argparse.Namespace, client) -> None:
    docs = S.read_documents(spark, a.input)
    e = docs.select("book", F.posexplode("movements").alias("ord", "e")).select("book", F.col("ord").cast("bigint").alias("ord"), "e.*")
    p = campaign.polish(e, a.work_dir, client, a.batch_size, a.parallel, a.name, a.provider, a.model)
    fields = [c for c in p.columns if c not in ("book", "ord")]
    per = p.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("e")))).alias("x"))
    done = docs.drop("movements").join(per, "book", "left").withColumn("movements", F.transform("x", lambda x: x["e"])).select(*docs.columns)
    S.pretty(done).write.mode("overwrite").text(a.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = ship(spark or build())
    if a.command == "extract":
        S.read_pdfs(spark, a.input, PdfPlumberParser() if a.parser == "pdf" else LinePdfParser()).write.mode("overwrite").parquet(a.output)
    elif a.command == "clean":
        cleaned = cleaning.clean(read(spark, a.input, S.PAGES))
        cleaned.write.mode("overwrite").parquet(a.output)
        if a.report:
            S.write_jsonl(cleaning.cleaning_report(spark.read.parquet(a.output)), a.report)
    elif a.command == "chunk":
        spec = ChunkSpec(a.chunk_words, a.overlap_words)
        chunking.chunk_books(read(spark, a.input, S.PAGES), spec).write.mode("overwrite").parquet(a.output)
    elif a.command == "validate":
        c = read(spark, a.input, S.CHUNKS)
        validation.summary(c, a.min_words).show(50, False)
        validation.gaps(c).show(50, False)
        validation.overlap_breaks(c, a.expected_overlap).show(50, False)
    elif a.command == "index":
        print(*engine.build_index(read(spark, a.input, S.CHUNKS), a.output, batch=a.batch_size, reset=a.reset))
    elif a.command == "ask":
        p = profile(a.fast, a.deep)
        e = engine.Engine(spark.read.parquet(a.index), a.book)
        options = {"top_k": a.top_k or p.top_k, "candidate_k": a.candidate_k or p.candidate_k, "skip_rerank": a.skip_rerank or p.skip_rerank}
        llm = PROVIDERS[a.provider](a.model) if a.provider else None

        def reply(question: str) -> str:
            if llm is None:
                return e.retrieve(question, **options).context
            text, found = e.answer(question, llm, **options)
            return "\n\n".join([text, *(found.summaries if a.show_sources else [])])

        if a.question:
            print(reply(a.question))
            return
        e.preload()
        while True:
            try:
                question = input("> ").strip()
            except (EOFError, KeyboardInterrupt):
                return
            if question:
                print(reply(question))
    elif a.command == "serve":
        index = spark.read.parquet(a.index)
        metadata = read(spark, a.metadata, S.METADATA) if a.metadata else spark.createDataFrame([], S.METADATA)
        server(engine.Service(index, S.catalog(index, metadata)), a.host, a.port).serve_forever()
    else:
        made = PROVIDERS[a.provider]
        client = partial(made, a.model)
        {"build": build_events, "verify": verify_events, "polish": polish_events}[a.command](spark, a, client)


if __name__ == "__main__":
    main()
