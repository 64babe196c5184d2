"""Extraction, verification and polishing of events by a language model, resumable and per book.

Every answer is kept as it came, in waves: the answers of a wave are written before the next is asked for and before any
of them is read. What can be read of them is worked out from that table. An answer that can't be read is sent back for
repair; one that stays unreadable counts as not given, is asked for again by the next run, and raises an error at the end
of this one. Model calls run in tasks, one client per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kronika.functions import text as T
from kronika.functions.jsonx import json_object_text
from kronika.models import LLMClient
from kronika.operators import events as E
from kronika.operators.order import numbered
from kronika.plans import prompts as P
from kronika.session import durable
from kronika.sources import files as S

EXTRACT_TOKENS, REPAIR_TOKENS, VERIFY_TOKENS, POLISH_TOKENS = 3200, 3600, 2800, 3200
#: Answers that are asked for before they are written: what a lost job can cost.
WAVE = 64
ANSWER = f"movements array<{S.EVENT}>, notes array<string>"
RAW = "key string, run int, attempt int, provider string, model string, raw_response string"
FIELDS = ["date", "place", "coordinates", "operation", "division", "notes", "source_chunk_ids", "source_pages"]

Client = Callable[[], LLMClient]


class UnreadableAnswers(RuntimeError):
    def __init__(self, number: int) -> None:
        super().__init__(f"{number} answers hold no JSON object that can be read; they are kept, and asked for again by the next run")
        self.number = number


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _raw(spark: SparkSession, out: str) -> DataFrame:
    """The answers as they came. Written in appends of whole waves, so that it only grows."""
    return spark.read.schema(RAW).parquet(f"{out}/raw") if _exists(spark, f"{out}/raw") else spark.createDataFrame([], RAW)


def _read(raw: DataFrame) -> DataFrame:
    """One row for each key: `(key, provider, model, raw_response, payload, repair_attempts, run, error)`; payload is the first answer
    that can be read, raw_response the first of its run (of the last run where none can), error what is wrong with the last."""
    a = raw.withColumn("ok", json_object_text(F.col("raw_response")))
    every = F.array_sort(F.collect_list(F.struct("run", "attempt", "raw_response", "ok", "provider", "model")))  # runs x repairs
    a = a.groupBy("key").agg(every.alias("a")).withColumn("good", F.try_element_at(F.filter("a", lambda x: x["ok"].isNotNull()), F.lit(1)))
    last = F.element_at("a", -1)
    a = a.withColumn("of", F.coalesce(F.col("good.run"), last["run"]))
    first = F.element_at(F.filter("a", lambda x: x["run"] == F.col("of")), 1)
    return a.select(
        "key", first["provider"].alias("provider"), first["model"].alias("model"), first["raw_response"].alias("raw_response"), F.col("good.ok").alias("payload"),
        F.coalesce(F.col("good.attempt"), last["attempt"]).alias("repair_attempts"), last["run"].alias("run"),
        F.when(F.col("good").isNull(), F.lit("no JSON object in the answer")).alias("error"),
    )


def _ask(prompts: DataFrame, out: str, client: Client, system: str, tokens: int, attempt: int, provider: str, model: str, parallel: int, wave: int) -> None:
    """`(key, run, prompt)` asked for wave by wave, each added to the raw table."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        llm = None
        for f in frames:
            llm = llm or client()
            yield f.assign(raw_response=[llm.generate(system, p, tokens) for p in f["prompt"]])[["key", "run", "raw_response"]]

    waves = -(-prompts.count() // wave)
    for n in range(waves):
        part = prompts.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == n).orderBy("key").coalesce(1) if parallel == 1 else (
            prompts.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == n).repartition(parallel, "key")
        )
        got = part.mapInPandas(call, "key string, run int, raw_response string")
        rows = got.select("key", "run", F.lit(attempt).alias("attempt"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), "raw_response")
        rows.write.mode("append").parquet(f"{out}/raw")


def _settle(asked: DataFrame, out: str, client: Client, system: str, tokens: int, repairs: int, provider: str, model: str, parallel: int, wave: int) -> None:
    """`(key, prompt)`: asks for what has no readable answer yet, then for repairs of what came back unreadable."""
    spark = asked.sparkSession
    have = _read(_raw(spark, out)).select("key", "run", "payload")
    todo = asked.join(have, "key", "left").where("payload is null").select("key", (F.coalesce("run", F.lit(0)) + 1).alias("run"), "prompt")
    todo = durable(todo)
    if todo.isEmpty():
        return
    _ask(todo, out, client, system, tokens, 0, provider, model, parallel, wave)
    mine = todo.select("key", "run")
    for attempt in range(1, repairs + 1):
        last = _raw(spark, out).where(F.col("attempt") == attempt - 1).join(mine, ["key", "run"])
        bad = durable(last.where(json_object_text(F.col("raw_response")).isNull()).groupBy("key", "run").agg(F.max("raw_response").alias("t")))
        if bad.isEmpty():
            break
        _ask(bad.select("key", "run", _filled(P.REPAIR_USER, text=F.col("t")).alias("prompt")), out, client, P.REPAIR_SYSTEM, REPAIR_TOKENS, attempt, provider, model, parallel, wave)


def _filled(template: str, **values: Column | str) -> Column:
    """A template of str.format with columns put in."""
    parts, marks = [], {f"\0{k}\0": v for k, v in values.items()}
    text = template.format(**{k: f"\0{k}\0" for k in values})
    while text:
        at = min(((text.find(m), m) for m in marks if m in text), default=(len(text), ""))
        if at[0]:
            parts.append(F.lit(text[: at[0]]))
        if at[1]:
            v = marks[at[1]]
            parts.append(F.coalesce(v, F.lit("")) if isinstance(v, Column) else F.lit(v))
        text = text[at[0] + len(at[1]) :]
    return F.concat(*parts)


def _complete(answers: DataFrame, strict: bool) -> DataFrame:
    if strict and (n := answers.where("payload is null").count()):
        raise UnreadableAnswers(n)
    return answers


def extracted(spark: SparkSession, out: str) -> DataFrame:
    """`(book, batch_id, batch_size, chunk_ids, source_pages, provider, model, raw_response, payload, repair_attempts, error)` of every batch asked for."""
    return spark.read.parquet(f"{out}/asked").join(_read(_raw(spark, out)), "key", "left").drop("key", "run")


def extract(
    chunks: DataFrame, out: str, client: Client, provider: str = "", model: str = "", size: int = 8, first: int | None = None, last: int | None = None,
    overwrite: bool = False, repairs: int = 2, parallel: int = 4, titles: DataFrame | None = None, name: str = "", strict: bool = True, wave: int = WAVE,
) -> DataFrame:
    """Batches of chunks to the tables under `out`; see `extracted` for what comes back. A batch that has a readable answer under the
    same size is not asked for again. `titles(book, title)` and the brigade's name go into the prompts. At most `parallel`
    requests run at once; `strict` raises `UnreadableAnswers` where some are left, after all is written."""
    spark = chunks.sparkSession
    if overwrite:
        _delete(spark, f"{out}/raw")
        _delete(spark, f"{out}/asked")
    b = E.prompt_texts(chunks, size).where(F.col("batch_id").between(first or 1, last or 2**31 - 1))
    b = b.join(E.batches(chunks, size), ["book", "batch_id"]).withColumns({"batch_size": F.lit(size), "key": F.concat_ws("\0", "book", "batch_id", F.lit(str(size)))})
    b = durable(b)
    S.append_new(b.drop("prompt_text"), f"{out}/asked", ["key"])
    known = b.join(titles.groupBy("book").agg(F.max("title").alias("title")), "book", "left") if titles is not None else b.withColumn("title", F.col("book"))
    prompts = known.select("key", _filled(P.EXTRACT_USER, name=name, title=F.coalesce("title", "book"), text=F.col("prompt_text")).alias("prompt"))
    _settle(prompts, out, client, P.EXTRACT_SYSTEM, EXTRACT_TOKENS, repairs, provider, model, parallel, wave)
    mine = extracted(spark, out)
    _complete(mine.join(b.select("book", "batch_id", "batch_size"), ["book", "batch_id", "batch_size"], "left_semi"), strict)
    return mine


def payloads(answers: DataFrame) -> DataFrame:
    """The readable answers as `(book, batch_id, movements, notes)`."""
    n = F.col("batch_id") if "batch_id" in answers.columns else F.col("group_id").alias("batch_id")
    return answers.where("payload is not null").select("book", n, F.from_json("payload", ANSWER).alias("p")).select("book", "batch_id", "p.movements", "p.notes")


def consolidate(answers: DataFrame, template: dict | None = None, source: str = "", filtered: bool = False, fallback: dict | None = None) -> DataFrame:
    """Events of all answers, merged, as one document per book; after verification they are filtered first."""
    p = payloads(answers)
    e = E.normalize(S.events_of(p))
    e = E.relevant(e) if filtered else e
    return E.document(E.sequential_merge(E.exact_merge(e)), S.notes_of(p), template, source, fallback)


def verified(spark: SparkSession, out: str) -> DataFrame:
    """`(book, group_id, input_events, provider, model, raw_response, payload, repair_attempts, error)` of the groups last asked for; a group of one is
    its own answer."""
    g = spark.read.parquet(f"{out}/asked")
    own = F.when(F.size("input_events") == 1, F.to_json(F.struct(F.col("input_events").alias("movements"), F.array().cast("array<string>").alias("notes"))))
    a = g.join(_read(_raw(spark, out)), "key", "left").drop("key", "run")
    return a.withColumns({"payload": F.coalesce("payload", own), "repair_attempts": F.coalesce("repair_attempts", F.lit(0))})


def verify(
    events: DataFrame, out: str, client: Client, provider: str = "", model: str = "", size: int = 6, first: int | None = None, last: int | None = None,
    overwrite: bool = False, parallel: int = 4, name: str = "", strict: bool = True, wave: int = WAVE,
) -> DataFrame:
    """Relevant events in groups, to the tables under `out`; see `verified`. A group of one passes as it is, the others go to the
    model, without repairs. An answer belongs to the events it was asked about: groups that come out otherwise, by another size
    or from other events, are asked for anew."""
    spark = events.sparkSession
    if overwrite:
        _delete(spark, f"{out}/raw")
    g = E.verification_groups(E.relevant(E.normalize(events)), size)
    x = F.array_sort(F.collect_list(F.struct("ord", F.struct(*FIELDS).alias("e"))))  # at most `size`
    per = g.groupBy("book", "group_id").agg(x.alias("x")).select("book", "group_id", F.transform("x", lambda y: y["e"]).alias("input_events"))
    per = per.where(F.col("group_id").between(first or 1, last or 2**31 - 1))
    per.withColumn("key", F.concat_ws("\0", "book", F.md5(F.to_json("input_events")))).write.mode("overwrite").parquet(f"{out}/asked")
    asked = spark.read.parquet(f"{out}/asked").where(F.size("input_events") > 1).dropDuplicates(["key"])
    prompts = asked.select("key", _filled(P.VERIFY_USER, name=name, text=F.to_json("input_events", {"pretty": "true"})).alias("prompt"))
    _settle(prompts, out, client, P.VERIFY_SYSTEM, VERIFY_TOKENS, 0, provider, model, parallel, wave)
    return _complete(verified(spark, out), strict)


def polish(events: DataFrame, out: str, client: Client, size: int = 20, parallel: int = 4, name: str = "", provider: str = "", model: str = "", wave: int = WAVE) -> DataFrame:
    """Events `(book, ord, ...)` with shorter titles and notes; answers are kept under `out`. Rows are never added or dropped: an answer
    is joined by its place in the batch, and where there is none the row's own texts are kept; both are trimmed in any case."""
    spark = events.sparkSession
    n = numbered(events.select("book", "ord"), ["book"], "ord", "_n", 1 << 24)
    e = events.join(n, ["book", "ord"]).withColumns({"_b": F.floor(F.col("_n") / size).cast("int"), "_i": (F.col("_n") % size + 1).cast("int")})
    e = durable(e)
    item = F.struct(F.col("_i").alias("index"), "date", "place", "operation", "division", "notes")
    text = F.to_json(F.array_sort(F.collect_list(item)), {"pretty": "true"})  # of `size` records
    asked = durable(e.groupBy("book", "_b").agg(text.alias("text")).withColumn("key", F.concat_ws("\0", "book", F.md5("text"))))
    _settle(asked.dropDuplicates(["key"]).select("key", _filled(P.POLISH_USER, name=name, text=F.col("text")).alias("prompt")), out, client, P.POLISH_SYSTEM, POLISH_TOKENS, 0, provider, model, parallel, wave)
    record = "array<struct<index:int,operation:string,notes:string>>"
    got = asked.join(_read(_raw(spark, out)), "key").where("payload is not null").select("book", "_b", F.from_json("payload", f"events {record}, movements {record}").alias("p"))
    got = got.select("book", "_b", F.explode(F.coalesce("p.events", "p.movements")).alias("m"))
    got = got.groupBy("book", "_b", F.col("m.index").alias("_i")).agg(F.max("m.operation").alias("_op"), F.max("m.notes").alias("_notes"))
    j = e.join(got, ["book", "_b", "_i"], "left")
    return j.withColumns({
        "operation": T.clean_operation(F.coalesce("_op", "operation")), "notes": T.trim_note(F.coalesce("_notes", "notes")),
    }).select(*events.columns)
