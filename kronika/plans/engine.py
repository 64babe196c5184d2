"""Questions over a stored index: retrieval, answers, the catalog, and a dictionary interface for a server."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronika.config import PROFILES, Vocabulary, profile
from kronika.models import PROVIDERS, Embedder, HashingEmbedder, LLMClient, OverlapReranker, Reranker
from kronika.operators import retrieval as R
from kronika.operators.order import once
from kronika.plans import prompts as P
from kronika.sources import files as S


@dataclass
class Retrieval:
    title: str
    context: str
    summaries: list[str]
    chunk_ids: list[int]


def build_index(chunks: DataFrame, path: str, embedder: Embedder | None = None, batch: int = 32, reset: bool = False, vocabulary: Vocabulary = Vocabulary()) -> tuple[int, int]:
    """Chunks with features and vectors to the table at `path`; (indexed, skipped). Only chunks it does not hold with the same
    text are encoded, `batch` texts at a time; a chunk whose text has changed gets a later `version`, see `current`. Of a
    chunk loaded twice the greatest text counts."""
    model = embedder or HashingEmbedder()
    spark = chunks.sparkSession
    mine = once(chunks, ["book", "chunk_id"], [F.coalesce("text", F.lit("")), F.coalesce("word_count", F.lit(-1))])
    mine = mine.withColumns({"text_key": F.md5(F.coalesce("text", F.lit(""))), "version": F.lit(1)})
    total = mine.count()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not reset and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        held = current(spark.read.parquet(path)).select("book", "chunk_id", F.col("text_key").alias("_key"), F.col("version").alias("_v"))
        mine = mine.join(held, ["book", "chunk_id"], "left").where("_key is null or _key <> text_key")
        mine = mine.withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_key", "_v")

    def encode(frames):
        for f in frames:
            texts = f["text"].fillna("").tolist()
            f["embedding"] = [v for i in range(0, len(texts), batch) for v in model.encode(texts[i : i + batch])]
            yield f

    featured = R.with_features(mine, vocabulary)
    fields = ", ".join(f"{n} {t}" for n, t in featured.dtypes)
    pages = F.coalesce("source_pages", F.array().cast("array<int>"))
    rows = featured.mapInPandas(encode, fields + ", embedding array<float>").withColumns({
        "page_start": F.coalesce(F.try_element_at(pages, F.lit(1)), F.lit(-1)), "page_end": F.coalesce(F.try_element_at(pages, F.lit(-1)), F.lit(-1)),
    })
    done = S.append_new(rows, path, ["book", "chunk_id", "version"], reset)
    return done, total - done


def current(index: DataFrame) -> DataFrame:
    """The rows of an index that hold: the last version of each chunk."""
    last = index.groupBy("book", "chunk_id").agg(F.max("version").alias("version"))
    return index.join(last, ["book", "chunk_id", "version"], "left_semi")


class Engine:
    """One book of an index. Clients are made once and used for every question."""

    def __init__(self, index: DataFrame, book: str, title: str | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, vocabulary: Vocabulary = Vocabulary()) -> None:
        self.chunks = current(index.where(F.col("book") == book))
        self.title = title or book
        self.embedder, self.reranker, self.vocabulary = embedder or HashingEmbedder(), reranker or OverlapReranker(), vocabulary

    def preload(self) -> None:
        self.embedder.encode([""])
        self.reranker.score("", [""])

    def rank(self, question: str, top_k: int, candidate_k: int, skip_rerank: bool) -> DataFrame:
        from kronika.config import Profile

        query = self.embedder.encode([question])[0]
        p = Profile("own", top_k, candidate_k, skip_rerank)
        found = R.hybrid_topk(self.chunks.drop("embedding"), self.chunks, question, query, p, vocabulary=self.vocabulary)
        return found.where(F.col("rank") <= top_k) if skip_rerank else R.rerank(found, question, self.reranker, top_k)

    def retrieve(self, question: str, top_k: int = 8, candidate_k: int = 40, skip_rerank: bool = False) -> Retrieval:
        ranked = self.rank(question, top_k, candidate_k, skip_rerank)
        rows = R.sources(ranked).join(ranked.select("rank", "chunk_id"), "rank").orderBy("rank").collect()  # at most top_k
        return Retrieval(self.title, "\n\n".join(r["block"] for r in rows), [r["summary"] for r in rows], [r["chunk_id"] for r in rows])

    def answer(self, question: str, llm: LLMClient, **options) -> tuple[str, Retrieval]:
        found = self.retrieve(question, **options)
        user = P.ANSWER_USER.format(title=found.title, context=found.context, question=question)
        return llm.generate(P.ANSWER_SYSTEM, user, 1600), found


class Service:
    """Requests and responses as dictionaries; errors carry the status a server would give."""

    class Error(Exception):
        def __init__(self, status: int, message: str) -> None:
            super().__init__(message)
            self.status = status

    def __init__(self, index: DataFrame, catalog: DataFrame, providers: dict[str, Callable[[str], LLMClient]] | None = None, held: int = 8) -> None:
        """`providers`: by name, what makes a client for the name of a model."""
        self.index, self.catalog, self.held = index, catalog, held
        self.providers = PROVIDERS if providers is None else providers
        self._engines: dict[str, Engine] = {}
        self._clients: dict[tuple[str, str], LLMClient] = {}

    def books(self) -> dict:
        rows = self.catalog.orderBy(F.lower("title"), "slug").collect()  # one row per book, asked for by a reader
        return {"books": [r.asDict() for r in rows]}

    def _engine(self, slug: str) -> Engine:
        if slug not in self._engines:
            row = self.catalog.where(F.col("slug") == slug).limit(1).collect()
            if not row:
                raise self.Error(404, f"no book {slug!r}")
            while len(self._engines) >= self.held:
                self._engines.pop(next(iter(self._engines)))
            self._engines[slug] = Engine(self.index, slug, row[0]["title"])
        self._engines[slug] = self._engines.pop(slug)  # the last one asked for goes last
        return self._engines[slug]

    def chat(self, request: dict) -> dict:
        began = time.monotonic()
        question = request.get("question")
        if not isinstance(question, str) or not question.strip() or not isinstance(request.get("book_slug"), str):
            raise self.Error(422, "book_slug and question are needed")
        name = request.get("profile", "fast")
        if name not in PROFILES:
            raise self.Error(400, f"no profile {name!r}")
        only, provider = bool(request.get("retrieve_only", False)), request.get("provider")
        if not only and provider not in self.providers:
            raise self.Error(400, f"no provider {provider!r}")
        engine, p = self._engine(request["book_slug"]), PROFILES[name]
        options = {"top_k": p.top_k, "candidate_k": p.candidate_k, "skip_rerank": p.skip_rerank}
        if only:
            found = engine.retrieve(question, **options)
            answer = found.context
        else:
            model = request.get("model") or ""
            if (provider, model) not in self._clients:
                self._clients[provider, model] = self.providers[provider](model)
            client = self._clients[provider, model]
            answer, found = engine.answer(question, client, **options)
        return {
            "book": {"slug": request["book_slug"], "title": engine.title}, "answer": answer, "chunk_ids": found.chunk_ids,
            "timing_ms": round(1000 * (time.monotonic() - began)), "mode": "retrieve" if only else "answer", "provider": provider,
            "model": request.get("model"),
        }


__all__ = ["Engine", "Service", "Retrieval", "build_index", "profile"]
