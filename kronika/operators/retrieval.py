"""Search over chunks: features, vectors, words, fusion, reranking and the context that is cited.

A question is read once, on the driver, into literals; each branch ends in a bounded top-k.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronika.config import Profile, Vocabulary, Weights
from kronika.functions import text as T
from kronika.functions.similarity import plain_normalize

FEATURES = [
    "is_contents", "has_section_heading", "has_structure_terms", "has_chronology_terms", "has_operational_terms", "is_early_section",
    "is_appendix_like", "looks_list_like",
]

#: Rows of a block in a search for many queries, and queries of it that are scored at once.
BLOCK_ROWS, QUERIES = 20_000, 64
#: Questions that go over the texts in one pass.
QUESTIONS = 2_000
_TOKENS = re.compile(r"\w+")


def plain_tokens(text: str) -> list[str]:
    return re.findall(r"[^\W]+", plain_normalize(text))


# ---------------------------------------------------------------- features


def with_features(chunks: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Adds `text_norm`, `first_page` (-1 where unknown), `page_span` and the flags; meant to be stored with the index.
    Terms are substrings; null texts count as empty."""
    n = T.normalize(F.coalesce("text", F.lit("")))
    v = vocabulary
    df = chunks.withColumns({
        "text_norm": n, "first_page": F.coalesce(F.try_element_at("source_pages", F.lit(1)), F.lit(-1)),
        "page_span": F.greatest(F.coalesce(F.size("source_pages"), F.lit(0)), F.lit(0)),
        "_head": F.substring(T.compact(F.col("text")), 1, v.list_window),
    })
    norm = F.col("text_norm")
    many = lambda terms: T.count_contained(norm, list(terms)) >= v.distinct_hits
    return df.withColumns({
        "is_contents": reduce(lambda a, b: a & b, [norm.contains(x) for x in v.contents]),
        "has_section_heading": T.contains_any(norm, list(v.section)), "has_structure_terms": many(v.structure),
        "has_chronology_terms": many(v.chronology), "has_operational_terms": many(v.operational),
        "is_early_section": (F.col("first_page") > 0) & (F.col("first_page") <= v.early_until),
        "is_appendix_like": F.col("first_page") >= v.appendix_from,
        "looks_list_like": (F.regexp_count("_head", F.lit(";")) >= v.list_marks) | (F.regexp_count("_head", F.lit(" - ")) >= v.list_marks),
    }).drop("_head")


# ---------------------------------------------------------------- question


def search_terms(question: str, vocabulary: Vocabulary = Vocabulary()) -> list[str]:
    """Words of three letters and more, then their expansions; a word that comes twice counts twice."""
    own = [t for t in plain_tokens(question) if len(t) >= 3]
    return own + [x for t in own for x in vocabulary.expansions.get(t, ())]


def intent(question: str, vocabulary: Vocabulary = Vocabulary()) -> dict[str, bool]:
    t, n = set(plain_tokens(question)), plain_normalize(question)
    return {k: not t.isdisjoint(ws) for k, ws in vocabulary.intents.items()} | {
        k: any(s in n for s in subs) for k, subs in vocabulary.intent_substrings.items()
    }


def with_intent(questions: DataFrame, column: str, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """The flags of many questions at once, one boolean column each."""
    t, n = T.tokens(F.col(column)), T.normalize(F.coalesce(column, F.lit("")))
    flags = {k: F.arrays_overlap(t, F.array(*map(F.lit, ws))) for k, ws in vocabulary.intents.items()}
    return questions.withColumns(flags | {k: T.contains_any(n, list(s)) for k, s in vocabulary.intent_substrings.items()})


# ---------------------------------------------------------------- scores


def lexical_score(question: str, norm: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Words in the text's word set, each as often as the question has it, 1.5 for each pair of neighbours that is a
    substring, 2 for the whole question as a substring. `norm` is the normalised text."""
    terms = search_terms(question, vocabulary)
    if not [t for t in plain_tokens(question) if len(t) >= 3]:
        return F.lit(0.0)
    words = F.regexp_extract_all(norm, F.lit(T.WORD), F.lit(0))
    once: dict[str, int] = {}
    for t in terms:
        once[t] = once.get(t, 0) + 1
    # a term that comes k times counts k times: one intersection for each number of times
    levels = [[t for t, n in once.items() if n >= k] for k in range(1, max(once.values()) + 1)]
    hits = sum((F.size(F.array_intersect(words, F.array(*map(F.lit, ts)))) for ts in levels), F.lit(0))
    pairs = sum((norm.contains(f"{a} {b}").cast("int") for a, b in zip(terms, terms[1:])), F.lit(0))
    whole = plain_normalize(question)
    bonus = F.when(norm.contains(whole), 2.0).otherwise(0.0) if len(whole) >= 12 else F.lit(0.0)
    return hits.cast("double") + F.lit(1.5) * pairs + bonus


def boost(question: str, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Sum of the rules that apply; rules of intents the question has not never reach the plan."""
    return boost_for(intent(question, vocabulary), vocabulary)


def boost_for(flags: dict[str, bool], vocabulary: Vocabulary = Vocabulary()) -> Column:
    total = F.lit(0.0)
    for name, what, by in vocabulary.boosts:
        if name and not flags.get(name):
            continue
        if what.startswith("text:"):
            cond = T.contains_any(F.col("text_norm"), what[5:].split("|"))
        else:
            cond = ~F.col(what[4:]) if what.startswith("not ") else F.col(what)
        total = total + F.when(cond, F.lit(by)).otherwise(F.lit(0.0))
    return total


def lexical_topk(featured: DataFrame, question: str, limit: int, key: str = "chunk_id", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Rows with a score above 0, best first, ties by key: a bounded top-k, never a full sort."""
    s = featured.withColumn("lexical_raw", lexical_score(question, F.col("text_norm"), vocabulary))
    # filtered behind the limit: in front of it, the score and the normal form in it would be worked out for the filter and again
    return s.orderBy(F.desc("lexical_raw"), F.asc(key)).limit(limit).where("lexical_raw > 0")


class _Questions:
    """Many questions as arrays: which of them ask for a term, or a pair of neighbouring terms, and how often."""

    def __init__(self, rows: list[tuple[int, str]], vocabulary: Vocabulary) -> None:
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        terms: dict[str, dict[int, float]] = {}
        pairs: dict[str, dict[str, dict[int, float]]] = {}
        self.whole: list[tuple[int, str, float]] = []
        for q, (_, question) in enumerate(rows):
            every = search_terms(question, vocabulary)
            own = [t for t in plain_tokens(question) if len(t) >= 3]
            if not own:
                continue
            for t in every:
                at = terms.setdefault(t, {})
                at[q] = at.get(q, 0.0) + 1.0
            for a, b in zip(every, every[1:]):
                at = pairs.setdefault(a, {}).setdefault(b, {})
                at[q] = at.get(q, 0.0) + 1.5
            if len(whole := plain_normalize(question)) >= 12:
                # a text that holds the question has all of its words but for those at its ends, which may be parts of longer ones
                self.whole.append((q, whole, float(len(own) - own.count(own[0]) - own.count(own[-1]))))
        pack = lambda d: (np.array(list(d)), np.array(list(d.values())))
        self.terms = {t: pack(d) for t, d in terms.items()}
        self.pairs = {a: {b: pack(d) for b, d in x.items()} for a, x in pairs.items()}
        self.ends = {a[-3:] for a in self.pairs}

    def scores(self, text: str | None) -> np.ndarray:
        norm = plain_normalize(text or "")
        out = np.zeros(len(self.ids))
        for t in set(_TOKENS.findall(norm)).intersection(self.terms):
            at, times = self.terms[t]
            out[at] += times
        whole = [(q, w) for q, w, least in self.whole if out[q] >= least]
        found = set()
        parts = norm.split(" ")
        for x, y in zip(parts, parts[1:]):
            if x[-3:] in self.ends:
                for i in range(len(x) - 2):
                    for b in self.pairs.get(x[i:], ()):
                        if y.startswith(b):
                            found.add((x[i:], b))
        for a, b in found:
            at, times = self.pairs[a][b]
            out[at] += times
        for q, w in whole:
            if w in norm:
                out[q] += 2.0
        return out


def lexical_topk_batch(
    texts: DataFrame, questions: DataFrame, limit: int, key: str = "chunk_id", vocabulary: Vocabulary = Vocabulary(), block: int = QUESTIONS
) -> DataFrame:
    """`lexical_topk` for every row of `questions(query_id, question)` over `texts(key, text)`: `(query_id, key, lexical_raw, lexical_rank)`.

    Questions go with the tasks in blocks of about `block`, one pass over the texts for each block, so that texts are never moved;
    a task keeps the `limit` best of each question. Rows without an id are left out, null questions find nothing. Of a
    question or text given twice the better score counts.
    """
    asked = questions.where("query_id is not null and question is not null").select(F.col("query_id").cast("bigint").alias("q"), "question")
    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), "text")
    blocks = max(1, -(-asked.count() // block))

    def one(n: int) -> DataFrame:
        mine = _Questions([tuple(r) for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n).orderBy("q", "question").collect()], vocabulary)

        def search(batches):
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(mine.ids)
            for b in batches:
                ids, t = b.column("id").to_numpy(), b.column("text").to_pylist()
                for lo in range(0, len(ids), 512):
                    m = np.array([mine.scores(x) for x in t[lo : lo + 512]]).reshape(len(t[lo : lo + 512]), len(mine.ids))
                    for q in np.flatnonzero(m.max(axis=0) > 0) if m.size else ():
                        at = np.flatnonzero(m[:, q] > 0)
                        i, s = np.append(best[q][0], ids[lo + at]), np.append(best[q][1], m[at, q])
                        keep = np.lexsort((i, -s))
                        _, first = np.unique(i[keep], return_index=True)
                        keep = keep[np.sort(first)[:limit]]
                        best[q] = (i[keep], s[keep])
            n = [len(i) for i, _ in best]
            cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(mine.ids, n), pa.int64()), pa.array(cat([i for i, _ in best], np.int64), pa.int64()), pa.array(cat([s for _, s in best], float), pa.float64())],
                names=["query_id", "id", "lexical_raw"],
            )

        return rows.mapInArrow(search, "query_id bigint, id bigint, lexical_raw double")

    near = reduce(DataFrame.unionByName, [one(n) for n in range(blocks)]).groupBy("query_id", "id").agg(F.max("lexical_raw").alias("lexical_raw"))
    ranked = near.withColumn("lexical_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical_raw"), "id")))
    return ranked.where(F.col("lexical_rank") <= limit).select("query_id", F.col("id").alias(key), "lexical_raw", "lexical_rank")


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine, in doubles; a zero vector has distance 1."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = math.sqrt(sum(x * x for x in query))
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(vector, q, lambda x, y: x.cast("double") * y), F.lit(0.0), add)
    own = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    return F.lit(1.0) - F.coalesce(dot / F.nullif(own * F.lit(norm), F.lit(0.0)), F.lit(0.0))


def vector_topk(vectors: DataFrame, query: list[float], limit: int, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """Exact nearest vectors with `distance` and `semantic_rank` from 1; vectors that are null or of another length
    are left out; ties by key."""
    d = vectors.where(F.col(column).isNotNull() & (F.size(column) == len(query)))
    top = d.withColumn("distance", cosine_distance(F.col(column), query)).orderBy("distance", key).limit(limit)
    return top.withColumn("semantic_rank", F.row_number().over(Window.orderBy("distance", key)))  # over `limit` rows


def _nearest(left: pa.Table, right: pa.Table, limit: int) -> pa.Table:
    """The nearest vectors of one block for each query of another, all of one length."""

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = t.column("v").combine_chunks()
        flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten()
        m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        m[flat.is_null().to_numpy(zero_copy_only=False).reshape(m.shape).any(axis=1)] = 0.0  # as a vector without a direction
        own = np.zeros(len(m))
        for d in range(m.shape[1]):
            own += m[:, d] * m[:, d]
        return t.column("id").to_numpy(), m, np.sqrt(own)

    out: list[list[np.ndarray]] = [[], [], []]
    if left.num_rows and right.num_rows:
        (ids, m, norm), (qids, q, qnorm) = read(left), read(right)
        for lo in range(0, len(qids), QUERIES):
            # products are added in the order of the one-question form, so that equal vectors stay equal
            dot = np.zeros((len(q[lo : lo + QUERIES]), len(ids)))
            for d in range(m.shape[1]):
                dot += q[lo : lo + QUERIES, d, None] * m[None, :, d]
            both = norm[None, :] * qnorm[lo : lo + QUERIES, None]
            distance = 1.0 - np.divide(dot, both, out=np.zeros_like(dot), where=both != 0)
            for qid, row in zip(qids[lo : lo + QUERIES], distance):
                best = np.lexsort((ids, row))[:limit]
                for o, x in zip(out, (np.full(len(best), qid), ids[best], row[best])):
                    o.append(x)
    ids_, dist = [np.concatenate(o) if o else np.array([], np.int64) for o in out[:2]], out[2]
    return pa.table({
        "query_id": pa.array(ids_[0], pa.int64()), "id": pa.array(ids_[1], pa.int64()),
        "distance": pa.array(np.concatenate(dist) if dist else [], pa.float64()),
    })


def vector_topk_batch(
    vectors: DataFrame, queries: DataFrame, limit: int, key: str = "chunk_id", column: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """`vector_topk` for every row of `queries(query_id bigint, <column>)`: `(query_id, key, distance, semantic_rank)`.

    Every block of queries meets every block of vectors in a cell, which keeps the `limit` nearest of each query; these
    are merged per query. Nothing is broadcast or collected. Vectors meet queries of their own length; rows without an
    id, which no result could name, are left out; a row given twice counts once.
    """
    side = lambda df, k: df.where(F.col(k).isNotNull() & F.col(column).isNotNull()).select(F.col(k).cast("bigint").alias("id"), F.col(column).alias("v"), F.size(column).alias("dim")).where("dim > 0").distinct()
    v, q = side(vectors, key), side(queries, "query_id")
    nv, nq = max(8, -(-v.count() // block_rows)), max(1, -(-q.count() // block_rows))
    spot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("vb", spot(nv)).withColumn("qb", every(nq))
    q = q.withColumn("qb", spot(nq)).withColumn("vb", every(nv))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(left, right, limit)

    cell = ["dim", "vb", "qb"]
    near = v.groupBy(*cell).cogroup(q.groupBy(*cell)).applyInArrow(search, "query_id bigint, id bigint, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = near.withColumn("semantic_rank", F.row_number().over(order)).where(F.col("semantic_rank") <= limit)
    return ranked.select("query_id", F.col("id").alias(key), "distance", "semantic_rank")


# ---------------------------------------------------------------- fusion


def fuse(
    semantic: DataFrame, lexical: DataFrame, boosts: DataFrame, candidate_k: int, key: str = "chunk_id", weights: Weights = Weights()
) -> DataFrame:
    """Both branches, each of a bounded number of rows, as one ranking.

    `semantic(key, distance, semantic_rank)`, `lexical(key, lexical_raw)`, `boosts(key, metadata_boost)`. A rank scores
    by its place among the ranks (the last one 0, a lone one 1), a lexical score by the best one. A row of one branch
    has 0 from the other; one without a vector has distance 1 and the rank after the last. Ties: rows with a vector
    in the order of their rank, then by lexical score, then by key.
    """
    # each branch was cut by its limit, so both are small whatever the table holds
    both = F.broadcast(semantic.select(key, "distance", "semantic_rank")).join(lexical.select(key, "lexical_raw"), key, "full_outer")
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumns({"_ranks": F.coalesce(F.max("semantic_rank").over(every), F.lit(1)), "_best": F.coalesce(F.max("lexical_raw").over(every), F.lit(1.0))})
    sem = F.when(F.col("semantic_rank").isNotNull(), 1.0 - (F.col("semantic_rank") - 1) / F.greatest(F.col("_ranks") - 1, F.lit(1))).otherwise(0.0)
    both = both.withColumns({
        "semantic_score": sem, "lexical_score": F.coalesce(F.col("lexical_raw") / F.col("_best"), F.lit(0.0)),
        "_only": F.col("semantic_rank").isNull(), "distance": F.coalesce("distance", F.lit(1.0)),
        "semantic_rank": F.coalesce(F.col("semantic_rank"), F.col("_ranks") + 1),
    }).join(boosts.select(key, "metadata_boost"), key)
    score = weights.semantic * F.col("semantic_score") + weights.lexical * F.col("lexical_score") + weights.boost * F.col("metadata_boost")
    both = both.withColumn("combined_score", score)
    order = [F.desc("combined_score"), F.asc("_only"), F.asc("semantic_rank"), F.desc_nulls_last("lexical_raw"), F.asc(key)]
    top = both.orderBy(*order).limit(candidate_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_ranks", "_best", "_only", "lexical_raw")


def hybrid_topk(
    chunks: DataFrame, vectors: DataFrame, question: str, query: list[float], profile: Profile = Profile(), key: str = "chunk_id",
    vocabulary: Vocabulary = Vocabulary(),
) -> DataFrame:
    """`chunks`, `vectors(key, embedding)`, both with unique keys: the `candidate_k` best chunks with all their scores.
    Features that are stored with the chunks are used; else they, as the boost, are made for the rows of the two
    branches only."""
    limit = profile.branch_limit
    stored = "text_norm" in chunks.columns
    searched = chunks if stored else chunks.withColumn("text_norm", T.normalize(F.coalesce("text", F.lit(""))))
    sem = vector_topk(vectors.select(key, "embedding"), query, limit, key).select(key, "distance", "semantic_rank")
    sem = sem.join(chunks.select(key), key, "left_semi")
    lex = lexical_topk(searched, question, limit, key, vocabulary).select(key, "lexical_raw")
    ids = F.broadcast(sem.select(key).union(lex.select(key)).distinct())  # at most two limits
    held = chunks.join(ids, key)
    held = (held if stored else with_features(held, vocabulary)).withColumn("metadata_boost", boost(question, vocabulary))
    fused = fuse(sem, lex, held, profile.candidate_k, key)
    return held.drop("metadata_boost").join(F.broadcast(fused), key)


def rerank(candidates: DataFrame, question: str, reranker, top_k: int, key: str = "chunk_id") -> DataFrame:
    """The candidates, few by their limit, scored by a model; the combined score plays no part any more."""

    def run(batches):
        for b in batches:
            b["rerank_score"] = reranker.score(question, b["text"].fillna("").tolist())
            yield b[["_key", "rerank_score"]]

    scores = candidates.select(F.col(key).cast("string").alias("_key"), "text").mapInPandas(run, "_key string, rerank_score double")
    joined = candidates.join(scores, candidates[key].cast("string") == scores["_key"]).drop("_key")
    order = [F.desc("rerank_score"), F.asc("rank")]
    return joined.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# ---------------------------------------------------------------- context


def sources(ranked: DataFrame, key: str = "chunk_id") -> DataFrame:
    """`(rank, block, summary)` of ranked chunks with `source_pages`, `distance` and `text`."""
    cite = T.page_citation(F.col("source_pages"))
    block = F.concat_ws(
        "\n", F.format_string("Source %d", "rank"), F.format_string("chunk_id: %s", F.col(key).cast("string")),
        F.concat(F.lit("pages: "), cite), F.format_string("distance: %.4f", "distance"), F.coalesce("text", F.lit("")),
    )
    brief = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] chunk_id="), F.col(key).cast("string"), F.lit(" "), cite, F.lit(" :: "),
        T.preview(F.coalesce("text", F.lit(""))),
    )
    return ranked.select("rank", block.alias("block"), brief.alias("summary"))


def context(ranked: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: the blocks of the ranked chunks, a bounded number, in order."""
    s = sources(ranked, key)
    blocks = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return s.agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("context"))


def missing(chunks: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks the index does not hold yet. It goes by id: a text changed under its id is not seen."""
    return chunks.join(index.select(*keys).distinct(), keys, "left_anti")
