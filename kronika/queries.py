"""Queries of the core operators over the driver's tables, and the SQL that gives the same rows.

Every query runs over its whole tables. Rows loaded twice count once. For retrieval `documents` are the
chunks, with `embeddings` as their vectors; for events `movements` are the events and `movement_id` their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronika import config as C
from kronika.functions import jsonx, similarity
from kronika.functions import text as T
from kronika.models import ChunkLLM, HashingEmbedder, OverlapReranker, PassingLLM
from kronika.operators import chunking, cleaning, validation
from kronika.operators import events as E
from kronika.operators import retrieval as R
from kronika.operators.order import chunk_once
from kronika.plans import campaign, engine
from kronika.session import scratch
from kronika.sources import files as S

Query = Callable[[SparkSession, str], DataFrame]

QUESTION = "Kada je treći bataljon opkolio kolodvor nadomak sela?"
PROFILE = C.Profile("test", top_k=8, candidate_k=20, skip_rerank=True)
SMALL = C.ChunkSpec(80, 12)


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _chunks(s, d):
    return _t(s, d, "chunks").select("book", "chunk_id", "source_pages", "text", "word_count").dropDuplicates(["book", "chunk_id", "text"])


def _pages(s, d):
    return _t(s, d, "pages").select("book", "page_number", "text").distinct()


def _events(s, d):
    return E.normalize(_t(s, d, "movements").withColumn("ord", F.col("movement_id")))


def _passages(s, d):
    pages = F.array(F.pmod("doc_id", F.lit(500)).cast("int"))
    return _t(s, d, "documents").select("doc_id", "text", pages.alias("source_pages"))


def _documents(s, d):
    return R.with_features(_passages(s, d))


def _query_vector(s, d) -> list[float]:
    return _t(s, d, "embeddings").where("vec_id is not null").orderBy("vec_id").limit(1).first()["embedding"]


def _vectors(s, d):
    return _t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _query_vectors(s, d):
    """The queries of a search for many: every row whose id is divisible by 100."""
    return _t(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _questions(s, d):
    """Titles as questions, of every document whose id is divisible by 100."""
    return _t(s, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))


def _hybrid(s, d):
    return R.hybrid_topk(_passages(s, d), _vectors(s, d), QUESTION, _query_vector(s, d), PROFILE, key="doc_id")


def _model_answers(s, d):
    m = _t(s, d, "movements").select("movement_id", F.to_json(F.struct("date", "place")).alias("j"))
    k = F.pmod("movement_id", F.lit(4))
    raw = (
        F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), F.col("j"), F.lit("\n```\nDone.")))
        .when(k == 1, F.concat(F.lit("Answer: "), F.regexp_replace("j", r"\}$", ",}"), F.lit(" end")))
        .when(k == 2, F.col("j")).otherwise(F.lit("no object here"))
    )
    return m.select("movement_id", raw.alias("raw"))


def _extracted(s, d):
    o = jsonx.json_object_text(F.col("raw"))
    j = _model_answers(s, d).withColumn("o", F.from_json(o, "date string, place string"))
    return j.select("movement_id", F.col("o.date").alias("date"), F.col("o.place").alias("place"), F.col("o").isNotNull().alias("readable"))


def _pairs(s, d):
    from pyspark.sql import Window

    e = _events(s, d)
    w = Window.partitionBy("book").orderBy("ord")
    return e.select("book", "ord", "date", "operation", F.lag("date").over(w).alias("before"), F.lag("operation").over(w).alias("op_before")).where("before is not null")


def _round_trip(s, d):
    """Pages written as JSON lines and read again."""
    at = scratch(s, "pages")
    S.write_jsonl(_pages(s, d).withColumnRenamed("page_number", "page"), at)
    return S.read_jsonl(s, at, S.PAGES).select("book", S.page_number().alias("page_number"), F.md5("text").alias("hash"))


def _unnested(s, d):
    """Events of batch documents, one document for each book and batch."""
    record = F.struct("date", "place", "operation", "source_chunk_ids")
    b = _t(s, d, "movements").groupBy("book", "batch_id").agg(F.array_sort(F.collect_list(F.struct("movement_id", record.alias("e")))).alias("x"))
    e = S.events_of(b.select("book", "batch_id", F.transform("x", lambda x: x["e"]).alias("movements")))
    return e.select("book", "ord", "date", "place", "operation", F.array_join("source_chunk_ids", ",").alias("chunk_ids"))


def _extracted_events(s, d):
    """All batches of chunks asked for, with a stand-in that names the chunks; the records of the answers."""
    a = campaign.extract(_t(s, d, "chunks"), scratch(s, "extract"), ChunkLLM, "stand-in", wave=2_000)
    e = S.events_of(campaign.payloads(a))
    return e.select("book", F.floor(F.col("ord") / 1_000_000).cast("int").alias("batch_id"), "place", F.array_join("source_chunk_ids", ",").alias("chunk_ids"), F.array_join("source_pages", ",").alias("pages"))


def _verified_events(s, d):
    """All groups of relevant events verified, with a stand-in that lets them pass; what stays after the filter."""
    v = campaign.verify(_events(s, d), scratch(s, "verify"), PassingLLM, "stand-in", wave=2_000)
    e = E.relevant(E.normalize(S.events_of(campaign.payloads(v))))
    return e.select("book", *E.TEXTS, F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng"), F.array_join("source_chunk_ids", ",").alias("chunk_ids"))


def _index(s, d):
    """An index of the chunks of even ids with other texts, brought up to date by all chunks; what holds in it."""
    at, chunks = scratch(s, "index"), chunk_once(_t(s, d, "chunks").where("book is not null and chunk_id is not null"))
    engine.build_index(chunks.where("chunk_id % 2 = 0").withColumn("text", F.lower("text")), at)
    engine.build_index(chunks, at)
    return engine.current(s.read.parquet(at)).select("book", "chunk_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "page_start", "page_end")


def queries() -> dict[str, Query]:
    r6 = lambda c: F.round(c, 6).alias(c)
    return {
        "normalize_text": lambda s, d: _chunks(s, d).select("book", "chunk_id", F.length(T.normalize(F.col("text"))).alias("n"), F.md5(T.normalize(F.col("text"))).alias("hash")),
        "token_counts": lambda s, d: _chunks(s, d).select("book", "chunk_id", F.size(T.tokens(F.col("text"))).alias("tokens"), T.count_words(F.col("text")).alias("words")),
        "preview": lambda s, d: _t(s, d, "documents").select("doc_id", T.preview(F.coalesce("text", F.lit(""))).alias("preview")),
        "slugify": lambda s, d: _t(s, d, "documents").where("title is not null").select(
            "doc_id", T.slug_filename(F.col("title")).alias("file_slug"), T.slug_name(F.col("title")).alias("name_slug"), T.collection_name(F.col("title")).alias("collection")),
        "page_citation": lambda s, d: _chunks(s, d).select("book", "chunk_id", T.page_citation(F.col("source_pages")).alias("citation")),
        "page_list": lambda s, d: _chunks(s, d).select("book", "chunk_id", F.array_join(T.page_list(F.array_join("source_pages", " , ")), "|").alias("pages")),
        "duration": lambda s, d: _t(s, d, "documents").select("doc_id", T.duration(F.col("n_chars") * 3.7).alias("duration")),
        "clean_pages": lambda s, d: cleaning.clean(_pages(s, d)),
        "cleaning_report": lambda s, d: cleaning.cleaning_report(cleaning.clean(_pages(s, d))),
        "chunk_documents": lambda s, d: chunking.chunk_texts(_t(s, d, "documents"), ["doc_id"], spec=SMALL),
        "chunk_books": lambda s, d: chunking.chunk_books(_t(s, d, "pages"), SMALL).withColumn("source_pages", F.array_join("source_pages", ",")),
        "validate_summary": lambda s, d: validation.summary(_t(s, d, "chunks")).withColumn("avg_words", F.round("avg_words", 6)),
        "validate_gaps": lambda s, d: validation.gaps(_t(s, d, "chunks")),
        "validate_overlap": lambda s, d: validation.overlap_breaks(_t(s, d, "chunks"), 24),
        "books_catalog": lambda s, d: S.catalog(_t(s, d, "chunks"), _t(s, d, "metadata")),
        "page_map": lambda s, d: S.page_map(_t(s, d, "pages").withColumn("o", F.struct(F.coalesce(F.col("word_count"), F.lit(-1)), "text")), "o"),
        "index_incremental": lambda s, d: R.missing(_chunks(s, d).select("book", "chunk_id"), _t(s, d, "chunks").where("word_count = 160"), ["book", "chunk_id"]),
        "chunk_features": lambda s, d: R.with_features(_chunks(s, d)).select("book", "chunk_id", "first_page", "page_span", *R.FEATURES),
        "query_expand": lambda s, d: s.createDataFrame([(i, t) for i, t in enumerate(R.search_terms("When was the brigada formirana and founded"), 1)], "pos int, term string"),
        "query_intent": lambda s, d: R.with_intent(_t(s, d, "eval_items").select("item_id", "item_text"), "item_text").drop("item_text"),
        "metadata_boost": lambda s, d: _documents(s, d).select("doc_id", *[F.round(R.boost_for({k: True}), 6).alias(k) for k in [*C.INTENT_TERMS, *C.INTENT_SUBSTRINGS]]),
        "lexical_topk": lambda s, d: R.lexical_topk(_documents(s, d), QUESTION, 80, "doc_id").select("doc_id", F.col("lexical_raw").alias("score")),
        "lexical_topk_batch": lambda s, d: R.lexical_topk_batch(_t(s, d, "documents"), _questions(s, d), 80, "doc_id").withColumnRenamed("lexical_raw", "score"),
        "vector_topk": lambda s, d: R.vector_topk(_vectors(s, d), _query_vector(s, d), 80, "doc_id").select("doc_id", r6("distance"), "semantic_rank"),
        "vector_topk_batch": lambda s, d: R.vector_topk_batch(_vectors(s, d), _query_vectors(s, d), 80, "doc_id").select("query_id", "doc_id", r6("distance"), "semantic_rank"),
        "hybrid_topk": lambda s, d: _hybrid(s, d).select("doc_id", "rank", "semantic_rank", *map(r6, ("distance", "semantic_score", "lexical_score", "metadata_boost", "combined_score"))),
        "source_summaries": lambda s, d: R.sources(_hybrid(s, d).where(F.col("rank") <= PROFILE.top_k), "doc_id"),
        "context_block": lambda s, d: R.context(_hybrid(s, d).where(F.col("rank") <= PROFILE.top_k), "doc_id"),
        "rerank_topk": lambda s, d: R.rerank(_hybrid(s, d), QUESTION, OverlapReranker(), PROFILE.top_k, "doc_id").select("doc_id", "rank", r6("rerank_score")),
        "embed_chunks": lambda s, d: _embedded(_chunks(s, d)),
        "event_batches": lambda s, d: E.batches(_t(s, d, "chunks")).select("book", "batch_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.array_join("source_pages", ",").alias("source_pages")),
        "prompt_texts": lambda s, d: E.prompt_texts(_t(s, d, "chunks")),
        "extract_json": _extracted,
        "event_normalize": lambda s, d: _events(s, d).select(
            "book", "ord", *E.TEXTS, F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng"),
            F.array_join("source_chunk_ids", ",").alias("chunk_ids"), F.array_join("source_pages", ",").alias("pages")),
        "event_rules": lambda s, d: E.with_rules(_events(s, d)).select("book", "ord", "combat", "formation", "relevant", "priority"),
        "event_exact_merge": lambda s, d: E.exact_merge(_events(s, d)).select(
            "book", "ord", *E.TEXTS, F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng"),
            F.array_join("source_chunk_ids", ",").alias("chunk_ids"), F.array_join("source_pages", ",").alias("pages")),
        "date_distance": lambda s, d: _pairs(s, d).select("book", "ord", T.date_distance(F.col("before"), F.col("date")).alias("days")),
        "event_similarity": lambda s, d: _pairs(s, d).select("book", "ord", F.round(similarity.text_similarity(F.col("op_before"), F.col("operation")), 6).alias("ratio")),
        "event_sequential_merge": lambda s, d: E.sequential_merge(E.exact_merge(_events(s, d))),
        "event_groups": lambda s, d: E.verification_groups(E.relevant(_events(s, d))).select("book", "ord", "group_id"),
        "final_document": lambda s, d: E.document(
            E.exact_merge(_events(s, d)), _t(s, d, "movements").select("book", F.col("movement_id").alias("ord"), F.col("division").alias("note")).where("note is not null"),
            {"brigade_name": "x"}, "movements",
        ).select("book", "brigade_name", F.size("movements").alias("events"), F.md5(F.array_join(F.transform("movements", lambda x: F.concat_ws("|", x["date"], x["place"], x["operation"], x["division"], x["notes"])), "\n")).alias("hash"), "notes", "source"),
        "pages_jsonl": _round_trip, "events_unnest": _unnested, "extract_events": _extracted_events, "verify_events": _verified_events, "index_upsert": _index,
        "combine_notes": lambda s, d: _t(s, d, "movements").select("movement_id", T.combine_notes(F.coalesce("division", F.lit("")), F.coalesce("notes", F.lit("")), 200).alias("combined"), T.longer_text(F.col("place"), F.col("operation")).alias("longer")),
        "polish_trim": lambda s, d: _t(s, d, "movements").select("movement_id", T.trim_note(F.coalesce("notes", F.lit("")), limit=240).alias("note"), T.clean_operation(F.coalesce("operation", F.lit("")), 30).alias("title")),
    }


def _embedded(chunks: DataFrame) -> DataFrame:
    def run(frames):
        model = HashingEmbedder()
        for f in frames:
            f["vector"] = [[round(x, 6) for x in v] for v in model.encode(f["text"].fillna("").tolist())]
            yield f[["book", "chunk_id", "vector"]]

    v = chunks.select("book", "chunk_id", "text").mapInPandas(run, "book string, chunk_id int, vector array<double>")
    return v.withColumn("vector", F.array_join(F.transform("vector", lambda x: F.format_string("%.4f", x)), " "))


# ---------------------------------------------------------------- SQL


def _n(x: str) -> str:
    return f"lower(strip_accents(replace(replace({x}, '…', '...'), '½', '1⁄2')))"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _map(table: dict[str, tuple[str, ...]]) -> str:
    return "map {" + ", ".join(f"{_q(k)}: [{', '.join(map(_q, v))}]" for k, v in table.items()) + "}"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def _count(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {_q(w)})::INT" for w in words) + ")"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def _compact(x: str) -> str:
    return f"array_to_string({_words(x)}, ' ')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_CHUNKS = "SELECT DISTINCT ON (book, chunk_id, text) book, chunk_id, source_pages, text, word_count FROM chunks"
_ONCE = """SELECT book, chunk_id, x.source_pages AS source_pages, x.text AS text, x.word_count AS word_count FROM (
    SELECT book, chunk_id, arg_max({'source_pages': source_pages, 'text': text, 'word_count': word_count},
        (coalesce(text, ''), coalesce(word_count, -1), coalesce(array_to_string(source_pages, ','), ''))) AS x FROM chunks GROUP BY book, chunk_id)"""


def _clip(x: str, limit: int) -> str:
    return f"CASE WHEN length({x}) > {limit} THEN rtrim(substr({x}, 1, {limit - 3}), ' ,;:-') || '...' ELSE {x} END"


def _citation(src: str) -> str:
    """`src(rid, pages)` to `(rid, citation)`."""
    return f"""
        u AS (SELECT rid, unnest(pages) AS p, generate_subscripts(pages, 1) AS i FROM {src}),
        v AS (SELECT *, CASE WHEN p = lag(p) OVER (PARTITION BY rid ORDER BY i) + 1 THEN 0 ELSE 1 END AS fresh FROM u),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM v),
        h AS (SELECT rid, run, arg_min(p, i) AS s, arg_max(p, i) AS e FROM g GROUP BY rid, run),
        cited AS (
            SELECT rid, CASE WHEN count(*) > 1 OR bool_or(run = 1 AND s <> e) THEN 'pp. ' ELSE 'p. ' END
                || string_agg(CASE WHEN s = e THEN s::VARCHAR ELSE s || '-' || e END, ', ' ORDER BY run) AS citation
            FROM h GROUP BY rid
        )"""


def _feature_columns(norm: str, compact: str) -> str:
    v = C.Vocabulary()
    head = f"substr({compact}, 1, {v.list_window})"
    marks = lambda m: f"(length({head}) - length(replace({head}, {_q(m)}, ''))) / {len(m)} >= {v.list_marks}"
    return f"""
        coalesce(source_pages[1], -1) AS first_page, coalesce(len(source_pages), 0)::INT AS page_span,
        {" AND ".join(f"contains({norm}, {_q(x)})" for x in v.contents)} AS is_contents, {_any(norm, v.section)} AS has_section_heading,
        {_count(norm, v.structure)} >= 3 AS has_structure_terms, {_count(norm, v.chronology)} >= 3 AS has_chronology_terms,
        {_count(norm, v.operational)} >= 3 AS has_operational_terms, coalesce(source_pages[1], -1) BETWEEN 1 AND {v.early_until} AS is_early_section,
        coalesce(source_pages[1], -1) >= {v.appendix_from} AS is_appendix_like, ({marks(";")} OR {marks(" - ")}) AS looks_list_like"""


def _boost_sql(flags: dict[str, bool]) -> str:
    out = ["0::DOUBLE"]
    for name, what, by in C.BOOSTS:
        if name and not flags.get(name):
            continue
        cond = _any("text_norm", what[5:].split("|")) if what.startswith("text:") else what
        out.append(f"CASE WHEN {cond} THEN {by}::DOUBLE ELSE 0 END")
    return " + ".join(out)


_DOCS = f"""docs AS (SELECT doc_id, text, [(doc_id % 500)::INT] AS source_pages, {_n("coalesce(text, '')")} AS text_norm, {_compact("coalesce(text, '')")} AS flat FROM documents),
    featured AS (SELECT doc_id, text, source_pages, text_norm, {_feature_columns("text_norm", "flat")} FROM docs)"""


def _lexical_sql(question: str) -> str:
    terms = R.search_terms(question)
    words = r"list_distinct(regexp_extract_all(text_norm, '[\p{L}\p{N}_]+'))"
    hits = " + ".join(f"list_contains(ws, {_q(t)})::INT" for t in terms)
    pairs = " + ".join(f"contains(text_norm, {_q(a + ' ' + b)})::INT" for a, b in zip(terms, terms[1:]))
    whole = similarity.plain_normalize(question)
    return f"""scored AS (
        SELECT doc_id, (({hits}) + 1.5::DOUBLE * ({pairs}) + CASE WHEN contains(text_norm, {_q(whole)}) THEN 2 ELSE 0 END)::DOUBLE AS score
        FROM (SELECT doc_id, text_norm, {words} AS ws FROM featured)),
    lex AS (SELECT doc_id, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {{limit}})"""


_SEM = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT 1),
    near AS (SELECT vec_id AS doc_id, list_cosine_distance(embedding::DOUBLE[], v) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT {limit}),
    sem AS (SELECT *, row_number() OVER (ORDER BY distance, doc_id)::INT AS semantic_rank FROM near)"""

_LIMIT = PROFILE.branch_limit
_HYBRID = f"""{_DOCS}, {_lexical_sql(QUESTION).replace("{limit}", str(_LIMIT))}, {_SEM.replace("{limit}", str(_LIMIT))},
    held AS (SELECT * FROM sem WHERE doc_id IN (SELECT doc_id FROM documents)),
    m AS (
        SELECT doc_id, distance AS d, semantic_rank AS r, score, coalesce(max(semantic_rank) OVER (), 1) AS ranks, coalesce(max(score) OVER (), 1) AS best
        FROM held FULL JOIN lex USING (doc_id)),
    f AS (
        SELECT m.doc_id, coalesce(d, 1) AS distance, coalesce(r, ranks + 1)::INT AS semantic_rank,
            CASE WHEN r IS NULL THEN 0 ELSE 1 - (r - 1)::DOUBLE / greatest(ranks - 1, 1) END AS semantic_score,
            coalesce(score / best, 0)::DOUBLE AS lexical_score, {_boost_sql(R.intent(QUESTION))} AS metadata_boost, r IS NULL AS only_words, score, text, source_pages
        FROM m JOIN featured USING (doc_id)),
    c AS (SELECT *, 0.35::DOUBLE * semantic_score + 0.45::DOUBLE * lexical_score + 0.2::DOUBLE * metadata_boost AS combined_score FROM f),
    fused AS (
        SELECT *, row_number() OVER (ORDER BY combined_score DESC, only_words, semantic_rank, score DESC NULLS LAST, doc_id)::INT AS rank
        FROM c QUALIFY rank <= {PROFILE.candidate_k}),
    top AS (SELECT *, doc_id AS rid, source_pages AS pages FROM fused WHERE rank <= {PROFILE.top_k})"""

_ids = lambda c: f"list_sort(list_distinct(list_filter(coalesce({c}, []::INT[]), lambda x: x IS NOT NULL)))"
_EVENTS = f"""ev AS (
        SELECT book, movement_id AS ord, {", ".join(f"{_strip(f"coalesce({c}, '')")} AS {c}" for c in E.TEXTS)},
            coordinates.lat AS lat, coordinates.lng AS lng, {_ids("source_chunk_ids")} AS cids, {_ids("source_pages")} AS pids
        FROM movements)"""
_BLOB = _n("concat_ws(' ', nullif(operation, ''), nullif(notes, ''), nullif(place, ''), nullif(division, ''))")
_BOTH = _n("operation || ' ' || notes")


def _relevant_sql() -> str:
    r = C.EventRules()
    titles = " OR ".join(f"regexp_matches(o, {_q(p)})" for p in r.title_patterns)
    prefixes = " OR ".join(f"starts_with(o, {_q(p)})" for p in r.movement_prefixes)
    return f"""(formation OR (NOT ({_any("b", r.excluded)} OR {_any("b", r.administrative)} OR ({_any("b", r.non_combat)} AND NOT combat)
        OR ({_any("o", r.movement_titles)} AND NOT op_combat) OR {prefixes} OR {titles}
        OR ({_any("b", r.small_units)} AND {_any("b", r.unit_moves)} AND NOT combat)) AND op_combat))"""


_RULES = f"""{_EVENTS},
    t AS (SELECT *, {_BLOB} AS b, {_n("operation")} AS o, {_BOTH} AS c FROM ev),
    k AS (SELECT *, {_any("b", C.COMBAT)} AS combat, {_any("o", C.COMBAT)} AS op_combat,
        {_any("c", C.FORMED)} AND NOT ({_any("c", C.DIVISION)} AND {_any("c", C.OTHER_FORMATION)})
            AND {_any("c", C.BRIGADE)} AS formation,
        CASE WHEN {_any("c", C.FORMED)} THEN 0 WHEN {_any("c", C.REORGANISED)} THEN 1 ELSE 2 END AS priority
        FROM t)"""

_MERGED = f"""{_EVENTS},
    x AS (
        SELECT book, date AS d, {_n("place")} AS p, {_n("operation")} AS o, min(ord) AS ord, arg_min(place, ord) AS place, arg_min(operation, ord) AS operation,
            coalesce(arg_min(division, ord) FILTER (division <> ''), '') AS division, arg_max(notes, (length(notes), -ord)) AS notes,
            arg_min({{'lat': lat, 'lng': lng}}, ord) FILTER (lat IS NOT NULL) AS pt, list_sort(list_distinct(flatten(list(cids)))) AS cids, list_sort(list_distinct(flatten(list(pids)))) AS pids
        FROM ev WHERE date <> '' AND place <> '' AND operation <> '' GROUP BY ALL)"""

_CLEAN = rf"""p AS (SELECT row_number() OVER () AS rid, * FROM (SELECT DISTINCT book, page_number, text FROM pages)),
    sp AS (SELECT rid, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM p),
    sq AS (SELECT rid, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM sp),
    l AS (SELECT rid, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM sq),
    fl AS (SELECT *, regexp_matches(x, '^\s*\d+\s*$') AS pn, regexp_matches(x, {_q(cleaning.INLINE)}) AS inl,
        i >= n // 2 AND regexp_matches(x, {_q(cleaning.FOOTNOTE)}) AS st FROM l),
    cu AS (SELECT rid, min(i) FILTER (NOT pn AND (inl OR st)) AS cut FROM fl GROUP BY rid),
    a AS (SELECT fl.*, coalesce(cut, n) AS cut FROM fl JOIN cu USING (rid) WHERE NOT pn),
    notes AS (SELECT rid, count(*)::INT AS footnote_lines, string_agg(y, chr(10) ORDER BY i) FILTER (y <> '') AS footnotes
        FROM (SELECT rid, i, {_strip(f"CASE WHEN i = cut AND inl THEN regexp_extract(x, {_q(cleaning.INLINE)}, 2) ELSE x END")} AS y FROM a WHERE i >= cut) GROUP BY rid),
    ml AS (SELECT rid, i, {_strip(f"CASE WHEN i = cut THEN regexp_extract(x, {_q(cleaning.INLINE)}, 1) ELSE x END")} AS s FROM a WHERE i < cut OR (i = cut AND inl)),
    hd AS (SELECT *, s <> '' AND len({_words("s")}) <= 8 AND regexp_matches(s, '^[A-ZČĆŽŠĐ0-9 .,:;()\-"«»]+$') AS h FROM ml),
    pv AS (SELECT *, lag(s) OVER w AS ps, lag(h) OVER w AS ph FROM hd WINDOW w AS (PARTITION BY rid ORDER BY i)),
    pb AS (SELECT *, s <> '' AND (ps IS NULL OR ps = '' OR ph OR h) AS fresh FROM pv),
    gl AS (SELECT *, s <> '' AND NOT fresh AND ends_with(ps, '-') AND regexp_matches(s, '^\p{{Ll}}') AS glue FROM pb),
    nx AS (SELECT *, lead(glue) OVER (PARTITION BY rid ORDER BY i) AS nglue FROM gl),
    tx AS (SELECT rid, string_agg(CASE WHEN fresh THEN chr(10) || chr(10) WHEN glue THEN '' ELSE ' ' END || CASE WHEN nglue THEN s[:-2] ELSE s END, '' ORDER BY i) AS t,
        count(*) FILTER (glue) AS g, count(*) FILTER (NOT fresh) AS m FROM nx WHERE s <> '' GROUP BY rid),
    cleaned AS (SELECT book, page_number, {_strip(r"regexp_replace(regexp_replace(coalesce(t, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS text,
        footnotes, coalesce(footnote_lines, 0)::INT AS footnote_lines, coalesce(g, 0)::INT AS dehyphenations, coalesce(m, 0)::INT AS merges
        FROM p LEFT JOIN tx USING (rid) LEFT JOIN notes USING (rid))"""


def _windows(spec: C.ChunkSpec) -> str:
    """Number of chunks of `n` words."""
    whole = f"CASE WHEN n >= {spec.words} THEN (n - {spec.words}) // {spec.step} + 1 ELSE 0 END"
    return f"(({whole}) + CASE WHEN n - ({whole}) * {spec.step} > 0 AND (({whole}) = 0 OR n - ({whole}) * {spec.step} > {spec.overlap}) THEN 1 ELSE 0 END)"


def oracle_sql() -> dict[str, str]:
    s = SMALL
    markers = _any("lower(y)", T.META_MARKERS)
    return {
        "normalize_text": f"SELECT book, chunk_id, length({_n('text')})::INT AS n, md5({_n('text')}) AS hash FROM ({_CHUNKS})",
        "token_counts": rf"SELECT book, chunk_id, len(regexp_extract_all({_n('text')}, '[\p{{L}}\p{{N}}_]+'))::INT AS tokens, len({_words('text')})::INT AS words FROM ({_CHUNKS})",
        "preview": f"SELECT doc_id, CASE WHEN length(c) <= 240 THEN c ELSE substr(c, 1, 237) || '...' END AS preview FROM (SELECT doc_id, {_compact("coalesce(text, '')")} AS c FROM documents)",
        "slugify": r"""
            WITH a AS (SELECT doc_id, regexp_replace(strip_accents(replace(title, '…', '...')), '[^\x00-\x7F]', '', 'g') AS x FROM documents WHERE title IS NOT NULL),
            b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(x, '_', ' '), '[^\w\s.-]', '', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS f,
                regexp_replace(regexp_replace(replace(lower(x), '_', '-'), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') AS n FROM a),
            c AS (SELECT doc_id, CASE WHEN f = '' THEN 'book' ELSE f END AS f, CASE WHEN n = '' THEN 'book' ELSE n END AS n FROM b),
            d AS (SELECT doc_id, f, substr(CASE WHEN length(n) < 3 THEN n || '-rag' ELSE n END, 1, 63) AS n FROM c),
            e AS (SELECT *, CASE WHEN regexp_matches(n, '^[a-z0-9]') THEN n ELSE 'b-' || n END AS k FROM d)
            SELECT doc_id, f AS file_slug, n AS name_slug, substr(CASE WHEN regexp_matches(k, '[a-z0-9]$') THEN k ELSE k || '0' END, 1, 63) AS collection FROM e""",
        "page_citation": f"WITH r AS (SELECT row_number() OVER () AS rid, book, chunk_id, source_pages AS pages FROM ({_CHUNKS})), {_citation('r')} SELECT book, chunk_id, coalesce(citation, 'page unknown') AS citation FROM r LEFT JOIN cited USING (rid)",
        "page_list": f"SELECT book, chunk_id, coalesce(array_to_string(source_pages, '|'), '') AS pages FROM ({_CHUNKS})",
        "duration": """
            SELECT doc_id, CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, (t % 3600) // 60, t % 60) WHEN t IS NOT NULL THEN printf('%02d:%02d', t // 60, t % 60) END AS duration
            FROM (SELECT doc_id, CASE WHEN n_chars IS NULL THEN 0 ELSE greatest(floor(n_chars * 3.7::DOUBLE), 0) END::BIGINT AS t FROM documents)""",
        "clean_pages": f"WITH {_CLEAN} SELECT book, page_number, text, len({_words('text')})::INT AS word_count, footnotes, footnote_lines, dehyphenations, merges FROM cleaned",
        "cleaning_report": f"""WITH {_CLEAN} SELECT book, count(*) AS pages_processed, count(*) FILTER (footnote_lines > 0) AS pages_with_footnotes_removed, sum(footnote_lines)::BIGINT AS total_footnote_lines_removed,
            sum(dehyphenations)::BIGINT AS total_dehyphenations, sum(merges)::BIGINT AS total_line_merges FROM cleaned GROUP BY book""",
        "chunk_documents": f"""
            WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents), c AS (SELECT doc_id, w, len(w) AS n FROM w),
            i AS (SELECT doc_id, w, unnest(range({_windows(s)})) AS i FROM c)
            SELECT doc_id, (i + 1)::INT AS chunk_id, array_to_string(w[i * {s.step} + 1 : i * {s.step} + {s.words}], ' ') AS text, len(w[i * {s.step} + 1 : i * {s.step} + {s.words}])::INT AS word_count FROM i""",
        "chunk_books": f"""
            WITH p AS (SELECT book, page_number, max(text) AS text FROM pages GROUP BY ALL), pw AS (SELECT book, page_number, {_words("coalesce(text, '')")} AS w FROM p),
            f AS (SELECT book, page_number, unnest(w) AS w, generate_subscripts(w, 1) AS j FROM pw),
            b AS (SELECT book, list(w ORDER BY page_number, j) AS w, list(page_number ORDER BY page_number, j) AS pg, count(*) AS n FROM f GROUP BY book),
            i AS (SELECT book, w, pg, unnest(range({_windows(s)})) AS i FROM b),
            k AS (SELECT book, (i + 1)::INT AS chunk_id, w[i * {s.step} + 1 : i * {s.step} + {s.words}] AS w, pg[i * {s.step} + 1 : i * {s.step} + {s.words}] AS pg FROM i)
            SELECT book, chunk_id, array_to_string(list_sort(list_distinct(pg)), ',') AS source_pages, array_to_string(w, ' ') AS text, len(w)::INT AS word_count FROM k""",
        "validate_summary": f"""
            SELECT book, count(*) AS chunks, coalesce(min(word_count), 0)::INT AS min_words, coalesce(max(word_count), 0)::INT AS max_words, round(coalesce(avg(word_count), 0), 6) AS avg_words,
                count(*) FILTER (word_count < 200) AS short_chunks, count(*) FILTER (n = 0) AS empty_chunks, count(*) FILTER (word_count IS NULL OR word_count <> n) AS count_mismatches
            FROM (SELECT *, len({_words("coalesce(text, '')")}) AS n FROM ({_ONCE})) GROUP BY book""",
        "validate_gaps": f"""SELECT book, expected, chunk_id AS actual FROM (SELECT book, chunk_id, (lag(chunk_id, 1, 0) OVER (PARTITION BY book ORDER BY chunk_id) + 1)::INT AS expected FROM ({_ONCE})) WHERE expected <> chunk_id""",
        "validate_overlap": f"""
            WITH w AS (SELECT book, chunk_id, {_words("coalesce(text, '')")} AS w FROM ({_ONCE})), l AS (SELECT *, lag(w) OVER o AS pw, lag(chunk_id) OVER o AS pid FROM w WINDOW o AS (PARTITION BY book ORDER BY chunk_id)),
            m AS (SELECT *, least(24, len(w), len(pw)) AS m FROM l WHERE pid IS NOT NULL)
            SELECT book, pid AS previous_id, chunk_id, m::INT AS compared, least(len(w), len(pw))::INT AS shorter FROM m WHERE m > 0 AND pw[len(pw) - m + 1 :] <> w[: m]""",
        "books_catalog": f"""
            WITH m AS (SELECT book, max(book_title) AS t, max(source_pdf) AS source_pdf FROM metadata GROUP BY book)
            SELECT book AS slug, CASE WHEN {_strip("coalesce(t, '')")} <> '' THEN t ELSE book END AS title, chunk_count, source_pdf
            FROM (SELECT book, count(DISTINCT chunk_id) AS chunk_count FROM chunks GROUP BY book) LEFT JOIN m USING (book)""",
        "page_map": "SELECT book, page_number, arg_max(text, (coalesce(word_count, -1), text)) AS text FROM pages GROUP BY ALL",
        "index_incremental": f"SELECT book, chunk_id FROM ({_CHUNKS}) c WHERE NOT EXISTS (SELECT 1 FROM chunks x WHERE x.book = c.book AND x.chunk_id = c.chunk_id AND x.word_count = 160)",
        "chunk_features": f"SELECT book, chunk_id, {_feature_columns('tn', 'flat')} FROM (SELECT *, {_n("coalesce(text, '')")} AS tn, {_compact("coalesce(text, '')")} AS flat FROM ({_CHUNKS}))",
        "query_expand": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(R.search_terms("When was the brigada formirana and founded"), 1)) + ") v(pos, term)",
        "query_intent": rf"SELECT item_id, {', '.join(f'list_has_any(ws, [{", ".join(map(_q, w))}]) AS {k}' for k, w in C.INTENT_TERMS.items())}, contains(n, 'brac') AS brach_topic FROM (SELECT item_id, {_n('item_text')} AS n, regexp_extract_all({_n('item_text')}, '[\p{{L}}\p{{N}}_]+') AS ws FROM eval_items)",
        "metadata_boost": f"WITH {_DOCS} SELECT doc_id, {', '.join(f'round({_boost_sql({k: True})}, 6) AS {k}' for k in [*C.INTENT_TERMS, *C.INTENT_SUBSTRINGS])} FROM featured",
        "lexical_topk": f"WITH {_DOCS}, {_lexical_sql(QUESTION).replace("{limit}", "80")} SELECT * FROM lex",
        "lexical_topk_batch": rf"""
            WITH q AS (SELECT DISTINCT doc_id AS query_id, {_n('title')} AS whole, list_filter(regexp_extract_all({_n('title')}, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3) AS own
                FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
            p AS (SELECT query_id, whole, own || flatten(list_transform(own, lambda x: coalesce({_map(C.EXPANSIONS)}[x], []))) AS terms FROM q WHERE len(own) > 0),
            t AS (SELECT doc_id, n, list_distinct(regexp_extract_all(n, '[\p{{L}}\p{{N}}_]+')) AS ws FROM (SELECT doc_id, {_n("coalesce(text, '')")} AS n FROM documents)),
            s AS (SELECT query_id, doc_id, len(list_filter(terms, lambda x: list_contains(ws, x))) + CASE WHEN length(whole) >= 12 AND contains(n, whole) THEN 2 ELSE 0 END
                + 1.5::DOUBLE * len(list_filter(range(1, len(terms)), lambda i: contains(n, terms[i] || ' ' || terms[i + 1]))) AS score FROM p, t)
            SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS lexical_rank FROM s WHERE score > 0 QUALIFY lexical_rank <= 80""",
        "rerank_topk": rf"""
            WITH {_HYBRID}, r AS (
                SELECT doc_id, rank, len(list_filter([{", ".join(map(_q, sorted(set(R.plain_tokens(QUESTION)))))}], lambda x: list_contains(regexp_extract_all({_n("coalesce(text, '')")}, '[\p{{L}}\p{{N}}_]+'), x)))
                    / {len(set(R.plain_tokens(QUESTION)))}::DOUBLE AS s FROM fused)
            SELECT doc_id, row_number() OVER (ORDER BY s DESC, rank)::INT AS rank, round(s, 6) AS rerank_score FROM r QUALIFY row_number() OVER (ORDER BY s DESC, rank) <= {PROFILE.top_k}""",
        "vector_topk": f"WITH {_SEM.replace("{limit}", "80")} SELECT doc_id, round(distance, 6) AS distance, semantic_rank FROM sem",
        "vector_topk_batch": """
            WITH v AS (SELECT DISTINCT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
            n AS (SELECT q.doc_id AS query_id, v.doc_id, list_cosine_distance(v.v, q.v) AS distance FROM v JOIN v q ON q.doc_id % 100 = 0 AND len(q.v) = len(v.v)),
            k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INT AS semantic_rank FROM n QUALIFY semantic_rank <= 80)
            SELECT query_id, doc_id, round(distance, 6) AS distance, semantic_rank FROM k""",
        "hybrid_topk": f"WITH {_HYBRID} SELECT doc_id, rank, semantic_rank, round(distance, 6) AS distance, round(semantic_score, 6) AS semantic_score, round(lexical_score, 6) AS lexical_score, round(metadata_boost, 6) AS metadata_boost, round(combined_score, 6) AS combined_score FROM fused",
        "source_summaries": f"""WITH {_HYBRID}, {_citation('top')}, z AS (SELECT *, {_compact("coalesce(text, '')")} AS c FROM top LEFT JOIN cited USING (rid))
            SELECT rank, 'Source ' || rank || chr(10) || 'chunk_id: ' || doc_id || chr(10) || 'pages: ' || citation || chr(10) || 'distance: ' || printf('%.4f', distance) || chr(10) || coalesce(text, '') AS block,
                '[' || rank || '] chunk_id=' || doc_id || ' ' || citation || ' :: ' || CASE WHEN length(c) <= 240 THEN c ELSE substr(c, 1, 237) || '...' END AS summary FROM z""",
        "context_block": f"""WITH {_HYBRID}, {_citation('top')}
            SELECT string_agg('Source ' || rank || chr(10) || 'chunk_id: ' || doc_id || chr(10) || 'pages: ' || citation || chr(10) || 'distance: ' || printf('%.4f', distance) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context
            FROM top LEFT JOIN cited USING (rid)""",
        "event_batches": f"""
            WITH n AS (SELECT *, ((row_number() OVER (PARTITION BY book ORDER BY chunk_id) - 1) // 8 + 1)::INT AS batch_id FROM ({_ONCE}))
            SELECT book, batch_id, array_to_string(list(chunk_id ORDER BY chunk_id), ',') AS chunk_ids, array_to_string(list_sort(list_distinct(flatten(list(coalesce(source_pages, []::INT[]))))), ',') AS source_pages FROM n GROUP BY book, batch_id""",
        "prompt_texts": f"""
            WITH n AS (SELECT *, ((row_number() OVER (PARTITION BY book ORDER BY chunk_id) - 1) // 8 + 1)::INT AS batch_id FROM ({_ONCE}))
            SELECT book, batch_id, {_strip("string_agg('CHUNK ' || chunk_id || chr(10) || 'PAGES: ' || coalesce(array_to_string(source_pages, ', '), '') || chr(10) || 'TEXT:' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY chunk_id)")} AS prompt_text FROM n GROUP BY book, batch_id""",
        "extract_json": "SELECT movement_id, CASE WHEN movement_id % 4 < 3 THEN date END AS date, CASE WHEN movement_id % 4 < 3 THEN place END AS place, movement_id % 4 < 3 AS readable FROM movements",
        "event_normalize": f"WITH {_EVENTS} SELECT book, ord, date, place, operation, division, notes, lat, lng, array_to_string(cids, ',') AS chunk_ids, array_to_string(pids, ',') AS pages FROM ev",
        "event_rules": f"WITH {_RULES} SELECT book, ord, combat, formation, {_relevant_sql()} AS relevant, priority FROM k",
        "event_exact_merge": f"WITH {_MERGED} SELECT book, ord, d AS date, place, operation, division, notes, pt.lat AS lat, pt.lng AS lng, array_to_string(cids, ',') AS chunk_ids, array_to_string(pids, ',') AS pages FROM x",
        "date_distance": rf"""
            WITH {_EVENTS}, l AS (SELECT book, ord, date, lag(date) OVER (PARTITION BY book ORDER BY ord) AS before FROM ev),
            n AS (SELECT book, ord, before, CASE WHEN regexp_matches(date, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN date[1:4]::INT * 372 + date[6:7]::INT * 31 + date[9:10]::INT END AS a,
                CASE WHEN regexp_matches(before, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN before[1:4]::INT * 372 + before[6:7]::INT * 31 + before[9:10]::INT END AS b FROM l)
            SELECT book, ord, abs(b - a)::INT AS days FROM n WHERE before IS NOT NULL""",
        "final_document": f"""
            WITH {_MERGED}, y AS (SELECT *, CASE WHEN {_any("c", C.FORMED)} THEN 0 WHEN {_any("c", C.REORGANISED)} THEN 1 ELSE 2 END AS k FROM (SELECT *, {_BOTH} AS c FROM x)),
            g AS (SELECT book, count(*)::INT AS events, md5(string_agg(d || '|' || place || '|' || operation || '|' || division || '|' || notes, chr(10) ORDER BY d, k, place, operation, ord)) AS hash FROM y GROUP BY book),
            n AS (SELECT book, string_agg(division, ' | ' ORDER BY movement_id) AS n FROM movements WHERE division IS NOT NULL AND {_strip('division')} <> '' GROUP BY book)
            SELECT book, 'x' AS brigade_name, events, hash, coalesce(n, '') AS notes, 'movements' AS source FROM g LEFT JOIN n USING (book)""",
        "pages_jsonl": "SELECT book, page_number, md5(text) AS hash FROM (SELECT DISTINCT book, page_number, text FROM pages)",
        "events_unnest": """
            SELECT book, batch_id::BIGINT * 1000000 + row_number() OVER (PARTITION BY book, batch_id ORDER BY movement_id) - 1 AS ord, date, place, operation,
                array_to_string(source_chunk_ids, ',') AS chunk_ids FROM movements""",
        "extract_events": f"""
            SELECT book, ((row_number() OVER (PARTITION BY book ORDER BY chunk_id) - 1) // 8 + 1)::INT AS batch_id, 'P' || chunk_id AS place, chunk_id::VARCHAR AS chunk_ids,
                coalesce(array_to_string(source_pages, ','), '') AS pages FROM ({_ONCE}) WHERE chunk_id IS NOT NULL""",
        "verify_events": f"WITH {_RULES} SELECT book, date, place, operation, division, notes, lat, lng, array_to_string(cids, ',') AS chunk_ids FROM k WHERE {_relevant_sql()}",
        "index_upsert": f"""
            SELECT book, chunk_id, md5(coalesce(text, '')) AS hash, coalesce(source_pages[1], -1) AS page_start, coalesce(source_pages[-1], -1) AS page_end
            FROM ({_ONCE}) WHERE book IS NOT NULL AND chunk_id IS NOT NULL""",
        "combine_notes": f"""
            WITH a AS (SELECT movement_id, place, operation, {_compact("coalesce(division, '')")} AS x, {_compact("coalesce(notes, '')")} AS y FROM movements),
            b AS (SELECT *, CASE WHEN x = '' THEN y WHEN y = '' OR x = y THEN x ELSE x || ' ' || y END AS c FROM a)
            SELECT movement_id, {_clip('c', 200)} AS combined, CASE WHEN length({_strip("coalesce(operation, '')")}) > length({_strip("coalesce(place, '')")}) THEN {_strip("coalesce(operation, '')")} ELSE {_strip("coalesce(place, '')")} END AS longer FROM b""",
        "polish_trim": rf"""
            WITH a AS (SELECT movement_id, {_compact("coalesce(notes, '')")} AS c, trim(trim({_compact("coalesce(operation, '')")}, '"''')) AS o FROM movements),
            b AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(c, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '' AND NOT {markers}), ' ') AS k FROM a),
            d AS (SELECT *, CASE WHEN k = '' THEN c ELSE k END AS n FROM b)
            SELECT movement_id, {_clip('n', 240)} AS note, CASE WHEN length(o) <= 30 THEN o ELSE coalesce(
                CASE WHEN contains(o, ' – ') THEN nullif(trim(split_part(o, ' – ', 1)), '') END, CASE WHEN contains(o, ': ') THEN nullif(trim(split_part(o, ': ', 1)), '') END,
                CASE WHEN contains(o, '; ') THEN nullif(trim(split_part(o, '; ', 1)), '') END, rtrim(substr(o, 1, 30), ' ,;:-')) END AS title FROM d""",
    }
