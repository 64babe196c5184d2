from pyspark.sql import functions as F

from kronika.config import Profile, profile
from kronika.models import OverlapReranker
from kronika.operators import retrieval as R
from kronika.plans.engine import Engine, Service, build_index, current
from kronika.models import ScriptedLLM
from kronika.sources import files as S
import pytest


def chunks(spark, rows):
    return spark.createDataFrame(rows, "book string, chunk_id int, source_pages array<int>, text string, word_count int")


def test_lexical_score(spark):
    df = R.with_features(chunks(spark, [("b", 1, [1], "Formiranje brigade: brigada je osnovana u Kozici", 7), ("b", 2, None, None, None)]))
    q = "Kada je osnovana brigada?"
    assert len(R.search_terms(q)) == 11
    got = {r.chunk_id: r.s for r in df.select("chunk_id", R.lexical_score(q, F.col("text_norm")).alias("s")).collect()}
    assert got == {1: 4.0, 2: 0.0}
    assert df.select(R.lexical_score("a b", F.col("text_norm"))).first()[0] == 0.0


def test_fusion(spark):
    sem = spark.createDataFrame([(1, .1, 1), (2, .2, 2), (3, .3, 3)], "chunk_id int, distance double, semantic_rank int")
    lex = spark.createDataFrame([(2, 4.0), (5, 8.0)], "chunk_id int, lexical_raw double")
    boosts = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0), (5, 0.5)], "chunk_id int, metadata_boost double")
    r = R.fuse(sem, lex, boosts, 10).orderBy("rank").collect()
    assert [(x.chunk_id, round(x.combined_score, 4)) for x in r] == [(5, .55), (2, .4), (1, .35), (3, 0.0)]
    assert (r[0].distance, r[0].semantic_rank) == (1.0, 4)
    alone = R.fuse(sem.where("chunk_id = 1"), lex.limit(0), boosts, 10).collect()
    assert [(x.chunk_id, x.semantic_score) for x in alone] == [(1, 1.0)]
    assert R.fuse(sem.limit(0), lex.limit(0), boosts, 10).count() == 0


def test_plan_of_the_flagship_has_no_python_and_no_full_sort(spark):
    from kronika import queries as Q

    df = Q.queries()["hybrid_topk"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Cartesian" not in plan


def test_vectors_of_other_length_or_null_are_left_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "chunk_id int, embedding array<double>")
    assert [(r.chunk_id, r.distance, r.semantic_rank) for r in R.vector_topk(v, [1.0, 0.0], 5).collect()] == [(1, 0.0, 1), (2, 1.0, 2)]


def test_every_query_of_a_batch_gets_what_it_gets_alone(spark):
    from kronika import queries as Q

    d = "/root/testdata/sf0.01"
    got = {}
    for x in Q.queries()["vector_topk_batch"](spark, d).collect():
        got.setdefault(x.query_id, {})[x.semantic_rank] = x.doc_id
    asked = {x.query_id: x.embedding for x in Q._query_vectors(spark, d).collect()}
    assert len(asked) == 5 and got.keys() == asked.keys() and all(list(sorted(r)) == list(range(1, 81)) for r in got.values())
    for i in (0, 400):
        assert {x.semantic_rank: x.doc_id for x in R.vector_topk(Q._vectors(spark, d), asked[i], 80, "doc_id").collect()} == got[i]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (6, [1.0, 0.0])], "chunk_id bigint, embedding array<double>")
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding").where("chunk_id in (1, 3, 4)")
    for rows in (1, 1000):
        r = R.vector_topk_batch(v, q, 3, block_rows=rows).collect()
        assert sorted((x.query_id, x.semantic_rank, x.chunk_id, x.distance) for x in r) == [(1, 1, 1, 0.0), (1, 2, 6, 0.0), (1, 3, 2, 1.0), (4, 1, 4, 0.0)]


def test_many_questions_find_what_each_finds_alone(spark):
    rows = [("b", i, [1], t, 1) for i, t in enumerate(["Prva brigada je formirana u selu Vis.", "brigada brigade", None, "", "kada je formirana brigada? Vis, more", "Kada je formirana brigada", "u selu viski"], 1)]
    asked = [(100, "Kada je formirana brigada"), (200, "selu Vis"), (300, None), (400, "u i"), (None, "brigada"), (500, "brigada brigada")]
    q = spark.createDataFrame(asked, "query_id bigint, question string")
    df = chunks(spark, rows + rows[:2])
    got = {}
    for r in R.lexical_topk_batch(df, q, 3, block=2).collect():
        got.setdefault(r.query_id, {})[r.lexical_rank] = (r.chunk_id, r.lexical_raw)
    once = R.with_features(chunks(spark, rows))
    want = {i: {n: (r.chunk_id, r.lexical_raw) for n, r in enumerate(R.lexical_topk(once, t, 3).collect(), 1)} for i, t in asked if i and t}
    assert got == {i: x for i, x in want.items() if x} and set(got) == {100, 200, 500}
    assert R.lexical_topk_batch(df.limit(0), q, 3).count() == R.lexical_topk_batch(df, q.limit(0), 3).count() == 0


def test_engine_and_service(spark, tmp_path):
    texts = ["Prva brigada je osnovana u selu.", "Most je srušen u noći.", "Brigada je krenula prema obali.", None, ""]
    df = chunks(spark, [("b1", i, [i, i + 1], t, 5) for i, t in enumerate(texts, 1)] + [("b2", 1, None, "Drugo.", 1)] * 2)
    path = str(tmp_path / "index")
    assert build_index(df, path) == (6, 0) and build_index(df, path) == (0, 6)
    changed = df.where("book = 'b1' and chunk_id = 2").withColumn("text", F.lit("Most je obnovljen."))
    assert build_index(changed, path) == (1, 0) and build_index(changed, path) == (0, 1)
    index = spark.read.parquet(path)
    assert index.count() == 7 and [r["text"] for r in current(index).where("book = 'b1' and chunk_id = 2").collect()] == ["Most je obnovljen."]
    e = Engine(index, "b1")
    found = e.retrieve("Kada je osnovana brigada?", 2, 12, True)
    assert found.chunk_ids[0] == 1 and "pages: pp. 1-2" in found.context and found.summaries[0].startswith("[1] chunk_id=1 pp. 1-2 :: ")
    assert e.retrieve("brigada osnovana", 2, 12, False).chunk_ids[0] == 1
    meta = spark.createDataFrame([("b1", "  ", None), ("b2", "Naslov", "x.pdf")], "book string, book_title string, source_pdf string")
    s = Service(index, S.catalog(df, meta), {"x": lambda model: ScriptedLLM("yes")})
    assert [(b["slug"], b["title"], b["chunk_count"]) for b in s.books()["books"]] == [("b1", "b1", 5), ("b2", "Naslov", 1)]
    r = s.chat({"book_slug": "b1", "question": "brigada?", "provider": "x"})
    assert r["answer"] == "yes" and r["mode"] == "answer"
    for request, status in (({"book_slug": "no", "question": "q", "retrieve_only": True}, 404), ({"book_slug": "b1", "question": "q", "provider": "none"}, 400), ({"book_slug": "b1", "question": " "}, 422), ({"book_slug": "b1", "question": "q", "profile": "z"}, 400)):
        with pytest.raises(Service.Error) as error:
            s.chat(request)
        assert error.value.status == status


def test_server(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from kronika.plans.server import server

    path = str(tmp_path / "index")
    df = chunks(spark, [("b1", 1, [1], "Prva brigada.", 2)])
    build_index(df, path)
    meta = spark.createDataFrame([], S.METADATA)
    s = server(Service(spark.read.parquet(path), S.catalog(df, meta), {}), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}/api/"
    try:
        assert json.load(urllib.request.urlopen(at + "books"))["books"][0]["slug"] == "b1"
        ask = lambda body: json.load(urllib.request.urlopen(urllib.request.Request(at + "chat", json.dumps(body).encode())))
        assert ask({"book_slug": "b1", "question": "brigada", "retrieve_only": True})["chunk_ids"] == [1]
        with pytest.raises(urllib.error.HTTPError) as error:
            ask({"book_slug": "b1"})
        assert error.value.code == 422
    finally:
        s.shutdown()


def test_profiles():
    assert profile(fast=True).skip_rerank and profile(deep=True).candidate_k == 60 and Profile().branch_limit == 80
    with pytest.raises(ValueError):
        profile(True, True)
    assert OverlapReranker().score("", ["x"]) == [0.0]
