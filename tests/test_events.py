import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kronika.models import ScriptedLLM
from kronika.operators import events as E
from kronika.plans import campaign
from kronika.sources import files as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stand-ins below go to the workers


def event(ord_, date="1943-12-01", place="Brač", op="Assault on Selca", notes="", div="", lat=None, lng=None, ids=(), pages=(), book="b"):
    return (book, ord_, date, place, (lat, lng), op, div, notes, list(ids), list(pages))


def table(spark, rows):
    return E.normalize(spark.createDataFrame(rows, E.SCHEMA))


def test_exact_merge(spark):
    rows = [event(1, notes="short", ids=[3, 1], pages=[10]), event(2, "1943-12-01 ", "Brac", "assault on selca", "a longer note", "26th", 43.3, 16.8, [2], [11, 10]), event(3, place="")]
    r = E.exact_merge(table(spark, rows)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.place, r.operation, r.notes, r.division, r.coordinates.lat, r.source_chunk_ids, r.source_pages) == ("Brač", "Assault on Selca", "a longer note", "26th", 43.3, [1, 2, 3], [10, 11])


@pytest.mark.parametrize("op, notes, count", [("Napad, Nerežišća", ("", ""), 1), ("Napad, Nerežišća", ("x", ""), 2), ("Raid on Nerežišća", ("x", ""), 1)])
def test_sequential_merge(spark, op, notes, count):
    rows = [event(1, notes=notes[0]), event(2, place="Otok Brač", op=op, notes=notes[1])]
    assert E.sequential_merge(E.exact_merge(table(spark, rows))).count() == count


def test_fold_by_day_is_the_fold_over_all(spark):
    import random

    rng = random.Random(3)
    rows = [event(i, f"1943-12-0{rng.randint(1, 3)}", rng.choice(["Brač", "Otok Brač", "Vis", "Mostar"]), rng.choice(["Assault on Selca", "Raid on port", "Napad na selo", "Staff meeting"]), rng.choice(["", "x", "casualties"])) for i in range(60)]
    merged = E.exact_merge(table(spark, rows))
    got = sorted((r.date, r.operation, r.place, r.notes) for r in E.sequential_merge(merged).collect())
    order = [r.asDict(recursive=True) for r in E.with_areas(E.with_priority(merged)).orderBy("date", "_k", "place", "operation", "ord").collect()]
    out = [order[0]]
    for e in order[1:]:
        if E.mergeable(out[-1], e):
            out[-1] = E.merge_pair(out[-1], e)
        else:
            out.append(e)
    assert got == sorted((e["date"], e["operation"], e["place"], e["notes"]) for e in out)


def test_rules(spark):
    rows = [event(1, op="Formation of the brigade"), event(2, op="Staff meeting"), event(3, op="Battalion transferred to reserve"), event(4, op="Assault on border post"), event(5, op="Assault on Selca"), event(6, op="Formation of 26th division", notes="brigade")]
    r = {x.ord: x for x in E.with_rules(table(spark, rows)).collect()}
    assert [r[i].relevant for i in range(1, 7)] == [True, False, False, False, True, False]
    assert (r[1].priority, r[5].priority) == (0, 2)


def test_groups(spark):
    rows = [event(i, op="Assault on Selca", notes=str(i)) for i in range(7)] + [event(9, "1950-01-01", "Zadar", "Raid", "q", book="c")]
    g = E.verification_groups(table(spark, rows)).groupBy("book", "group_id").count().collect()
    assert sorted((x["book"], x["count"]) for x in g) == [("b", 1), ("b", 6), ("c", 1)]


GOOD = json.dumps({"movements": [{"date": "1943-12-01", "place": "Vis", "operation": "Assault on port", "source_chunk_ids": [1]}], "notes": ["n", " "]})


class Careless:
    """Gives JSON for the last batch and for repairs only."""

    def generate(self, system, user, max_tokens=1600):
        return GOOD if "text 9" in user or user.endswith("bad") else "bad"


def never():
    raise AssertionError("asked again")


def test_extraction_repairs_and_resumes(spark, tmp_path):
    chunks = spark.createDataFrame([("b", i, [i], f"text {i}", 2) for i in range(1, 10)], S.CHUNKS)
    out = str(tmp_path / "raw")
    with pytest.raises(campaign.UnreadableAnswers) as failed:
        campaign.extract(chunks, out, lambda: ScriptedLLM("bad"), parallel=1)
    assert failed.value.number == 2
    # bad first, readable after one repair on the next run; what was bad is kept
    raw = campaign.extract(chunks, out, Careless, parallel=1, wave=10)
    assert sorted((r.batch_id, r.repair_attempts, r.error) for r in raw.collect()) == [(1, 1, None), (2, 0, None)]
    assert spark.read.parquet(out + "/raw").where("raw_response = 'bad'").count() == 7
    assert campaign.extract(chunks, out, never).count() == 2
    doc = campaign.consolidate(campaign.extracted(spark, out), {"brigade_name": "x"}, "label").first()
    assert (doc.brigade_name, doc.notes, doc.source, len(doc.movements)) == ("x", "n | n", "label", 1)
    # another size is another question
    with pytest.raises(Exception, match="asked again"):
        campaign.extract(chunks, out, never, size=3)


class Dying:
    """Answers once in each task, then its task dies."""

    calls = 0

    def generate(self, system, user, max_tokens=1600):
        self.calls += 1
        if "text 5" in user:
            raise RuntimeError("lost")
        return GOOD


def test_a_lost_job_keeps_the_waves_before(spark, tmp_path):
    chunks = spark.createDataFrame([("b", i, [i], f"text {i}", 2) for i in range(1, 10)], S.CHUNKS)
    out = str(tmp_path / "raw")
    with pytest.raises(Exception, match="lost"):
        campaign.extract(chunks, out, Dying, size=1, parallel=1, wave=1)
    kept = campaign._raw(spark, out).count()
    assert campaign.extract(chunks, out, lambda: ScriptedLLM(GOOD), size=1, parallel=1).where("payload is not null").count() == 9
    assert campaign._raw(spark, out).count() == 9 and 0 < kept < 9


def test_prompts_hold_braces_and_names(spark):
    df = spark.createDataFrame([('{"a": 1} {x}', None)], "t string, n string")
    assert df.select(campaign._filled('{name}: {{"k": [{text}]}}.', name=F.col("n"), text=F.col("t"))).first()[0] == ': {"k": [{"a": 1} {x}]}.'


def test_verification_and_polish(spark, tmp_path):
    rows = [event(1, op="Assault on Selca", notes="a"), event(2, op="Assault on the harbour of Selca", notes="b"), event(3, "1950-01-01", "Zadar", "Raid on town", "q")]
    good = json.dumps({"movements": [{"date": "1943-12-01", "place": "Brač", "operation": "Assault on Selca"}], "notes": []})
    out = str(tmp_path / "v")
    with pytest.raises(campaign.UnreadableAnswers):
        campaign.verify(table(spark, rows), out, lambda: ScriptedLLM("bad"), parallel=1)
    v = campaign.verify(table(spark, rows), out, lambda: ScriptedLLM(good), parallel=1)
    assert sorted((len(r.input_events), r.raw_response is None) for r in v.collect()) == [(1, True), (2, False)]
    doc = campaign.consolidate(v, filtered=True).first()
    assert [m.operation for m in doc.movements] == ["Assault on Selca", "Raid on town"]
    assert campaign.verify(table(spark, rows), out, never).count() == 2
    assert campaign.verify(table(spark, rows), out, never, size=1).count() == 3
    answer = json.dumps({"events": [{"index": 2, "operation": "Short", "notes": "Fine. Date estimated."}]})
    p = {r.ord: r for r in campaign.polish(table(spark, rows), str(tmp_path / "p"), lambda: ScriptedLLM(answer), parallel=1).collect()}
    assert len(p) == 3 and p[2].operation == "Short" and p[2].notes == "Fine." and p[1].operation == "Assault on Selca"


def test_commands(spark, tmp_path, monkeypatch, capsys):
    from kronika import cli, models

    monkeypatch.setitem(models.PROVIDERS, "openai", lambda model: ScriptedLLM(GOOD))
    chunks, at = str(tmp_path / "chunks.parquet"), lambda name: str(tmp_path / name)
    spark.createDataFrame([("b", i, [i], f"text {i}", 2) for i in range(1, 10)] + [("c", 1, [1], "t", 1)], S.CHUNKS).write.parquet(chunks)
    (tmp_path / "t.json").write_text(json.dumps({"brigade_name": "First", "brigade_id": 7}))
    cli.main(["build", "all", "--chunks", chunks, "--work-dir", at("w"), "--output", at("doc"), "--template", at("t.json"), "--parallel", "1"], spark)
    cli.main(["verify", "all", "--build-dir", at("w"), "--work-dir", at("v"), "--output", at("doc"), "--max-group-size", "1"], spark)
    docs = S.read_documents(spark, at("doc")).orderBy("book").collect()
    assert [(d.book, d.brigade_name, d.brigade_id, len(d.movements)) for d in docs] == [("b", "First", 7, 1), ("c", "First", 7, 1)]
    monkeypatch.setitem(models.PROVIDERS, "openai", lambda model: ScriptedLLM(json.dumps({"events": [{"index": 1, "operation": "Short", "notes": "n"}]})))
    cli.main(["polish", at("doc"), "--output", at("done"), "--work-dir", at("p"), "--name", "First"], spark)
    assert [m.operation for d in S.read_documents(spark, at("done")).collect() for m in d.movements] == ["Short", "Short"]
    with pytest.raises(FileNotFoundError):
        cli.main(["build", "run", "--chunks", at("none"), "--work-dir", at("w")], spark)


def test_groups_are_those_of_one_pass_in_order(spark):
    import random

    rng = random.Random(12)
    rows = [
        event(i, f"1943-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", rng.choice(["Brač", "Otok Brač", "Vis", "Mostar", "Zadar", ""]), rng.choice(["Assault on Selca", "Raid on port", "Napad na selo", "Ambush"]), rng.choice(["", "x"]), book=rng.choice("bbbc"))
        for i in range(150)
    ]
    e = table(spark, rows)
    order = [r.asDict(recursive=True) for r in E.with_areas(e).orderBy("book", "date", "place", "operation", "ord").collect()]
    want, group, n = {}, [], 0
    for k, r in enumerate(order):
        if k and order[k - 1]["book"] != r["book"] or not k:
            group, n = [], 1
        around = [x for x in order[max(k - 1, 0) : k] + order[k + 1 : k + 2] if x["book"] == r["book"]]
        if group and (len(group) >= 6 or not any(E.related(r, x) for x in group + around)):
            group, n = [], n + 1
        group.append(r)
        want[r["ord"]] = n
    assert {r.ord: r.group_id for r in E.verification_groups(e).collect()} == want


def test_order_over_spans(spark):
    from kronika.operators import order as O

    df = spark.createDataFrame([("a", i * i, i) for i in range(40)] + [("b", 5, 1), (None, 1, 7)], "k string, o int, v int")
    r = O.running(O.numbered(df, ["k"], "o", "n", 50), ["k"], "o", F.col("v"), "s", 50)
    assert {(x.o, x.n, x.s) for x in r.where("k = 'a'").collect()} == {(i * i, i, i * (i - 1) // 2) for i in range(40)}
    p = O.preceded(df, ["k"], "o", ["o", "v"], "p", 50)
    assert {(x.o, x.p and x.p.v) for x in p.where("k = 'a'").collect()} == {(i * i, i - 1 if i else None) for i in range(40)}


def test_batches(spark):
    df = spark.createDataFrame([("b", i, [2, 1], "t", 1) for i in range(1, 10)] + [("b", 1, [2, 1], "t", 1)], S.CHUNKS)
    r = E.batches(df).orderBy("batch_id").collect()
    assert [(x.chunk_ids, x.source_pages) for x in r] == [(list(range(1, 9)), [1, 2]), ([9], [1, 2])]
    text = E.prompt_texts(df).where("batch_id = 2").first().prompt_text
    assert text == "CHUNK 9\nPAGES: 2, 1\nTEXT:\nt"


def test_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"book": "b", "page": 3, "text": "đ"}\n\n  \n', encoding="utf-8")
    assert [r[0] for r in S.read_jsonl(spark, str(p), S.PAGES).select(S.page_number()).collect()] == [3]
    (tmp_path / "Đuro 1.txt").write_text("one two\fthree", encoding="utf-8")
    assert [(r.book, r.page_number, r.word_count) for r in S.read_pdfs(spark, str(tmp_path / "*.txt")).orderBy("page_number").collect()] == [("uro 1", 1, 2), ("uro 1", 2, 1)]
    df = spark.createDataFrame([(1, "ž"), (1, "ž"), (2, None)], "id int, v string")
    assert S.append_new(df, str(tmp_path / "t"), ["id"]) == 2 and S.append_new(df, str(tmp_path / "t"), ["id"]) == 0
    S.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert json.loads(S.pretty(df.limit(1)).first().value) == {"id": 1, "v": "ž"}
    assert spark.range(1).select(S.batch_file(F.lit(7)), S.raw_file(F.lit(7)), S.batch_file(F.lit(3), "verify")).first()[:] == ("campaign_batch_0007.json", "campaign_batch_0007.raw.txt", "campaign_verify_0003.json")


def test_streaming_gives_the_batch_result(spark, tmp_path):
    from kronika.config import ChunkSpec
    from kronika.operators.chunking import chunk_books
    from kronika.operators.cleaning import clean
    from kronika.streaming.ingest import chunk_new, ingest, latest, read_pages

    folder, table, chunks = tmp_path / "in", str(tmp_path / "pages"), str(tmp_path / "chunks")
    folder.mkdir()
    rows = [{"book": b, "page_number": n, "text": " ".join(f"{b}{n}w{i}" for i in range(7))} for b in "xy" for n in range(1, 6)]
    again = {"book": "y", "page_number": 2, "text": "a new text"}
    touched = []
    for part in (rows[:4], rows[4:], [again], []):
        if part:
            (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(map(json.dumps, part)))
        ingest(read_pages(spark, str(folder)), table, str(tmp_path / "state")).awaitTermination()
        touched.append(chunk_new(spark, table, chunks, ChunkSpec(5, 1)))
    assert touched == [1, 2, 1, 0] and latest(spark, table).count() == 10
    last = {(r["book"], r["page_number"]): r["text"] for r in [*rows, again]}
    want = chunk_books(clean(spark.createDataFrame([(*k, t) for k, t in last.items()], "book string, page_number int, text string")), ChunkSpec(5, 1))
    key = lambda df: sorted((r.book, r.chunk_id, r.text) for r in df.collect())
    assert key(spark.read.parquet(chunks)) == key(want)
    (folder / "bad.json").write_text(json.dumps({"book": "x", "text": "t"}))
    with pytest.raises(Exception, match="neither page_number nor page"):
        ingest(read_pages(spark, str(folder)), table, str(tmp_path / "state")).awaitTermination()
