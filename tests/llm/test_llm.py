"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import datetime as dt
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kronika.llm import encoding, leakage, near_records, packing, quality, scans, splitting, survivors, terminality, truncation
from kronika.llm.components import components

WORDS = "vod četa most rov put brod selo otok luka zid mlin tor gaz klanac greben logor konvoj bunker tunel pristan".split()
MOVEMENT = (
    "movement_id bigint, book string, stage string, extracted_at timestamp, date string, place string, coordinates struct<lat:double,lng:double>, "
    "operation string, division string, notes string, source_chunk_ids array<int>, rank int, group_id string"
)


def movement(i, date="1944-01-02", place="Vis", op="Napad na most", lat=43.0, lng=16.0, ids=(1,), notes="x", book="b", day=1, division=""):
    return (i, book, "extract", dt.datetime(2025, 1, day), date, place, (lat, lng), op, division, notes, None if ids is None else list(ids), 9, "clash")


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(1, 80), rng.randint(1, 80)) for _ in range(55)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_split(spark):
    long = "Prva rečenica ima riječi. " * 90 + "\n\n" + "druga " * 150 + "\n" + "x" * 45_000
    rows = [("b", 1, [2], long, 5, "e"), ("b", 1, [2], long, 5, "e"), ("b", 2, None, None, None, "e"), ("b", 3, [], " \n ", 0, "e"), ("b", 4, [1], "kratko", 900, "e")]
    df = spark.createDataFrame(rows, "book string, chunk_id int, source_pages array<int>, text string, word_count int, piece string")
    r = splitting.split_oversized(df).orderBy("piece").collect()
    assert {x.chunk_id for x in r} == {1} and all(len(x.text.split()) == x.word_count <= 200 for x in r)
    assert all(a.text.split()[-b.overlap_words :] == b.text.split()[: b.overlap_words] for a, b in zip(r, r[1:]))
    back = "".join("".join(x.text.split()[x.overlap_words :]) for x in r)
    assert back == "".join(long.split())
    assert r[0].text.endswith("riječi.") and [tuple(x) for x in splitting.oversized(df).collect()] == [("b", 1)]
    assert splitting.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.pattern(10, 10)


def test_quality(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(f"{rng.choice(WORDS)} je na {rng.choice(WORDS)} i u {rng.choice(WORDS)}" for _ in range(30)) + "."
    roll = "\n".join(f"{i}. Horvat A., Zagreb, 19{i}" for i in range(10, 60))
    rows = [("b", i, prose(), 1) for i in range(250)] + [("r", 1, roll, 1), ("r", 1, roll, 1), ("j", 1, "~|^ <>_ #%" * 30, 1), ("n", 1, None, 1), ("n", 2, " ", 1)]
    chunks = spark.createDataFrame(rows, "book string, chunk_id int, text string, n_words int")
    pages = spark.createDataFrame([("p", 1, "a b", 2), ("p", 2, "a b", 3), ("p", 2, "a b", 3), ("p", 3, None, None), ("p", 4, None, 0)], "book string, page_number int, text string, word_count int")
    common = spark.createDataFrame([("hr", w) for w in ("je", "na", "i", "u")] + [("en", "the"), (None, "x")], "lang string, word string")
    got = sorted(tuple(x) for x in quality.found(chunks, pages, common).collect())
    assert got == [("chunk", "j", 1), ("chunk", "r", 1), ("page", "p", 2), ("page", "p", 3)]
    assert quality.found(chunks.limit(0), pages.limit(0), common).count() == 0


def test_statistics_are_the_same_however_many_common_words_there_are(spark):
    common = spark.createDataFrame([("hr", "je"), ("hr", "na"), ("en", "the"), ("en", "na"), (None, "x"), ("en", None)], "lang string, word string")
    rows = spark.createDataFrame([(1, "Vod je na moru, je."), (2, "the na the"), (3, "ništa"), (4, None), (5, "na")], "i int, text string")
    one, two = (sorted(map(str, quality.statistics(rows, quality.common_by_language(common, most)).collect())) for most in (100, 1))
    assert one == two and "text_lang='hr'" in one[0]
    pages = spark.createDataFrame([("b", 1, "a b", 2), ("b", 2, "a b", 3), ("b", 3, None, None), ("b", 1, "a b", 2)], "book string, page_number int, text string, word_count int")
    assert sorted((r.page_number, r.n_words) for r in quality.wrong_counts(pages).collect()) == [(2, 2), (3, 0)]
    assert sorted((r.page_number, r.right_count) for r in quality.page_report(pages, common).collect()) == [(1, True), (2, False), (3, False)]


def test_scans(spark):
    line = "bataljon je krenuo prema mostu i zauzeo selo prije noći"
    good = [("g", i, f"{WORDS[i % 20]} i {WORDS[i * 7 % 19]} te {line}\nzatim je vod prešao rijeku i čekao", 20, "q") for i in range(1, 30)]
    bad = "NASLOV KNJIGE  7\n   bata1jon je krenuo prema mos-\ntu i zauzec selo prije noći\n- 7 -"
    pages = spark.createDataFrame([*good, ("s", 1, bad, 3, "q"), ("s", 1, bad, 3, "q"), ("s", 2, None, None, "q"), ("s", 3, " ", 0, "q"), ("s", 4, "~|^ <>_ #%" * 9, 0, "q")], "book string, page_number int, text string, word_count int, noise string")
    cleaned = spark.createDataFrame([("s", 1, "x", 1, "3) vod je prešao rije-\nku"), ("s", 2, "x", 1, None)], "book string, page_number int, text string, word_count int, footnotes string")
    meta = spark.createDataFrame([("s", "Naslov knjige", None)], "book string, book_title string, source_pdf string")
    r = {(x.origin, x.book, x.page_number): x for x in scans.repaired(pages, cleaned, meta).collect()}
    assert set(r["pages", "s", 1].noise) == {"header", "hyphen", "misread", "number"}
    assert r["pages", "s", 1].text == line and r["pages", "g", 1].noise == []
    assert r["footnotes", "s", 1].noise == ["hyphen"] and r["pages", "s", 4].noise == []
    assert len(r) == 32
    assert scans.found(pages.limit(0), cleaned.limit(0), meta.limit(0)).count() == 0


def test_neighbours_count_the_same_however_many_words_are_contested(spark):
    texts = spark.createDataFrame([("u selu i na putu",), ("ii selu", ), ("u selu",), (None,)], "t string")
    contested = spark.createDataFrame([("ii", [("u",)])], "word string, others array<struct<word:string>>")
    one, two = ({tuple(r) for r in scans._pair_counts(texts, contested, n).collect()} for n in (100, 0))
    assert one == two == {("u", "selu", 2), ("ii", "selu", 1)}


def test_the_channel_reads_forms_no_word_of_the_corpus_explains():
    threes = Counter()
    for w in ["".join(x) for x in zip("sklpmtrvnb" * 9, "aeiou" * 18, "rlnmsk" * 15, "aeiouoiea" * 10)]:
        threes.update(f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))
    chances = {f"{a}>{b}": -8.0 for a, b in scans.CONFUSIONS}
    channel = scans.Channel(chances, scans.Letters(threes))
    assert scans._decode(["s@ra", "s1", "19aa", "sara", "s@ra!"], channel, {}, {}) == ["sara", "s1", "19aa", "sara", "sara!"]
    # without candidates for it a plain word stays what it is, and the more likely neighbour decides where there are some
    noted = {"ii": {"n": 40, "others": [{"word": "u", "n": 100_000, "chance": -8.0}], "contested": True, "kept": -5.0}}
    assert scans._decode(["ii", "selu"], channel, noted, {("u", "selu"): 4.0}) == ["u", "selu"]
    assert scans._decode(["ii", "kongres"], channel, noted, {("ii", "kongres"): 4.0}) == ["ii", "kongres"]


def test_forms_with_many_foreign_characters_are_read_among_all_readings():
    threes = Counter()
    for w in ("kilil", "milina", "lilika", "nikolili"):
        threes.update(f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))
    letters = scans.Letters(threes)
    channel = scans.Channel({f"{a}>{b}": -1.0 for a, b in scans.CONFUSIONS}, letters)
    for form in ("k1|1lm1l1n1k1|!l1k@!", "s@r|"):
        core = form.rstrip("!|")
        ways = ["".join(x) for x in itertools.product(*[[r for r, _ in channel.back.get(c, [(c, 0.0)])] for c in core])]
        best = max(ways, key=letters.score) + form[len(core) :]
        assert channel.states(form, {})[1][0] == best and (len(ways) > 64) == (len(form) > 10)


def test_unreadable_matter_of_a_larger_corpus_makes_misread_forms_no_words(spark):
    rng = random.Random(3)
    words = WORDS + ["".join(x) for x in itertools.product("mr", "ao", "mtpv", "aou", "ckm")]
    forms = sorted({f for w in WORDS for f in scans._misreadings(w) if f.isalpha()} - set(words))

    def kept(times: int) -> float:
        junk = {"".join(rng.choice("bcdfghjkmpqrstvz") for _ in range(8)) for _ in range(300 * times)}
        rows = [(w, 2000 * times) for w in words] + [(f, 2 * times) for f in forms] + [(w, 1) for w in junk]
        return scans._candidates(spark.createDataFrame(rows, "word string, n bigint"), times)[0].first().kept

    one = kept(1)
    assert one < -2 and abs(kept(20) - one) < 0.3


def test_every_misreading_has_the_key_of_its_word(spark):
    words = ["bataljon", "drveni", "umorna", "khlmnu", "čekić", "šumski", "hrvatska", "vezist"]
    pairs = [(w, f) for w in words for f in scans._misreadings(w)]
    df = spark.createDataFrame(pairs, "w string, f string")
    assert df.where(scans.confusable(F.col("w")) != scans.confusable(F.col("f"))).collect() == []


def test_encoding(spark):
    clean = "Žene otoka Čilodvor između građe ćelija šuma"
    docs = spark.createDataFrame([(clean,), (None,), ("",)], "text string")
    bad = {c: clean.split()[0].encode(c[0]).decode(c[1]) for c in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp1250", "latin-1"), ("cp852", "cp1250"))}
    rows = [(f"b{i}", v, None, 1) for i, v in enumerate(bad.values())] + [("ok", "Žene otoka? È Société", "C:/x/Žene.pdf", 1), ("nfd", "Z\u030cene", None, 1), ("q", "izme?u", "gra\ufffde.pdf", 1), ("q", "izme?u", "gra\ufffde.pdf", 1), (None, "x", None, 1)]
    meta = spark.createDataFrame(rows, "book string, book_title string, source_pdf string, chain int")
    r = {(x.book, x.field): x for x in encoding.restored(meta, [(docs, "text")]).collect()}
    assert set(r) == {(f"b{i}", "book_title") for i in range(4)} | {("q", "book_title"), ("q", "source_pdf")}
    assert {x.restored for x in r.values()} == {"Žene", "između", "građe.pdf"} and all(x.whole for x in r.values())
    assert encoding.found(meta.limit(0), [(docs, "text")]).count() == 0
    assert encoding.garble("šuma")["Å¡uma"] == "utf-8>cp1252"


def test_survivors(spark):
    rows = [
        movement(1, "1944", day=3), movement(2, "1944-01-02", lat=None), movement(3, " 2. 1. 1944.", "VÍS ", "napad na  most.", day=2, notes=None), movement(3, " 2. 1. 1944.", "VÍS ", "napad na  most.", day=2, notes=None),
        movement(4, "1944-01-03", ids=(2, 1, 1)), movement(5, None, ids=(9,)), movement(6, "1944-01-02", book=None), movement(7, place=None), movement(8, ids=None), movement(9, "1944-02-31", book="c"), movement(10, "1944-02", book="c"),
    ]
    df = spark.createDataFrame(rows, MOVEMENT)
    # the bare year links both days, so all are one group; the one of most sources among the complete ones survives
    assert sorted(tuple(r) for r in survivors.survivors(df).collect()) == [(1, 4), (9, 9)]
    best = {r.group_id: r for r in survivors.build_best(df).collect()}
    assert best[1].records == 4 and best[1].source_chunk_ids == [1, 2] and best[1].coordinates.lat == 43.0
    assert survivors.survivors(df.limit(0)).count() == 0
    hot = spark.createDataFrame([movement(i, "1944-01-02", day=1 + i % 20) for i in range(1, 400)], MOVEMENT)
    assert [tuple(r) for r in survivors.survivors(hot).collect()] == [(1, 19)]


def test_dates(spark):
    cases = {"1944-05-06": (1944, 5, 6), "6. 5. 1944.": (1944, 5, 6), "06.05.1944": (1944, 5, 6), "1944/05/06": (1944, 5, 6), "6 May 1944": (1944, 5, 6), "6. svibnja 1944.": (1944, 5, 6), "početkom svibnja 1944.": (1944, 5, None), "1944-05-00": (1944, 5, None), "1944-05": (1944, 5, None), "1944": (1944, None, None), "1944-13-01": (1944, None, None), "?": (None,) * 3, "": (None,) * 3, None: (None,) * 3}
    df = spark.createDataFrame([(c,) for c in cases], "d string")
    assert {r.d: tuple(r.p) for r in df.select("d", survivors.parse_date(F.col("d")).alias("p")).collect()} == cases


@pytest.mark.parametrize("cell_rows, vocabulary, spread", [(100_000, 1000, 4), (15, 1000, 4), (15, 1, 4), (100_000, 1000, 1)])
def test_near_records_are_those_of_all_pairs(spark, cell_rows, vocabulary, spread):
    rng = random.Random(7)
    base = [rng.sample(WORDS, rng.randint(3, 14)) for _ in range(25)]
    sets = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS + ["a", "b", "c"])
        sets.append((i, sorted({x + "q" * rng.randrange(spread) for x in w})))
    sets += [(900, []), (901, None), (902, sets[0][1]), (902, sets[0][1])]
    df = spark.createDataFrame(sets, "id bigint, words array<string>").dropDuplicates(["id"])
    pairs, members = near_records.similar_sets(df, cell_rows=cell_rows, max_vocabulary=vocabulary)
    rep = {r.id: r.rep for r in members.collect()}
    kept = {i: frozenset(w) for i, w in sets if w}
    assert rep == {i: min(j for j in kept if kept[j] == kept[i]) for i in kept}
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and 5 * len(kept[a] & kept[b]) >= 3 * len(kept[a] | kept[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and pairs.count() == len(want)


def test_a_hot_word_reports_its_pairs_once_beside_cold_words(spark):
    # twelve words in every record, so hot above 15 records; four of its own that share the cold cells with others'
    sets = [(i, sorted(WORDS[:12] + [f"r{i}x{k}" for k in range(4)])) for i in range(30)]
    pairs, _ = near_records.similar_sets(spark.createDataFrame(sets, "id bigint, words array<string>"), cell_rows=15)
    assert pairs.count() == pairs.distinct().count() == 30 * 29 // 2


def test_sets_of_any_size_are_compared(spark):
    rng = random.Random(17)
    sets = [(i, sorted({f"w{rng.randrange(30)}" for _ in range(n)})) for i, n in enumerate([1, 2, 3, 5, 8, 13, 21, 40, 80] * 30)]
    kept = {}
    for i, w in sets:
        kept.setdefault(frozenset(w), i)
    got = {(r.a, r.b, r.common) for r in near_records.similar_sets(spark.createDataFrame(sets, "id bigint, words array<string>"))[0].collect()}
    assert got == {(i, j, len(a & b)) for a, i in kept.items() for b, j in kept.items() if i < j and 5 * len(a & b) >= 3 * len(a | b)}


def test_lists_of_common_words_are_not_compared_pair_by_pair(monkeypatch):
    # 40 of 400 words each, so that every word stands in a tenth of the records; every fiftieth is a near copy
    rng, compared, entries = np.random.default_rng(5), [], []
    sets = [np.sort(rng.choice(400, 40, replace=False)) for _ in range(3000)]
    for i in range(50, 3000, 50):
        sets[i] = np.unique(np.append(rng.choice(sets[i - 1], 35, replace=False), rng.choice(400, 5)))
    some, level = near_records._Cell.some, near_records._Cell.level

    def counted(self, rec, at, node, k, cross, settled=False):
        n = np.unique(node, return_counts=True)[1]
        compared.append(int((n * (n - 1) // 2).sum()))
        return some(self, rec, at, node, k, cross, settled)

    monkeypatch.setattr(near_records._Cell, "some", counted)
    monkeypatch.setattr(near_records._Cell, "level", lambda self, key, k, cross: entries.append(len(key)) or level(self, key, k, cross))
    size = np.array([len(x) for x in sets])
    cell = near_records._Cell(np.arange(3000), np.zeros(3000, dtype=np.int64), np.concatenate(sets), size, size, near_records.THRESHOLD)
    got = {(a, b) for batch in cell.pairs(lambda w: w >= 0, False) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())}
    has = np.zeros((3000, 400), dtype=np.int32)
    has[np.repeat(np.arange(3000), size), np.concatenate(sets)] = 1
    common = has @ has.T
    want = np.argwhere(np.triu(5 * common >= 3 * (size[:, None] + size - common), 1))
    assert got == set(map(tuple, want.tolist())) and len(got) >= 59
    # a merge of the lists of all first words counts an occurrence for each pair of each of them
    first = np.bincount(np.concatenate([x[:17] for x in sets]))
    assert sum(compared) + sum(entries) < int((first * (first - 1) // 2).sum()) / 2


def test_packed_columns_come_back():
    columns = [np.array([-5, 0, 254, 255, 1 << 40]), np.array([], dtype=np.int64), np.arange(600)]
    assert [x.tolist() for x in near_records._unpacked(*near_records._packed(columns), 3)] == [x.tolist() for x in columns]


def test_near_pairs(spark):
    rows = [movement(1, notes="vod je prešao most"), movement(2, notes="Vod je prešao MOST!"), movement(3, notes="vod je presao most prije"), movement(4, notes=None), movement(5, notes=" "), movement(6, notes="nešto drugo " * 9, place="x", op="y"), movement(6, notes="nešto drugo " * 9, place="x", op="y")]
    df = spark.createDataFrame(rows, MOVEMENT)
    assert sorted(tuple(r) for r in near_records.near_pairs(df).collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(tuple(r) for r in near_records.near_pairs(df, expand=1).collect()) == [(1, 3)]
    assert sorted(tuple(r) for r in near_records.classes(df, expand=1).collect()) == [(1, 1, 2, False), (2, 1, 2, False), (3, 3, 1, True), (6, 6, 1, True)]
    assert {r.movement_id: (r.group_id, r.links) for r in near_records.near_groups(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (1, 1), 6: (6, 0)}
    assert near_records.near_pairs(df.limit(0)).count() == 0


def test_plan_uses_each_item_once():
    rng = random.Random(1)
    for _ in range(120):
        cap = rng.choice([4, 9, 40])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 90)))
        used: Counter = Counter()
        for lengths, times in packing.plan(counts, cap):
            assert sum(lengths) <= cap
            for n in lengths:
                used[n] += times
        assert used == counts
    assert packing.plan({6: 1, 4: 1, 3: 2}, 10) == [((4, 6)[::-1], 1), ((3, 3), 1)] or packing.plan({6: 1, 4: 1, 3: 2}, 10) == [((3, 3), 1), ((6, 4), 1)]


def test_packing(spark):
    sized = spark.createDataFrame([(1, 25), (2, 0), (3, None), (4, 10), (5, 5), (6, 5), (7, 3)], "doc_id bigint, tokens bigint")
    r = packing.pack(sized, 10).collect()
    room: Counter = Counter()
    for x in r:
        if x.window is not None:
            room[x.window] += x.tokens
    assert max(room.values()) <= 10 and len(room) == 5 and {x.doc_id for x in r} == set(range(1, 8))
    assert sorted((x.piece, x.tokens, x.start) for x in r if x.doc_id == 1) == [(0, 10, 0), (1, 10, 10), (2, 5, 20)]
    docs = spark.createDataFrame([(1, "jedan dva <|endoftext|>"), (2, None), (3, ""), (1, "jedan dva <|endoftext|>"), (None, "x")], "doc_id bigint, text string")
    assert {x.doc_id: x.window is None for x in packing.windows(docs).collect()} == {1: False, 2: True, 3: True}
    assert packing.pack(sized.limit(0), 10).count() == 0


def test_leakage(spark):
    rng = random.Random(4)
    text = lambda n: [f"{rng.choice(WORDS)}{rng.randint(0, 40)}" for _ in range(n)]
    item, other, filler = text(40), text(30), text(400)
    half = item[:26]
    half[9] = "zamjena"
    docs = [(1, " ".join(filler)), (2, " ".join(filler[:50] + item + filler[50:])), (3, ", ".join(filler[:20] + half).upper()), (4, " ".join(item[:15])), (5, " ".join(reversed(item))), (6, None), (7, ""), (2, " ".join(filler[:50] + item + filler[50:])), (8, " ".join(filler[:300] + item[:12] + filler + item[12:25]))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "dva"), (1, " ".join(item))], "item_id bigint, item_text string")
    assert sorted(tuple(r) for r in leakage.found(d, e).collect()) == [(2, 1), (3, 1)]
    assert leakage.found(d.limit(0), e).count() == 0 and leakage.found(d, e.limit(0)).count() == 0
    assert [tuple(r) for r in leakage.report(d, e).collect()] == [(1, 2, 1.0)]
    more = e.unionByName(spark.createDataFrame([(i, " ".join(filler[10 * i : 10 * i + 30])) for i in range(5, 12)], e.schema))
    assert sorted(map(tuple, leakage.leaks(d, more, block_chars=200).collect())) == sorted(map(tuple, leakage.leaks(d, more).collect()))


def test_the_longest_chain_is_that_of_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(3, 12)
        hits = sorted({(rng.randint(0, 20), rng.randint(0, n - 3)) for _ in range(rng.randint(1, 9))})

        def best(done):
            p, a, words = done[-1]
            on = [words]
            for x, y in hits:
                if x >= p + 3 and y >= a + 3:
                    on.append(best([*done, (x, y, words + 3)]))
                if 0 < x - p == y - a < 3:
                    on.append(best([*done, (x, y, words + x - p)]))
            return max(on)

        assert leakage._chain([p for p, _ in hits], [a for _, a in hits], n) == max(best([(p, a, 3)]) for p, a in hits)


@pytest.mark.parametrize("text, word, want", [
    ("Vod je prešao most. Zatim je čekao.", "čekao", {"mark": "stop", "token": "word", "style": "prose"}), ("Vod je prešao most. Zatim je če", "če", {"mark": "none", "sentence": "True"}),
    ("Vod je prešao most. Vodio ga je A.", "a", {"mark": "stop", "token": "initial"}), ("Vod je prešao most. Zatim je če...", "če", {"mark": "dots"}), ("Vod je pri\ufffd", "pri", {"mark": "lost"}),
    ("VOD JE PREŠAO VELIKI MOST U SELU STOP", "stop", {"style": "capitals", "capital": "2"}), ("Popis, Vis\n- Ban A. (kuhar)\n- Lul B. (vozar)\n- Rak C. (borac)", "borac", {"style": "lines", "seen": "True"}),
    ("Popis, Vis\n- Ban A. (kuhar)\n- Lul B. (vozar)\n- Rak C. (bo", "bo", {"seen": "False"}), ("Vod je prešao most.\n* * *", "", {"token": "none"}), ("x" * 200_000, "x" * 200_000, {"length": "1"}),
])
def test_traits_of_endings(text, word, want):
    found, f = terminality.traits(text)
    assert found == word and want.items() <= f.items()


def test_blank_texts_have_no_ending():
    assert terminality.traits("") is None and terminality.traits(" \n\t") is None
    assert list(terminality.closing_words("Vod je stao. Zatim (kod mora!) ide A. dalje")) == ["stao", "mora"]
    assert terminality.Terminality([], []).score([terminality.with_word(terminality.traits("a b")[1], 0, 0, 0)]).tolist() == [0.0]


def test_endings_are_learnt_from_the_texts_themselves(spark):
    rng = random.Random(16)
    last = ["kiše", "mraka", "jutra", "zore"]
    sentence = lambda: f"{rng.choice(WORDS).capitalize()} {rng.choice(WORDS)} je {rng.choice(WORDS)} na {rng.choice(WORDS)} do {rng.choice(last)}."
    roll = lambda: "\n".join(["Popis"] + [f"- {rng.choice(WORDS).capitalize()} {rng.choice('ABCD')}. ({rng.choice(WORDS)})" for _ in range(9)])
    texts = [" ".join(sentence() for _ in range(rng.randint(5, 9))) for _ in range(400)] + [roll() for _ in range(100)]
    cut = set(range(0, 500, 20))
    docs = [(i, t[: -rng.randint(3, 9)] if i in cut else t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id for r in truncation.found(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert len(got & cut) >= 23 and len(got - cut) <= 5


def test_truncation(spark):
    rng = random.Random(6)
    body = " ".join(f"{rng.choice(WORDS)}{chr(97 + i % 26)}{rng.choice(WORDS)}" for i in range(120))
    sentence = "Vod je prešao most. Zatim je četa čekala na greben."
    docs = [(1, "s", body + " na kraju"), (2, "s", body + " na kra"), (3, "s", sentence), (4, "s", sentence[:-4]), (5, None, None), (6, "s", ""), (3, "s", sentence), (None, "s", "x")]
    df = spark.createDataFrame([(i, t, s, 1) for i, s, t in docs], "doc_id bigint, text string, source string, reason int")
    r = {x.doc_id: x.reason for x in truncation.endings(df).collect()}
    assert r[2] == "copy" and r[3] is None and r[5] is None and r[6] is None and len(r) == 6
    shares = {x.source: (x.documents, x.cut) for x in truncation.by_source(df).collect()}
    assert shares[None] == (1, 0) and shares["s"][0] == 5
    assert truncation.found(df.limit(0)).count() == 0


def test_a_cut_is_found_beside_a_longer_copy_that_reads_otherwise(spark):
    rng = random.Random(6)
    body = " ".join(f"{rng.choice(WORDS)}{chr(97 + i % 26)}{rng.choice(WORDS)}" for i in range(3000))
    other = "Vis je otok na moru"
    docs = [(1, body + " na Visu"), (2, body + " na Vis"), (3, body + " kod Komiže i Visa toga dana"), (4, other), (5, body + " na Vis")]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id bigint, text string, source string")
    r = {x.doc_id: x.reason for x in truncation.endings(df).collect()}
    assert r[2] == r[5] == "copy" and r[1] != "copy" and r[3] != "copy"
