"""Problem 9: texts cut off by a field limit or a broken transfer.

Near-copies are found by min-hash banding and verified; where the text of one ends while its copy goes on
inside the word or sentence, it is cut. Texts without such a copy are scored by how they close: a model learnt
from the corpus weighs the closing word, by what the corpus says of it, in the manner of the text (see `terminality`).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronika.llm.terminality import Terminality, closing_words, stopped, traits, with_word
from kronika.session import durable

SHINGLE, SIMILAR = 5, 0.8
#: Bands of rows: two texts of a similarity of 0.8 share a band with a chance of 0.9998.
BANDS, ROWS = 16, 4
#: Documents the model of endings is fitted on, about; all others are scored by it.
SAMPLE = 12_000
#: Score from which a text is cut, and from which its ending is open.
CUT, OPEN = 1.5, -1.0
#: A length is a limit of its source where that share of its texts, and at least so many, have it with an open
#: ending; a text of that length is so much likelier to be cut.
LIMIT_SHARE, LIMIT_ROWS, LIMIT_SCORE = 0.03, 3, 4.0
#: Ids of texts with near-copies that travel with the tasks; more are joined.
MAX_NEAR = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")

_rng = np.random.default_rng(9)
_A = _rng.integers(1, 2**61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**61, BANDS * ROWS, dtype=np.uint64)


def _bands(texts: list[list[str]]) -> list[np.ndarray | None]:
    """Band hashes of each text, given by its words; none for texts of fewer words than a shingle has."""
    weights = np.array([1000003**i % 2**61 for i in range(SHINGLE)], dtype=np.uint64)
    number: dict[str, int] = {}
    out: list[np.ndarray | None] = []
    for w in texts:
        if len(w) < SHINGLE:
            out.append(None)
            continue
        for x in w:
            if x not in number:  # most words of a batch come again
                number[x] = zlib.crc32(x.encode())
        h = np.array([number[x] for x in w], dtype=np.uint64)
        n = len(w) - SHINGLE + 1
        s = np.zeros(n, dtype=np.uint64)
        for i in range(SHINGLE):
            s += h[i : i + n] * weights[i]
        s ^= s >> np.uint64(29)
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for lo in range(0, n, 4096):
            low = np.minimum(low, (s[lo : lo + 4096, None] * _A + _B).min(axis=0))
        band = low.reshape(BANDS, ROWS)
        mixed = np.zeros(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            mixed = (mixed ^ band[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        out.append(mixed.astype(np.int64))
    return out


def _scan(documents: DataFrame, rate: float) -> DataFrame:
    """One pass over the texts: rows of documents (their ending and bands), of made cuts (their ending; of that share of the
    documents) and of words (their uses inside texts, before the end of sentences and at the end of texts, summed over the batch)."""
    schema = "kind string, id bigint, source string, length int, word string, traits map<string,string>, bands array<bigint>, n bigint, closing bigint, ends bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["t"].tolist()
            inside, closing, ends = Counter(), Counter(), Counter()
            rows = []
            words = [_WORD.findall(t.lower()) if t else [] for t in texts]
            for i, source, t, w, bands in zip(b["id"], b["source"], texts, words, _bands(words)):
                found = traits(t) if t else None
                word, f = found or (None, None)
                rows.append(("text", i, source, len(t) if t else 0, word, f, bands, 0, 0, 0))
                if found is None:
                    continue
                inside.update(w[:-1])  # the last word of a text may be a part of one
                ends.update(w[-1:])
                closing.update(closing_words(t))
                if zlib.crc32(b"sample%d" % i) < rate * 2**32:
                    word, f = traits(stopped(i, t)) or (None, None)
                    rows.append(("cut", i, None, 0, word, f, None, 0, 0, 0))
            rows += [("word", None, None, 0, w, None, None, inside[w], closing[w], ends[w]) for w in {*inside, *ends}]
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(id=out["id"].astype("Int64"))

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), "source", F.col("text").alias("t"))
    return rows.mapInPandas(run, schema)


def _places(texts: DataFrame) -> DataFrame:
    """`(sha, t)` to rows of ends (`last`: the closing word; key: the shingle before it) and of places (`next`: the word behind
    the last place of the shingle `key`, and whether the sentence goes on behind that word). n: shingles of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for lo in range(0, len(f), 64):
                rows = []
                for sha, t in zip(f["sha"][lo : lo + 64], f["t"][lo : lo + 64]):
                    t = t.lower()
                    spans = [m.span() for m in _WORD.finditer(t)]
                    w = [t[a:b] for a, b in spans]
                    if len(w) <= SHINGLE:
                        continue
                    last = {zlib.crc32(" ".join(w[i : i + SHINGLE]).encode()): i + SHINGLE for i in range(len(w) - SHINGLE + 1)}
                    n = len(last)
                    rows.append((sha, zlib.crc32(" ".join(w[-SHINGLE - 1 : -1]).encode()), w[-1], None, None, n))
                    for key, p in last.items():
                        if p < len(w):
                            more = p + 1 < len(w) and not re.search(r"[.!?…\n]", t[spans[p][1] : spans[p + 1][0]])
                            rows.append((sha, key, None, w[p], more, n))
                yield pd.DataFrame(rows, columns=["sha", "key", "last", "next", "more", "n"])

    return texts.mapInPandas(run, "sha string, key bigint, last string, next string, more boolean, n int")


def _goes_on(pairs: DataFrame) -> DataFrame:
    """`(id, a, b)`, texts of near-copies, to `(id, cut)`: whether a ends where b goes on inside a word or sentence."""

    def one(a: str, b: str) -> bool:
        wa, wb = _WORD.findall(a.lower()), _WORD.findall(b.lower())
        sa = {tuple(wa[i : i + SHINGLE]) for i in range(len(wa) - SHINGLE + 1)}
        sb = {tuple(wb[i : i + SHINGLE]) for i in range(len(wb) - SHINGLE + 1)}
        both = len(sa & sb)
        if both < SIMILAR * (len(sa) + len(sb) - both):
            return False
        # the words before the closing one, which may be a part of a word, lie together in b: the last such place
        key = wa[-SHINGLE - 1 : -1]
        at = [i + SHINGLE for i in range(len(wb) - SHINGLE + 1) if wb[i : i + SHINGLE] == key]
        if len(key) < SHINGLE or not at:
            return False
        p = at[-1]
        if p >= len(wb) or not wb[p].startswith(wa[-1]):
            return False
        if len(wb[p]) > len(wa[-1]):
            return True
        if p + 1 >= len(wb):
            return False
        spans = list(_WORD.finditer(b.lower()))
        return not re.search(r"[.!?…\n]", b[spans[p].end() : spans[p + 1].start()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame({"id": f["id"], "aligned": [one(a, b) for a, b in zip(f["a"], f["b"])]})

    return pairs.mapInPandas(run, "id string, aligned boolean")


def _scored(scan: DataFrame, uses: DataFrame, rate: float) -> DataFrame:
    """`(id, source, length, score)` of the texts that are not blank. The model is fitted on the sample, on the driver."""
    known = scan.where("traits is not null").join(uses, "word", "left").select(
        "kind", "id", "source", "length", "traits", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("uses", "closings", "at_end")]
    )
    known = durable(known)
    drawn = F.crc32(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary")) < rate * 2**32
    sample = known.where((F.col("kind") == "cut") | drawn).orderBy("id", "kind", "length").collect()  # about 2 * SAMPLE rows
    full = lambda r: with_word(r["traits"], r["uses"], r["closings"], r["at_end"])
    model = Terminality([full(r) for r in sample if r["kind"] == "text"], [full(r) for r in sample if r["kind"] == "cut"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [with_word(dict(t), u, c, e) for t, u, c, e in zip(b["traits"], b["uses"], b["closings"], b["at_end"])]
            yield b[["id", "source", "length"]].assign(score=model.score(f))

    return known.where("kind = 'text'").drop("kind").mapInPandas(score, "id bigint, source string, length int, score double")


def endings(documents: DataFrame) -> DataFrame:
    """`(doc_id, source, length, cut, reason)` of every document. reason: 'copy', 'ending', 'limit', or null where the text
    is whole. Null, empty and blank texts are whole; an id given twice counts once, and is cut where one of its texts is.
    Of a few dozen texts no manner of closing can be learnt: only copies are found.

    A text is held against every near-copy that goes on where it ends: exact copies are one text, and the last whole
    words of each text are looked up among the shingles of all texts that share a bucket of the banding with any other.
    """
    rate = min(1.0, SAMPLE / max(1, documents.count()))
    scan = durable(_scan(documents, rate))
    docs = scan.where("kind = 'text'")
    uses = scan.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("uses"), F.sum("closing").alias("closings"), F.sum("ends").alias("at_end"))
    # near-copies
    band = docs.where("bands is not null").select("id", F.posexplode("bands").alias("band", "h"))
    shared = band.groupBy("band", "h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band", "h")
    near = durable(band.join(shared, ["band", "h"], "left_semi").select("id").distinct())
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("t")).where("text is not null")
    few = near.count() <= MAX_NEAR  # 8 bytes each: the texts of the others need not be moved
    held = durable(texts.join(F.broadcast(near) if few else near, "id", "left_semi").withColumn("sha", F.sha2("t", 256)))
    once = held.groupBy("sha").agg(F.first("t").alias("t"))
    places = durable(_places(once))
    ends = places.where("last is not null").select(F.col("sha").alias("id"), "key", "last", F.col("n").alias("m"))
    on = places.where("next is not null").select(F.col("sha").alias("other"), "key", "next", "more", "n")
    goes = F.col("next").startswith(F.col("last")) & (F.col("more") | (F.length("next") > F.length("last")))
    fits = F.least("m", "n") >= F.lit(SIMILAR) * F.greatest("m", "n") - 1  # one less for shingles of the same sum
    # first the ways in which any text goes on there, which are few where many copies end alike; then the texts that go on so
    ways = ends.join(on.select("key", "next", "more").distinct(), "key").where(goes)
    pairs = durable(ways.join(on, ["key", "next", "more"]).where((F.col("id") != F.col("other")) & fits).select("id", "other").distinct())
    matched = pairs.join(once.select(F.col("sha").alias("id"), F.col("t").alias("a")), "id").join(once.select(F.col("sha").alias("other"), F.col("t").alias("b")), "other")
    cut = _goes_on(matched.select("id", "a", "b")).where("aligned").select(F.col("id").alias("sha")).distinct()
    aligned = held.join(cut, "sha", "left_semi").select("id", F.lit(True).alias("aligned")).distinct()
    # endings, and lengths at which a source cuts
    scored = durable(_scored(scan, uses, rate))
    per = scored.groupBy("source", "length").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("score") > OPEN).alias("open"))
    every = docs.groupBy("source").agg(F.count(F.lit(1)).alias("all"))
    limits = per.join(every, "source").where(
        (F.col("open") >= LIMIT_ROWS) & (F.col("open") >= LIMIT_SHARE * F.col("all")) & (F.col("open") >= 0.5 * F.col("k"))
    ).select("source", "length", F.lit(True).alias("limit"))
    judged = scored.join(limits, ["source", "length"], "left").join(aligned, "id", "left")
    reason = (
        F.when(F.col("aligned"), "copy").when(F.col("score") > CUT, "ending").when(F.col("limit") & (F.col("score") > CUT - LIMIT_SCORE), "limit")
    )
    blank = docs.where("traits is null").select("id", "source", "length", F.lit(None).cast("string").alias("reason"))
    out = judged.select("id", "source", "length", reason.alias("reason")).unionByName(blank)
    return out.groupBy(F.col("id").alias("doc_id")).agg(
        F.max("source").alias("source"), F.max("length").alias("length"), F.max("reason").alias("reason")
    ).withColumn("cut", F.col("reason").isNotNull())


def found(documents: DataFrame) -> DataFrame:
    return endings(documents).where("cut").select("doc_id")


def by_source(documents: DataFrame) -> DataFrame:
    """How many texts each source has, how many of them are cut, and their share. A null source is one of its own."""
    return endings(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut"), (F.count_if("cut") / F.count(F.lit(1))).alias("share")
    )
