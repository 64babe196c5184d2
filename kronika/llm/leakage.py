"""Problem 8: evaluation texts that turn up in documents.

A prefix-filtered set join. An item is the set of its shingles of three words. A passage that repeats more
than half of the item's words in runs of three and more has at least a third of as many of its shingles.
So, with the item's shingles ordered by their rarity in the corpus, a document without any of the rarest
of them, all but as many as must be shared less one, can't hold such a passage: the pairs to look at come
from a join on these prefix shingles alone. A bound by position follows, the words in runs that lie within
one window of twice the item's length. What is left is verified exactly, word by word and in order.

Documents are read and cut into words once; what goes on is, for each document that could hold a passage
of any item at all, the places of item shingles in it. Items travel with the tasks in blocks of bounded
size, one such pass for each block, so that no number of items is too large.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronika.session import durable

#: Words of a shingle, and the shortest run that counts. The similarity of 0.8 on five words, meant for
#: near-duplicate texts, does not hold here: half of the words in short runs are a case.
SHINGLE = 3
#: Share of an item's words that must be passed, and the window in item lengths.
SHARE, WINDOW = 0.5, 2
#: Characters of items that travel with the tasks of one pass; more items make more passes.
BLOCK_CHARS = 8_000_000

_MARKS = re.compile("[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃰︠-︯]+")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words in lower case, without accents and marks, across line breaks."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """Items as arrays. A shingle is the number of its first two words' pair, and of that and the third word."""

    ids: np.ndarray
    length: np.ndarray
    vocabulary: dict[str, int]
    pairs: np.ndarray  # distinct pairs of words that open a shingle, sorted
    keys: np.ndarray  # distinct shingles, sorted
    offset: np.ndarray  # of a shingle in item and at
    item: np.ndarray
    at: np.ndarray

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, shingle) of every item shingle in the texts."""
        get = self.vocabulary.get
        numbers: list[int] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        for r, t in enumerate(texts):
            numbers.extend([get(x, -1) for x in words_of(t)])
            numbers.append(-1)  # no shingle runs into the next text
            ends[r + 1] = len(numbers)
        w = np.array(numbers, dtype=np.int64)
        v = len(self.vocabulary)
        on = np.flatnonzero((w[:-2] >= 0) & (w[1:-1] >= 0) & (w[2:] >= 0))
        on, p = _lookup(self.pairs, w[on] * v + w[on + 1], on)
        on, s = _lookup(self.keys, p * v + w[on + 2], on)
        row = np.searchsorted(ends, on, side="right") - 1
        return row, on - ends[row], s


def _lookup(table: np.ndarray, keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of `of` whose key is in the sorted table, and its place there."""
    if not len(table) or not len(keys):
        return of[:0], keys[:0]
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    ok = table[at] == keys
    return of[ok], at[ok]


def _rows(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("i")).agg(F.max(text).alias("t"))


def make_items(texts: list[tuple[int, str | None]]) -> Items:
    """Texts of fewer than three words are left out."""
    kept = [(i, w) for i, t in texts if len(w := words_of(t)) >= SHINGLE]
    vocabulary: dict[str, int] = {}
    for _, w in kept:
        for x in w:
            vocabulary.setdefault(x, len(vocabulary))
    v, none = len(vocabulary), np.array([], dtype=np.int64)
    first, third, item, at = [none], [none], [none], [none]
    for n, (_, w) in enumerate(kept):
        x = np.array([vocabulary[y] for y in w], dtype=np.int64)
        first.append(x[:-2] * v + x[1:-1])
        third.append(x[2:])
        item.append(np.full(len(x) - 2, n))
        at.append(np.arange(len(x) - 2))
    pairs, p = np.unique(np.concatenate(first), return_inverse=True)
    k, i, a = p * v + np.concatenate(third), np.concatenate(item), np.concatenate(at)
    by = np.lexsort((a, i, k))
    keys, start = np.unique(k[by], return_index=True)
    ids, length = np.array([i for i, _ in kept], dtype=np.int64), np.array([len(w) for _, w in kept], dtype=np.int64)
    return Items(ids, length, vocabulary, pairs, keys, np.append(start, len(k)), i[by], a[by])


def prefixes(items: Items, frequency: np.ndarray) -> np.ndarray:
    """For each entry (item, position) of the items whether its shingle is one of the item's rarest, which a case must share."""
    shingle = np.repeat(np.arange(len(items.keys)), np.diff(items.offset))
    chosen = np.zeros(len(shingle), dtype=bool)
    by = np.argsort(items.item, kind="stable")
    ends = np.searchsorted(items.item[by], np.arange(len(items.ids) + 1))
    for n in range(len(items.ids)):
        mine = by[ends[n] : ends[n + 1]]
        distinct = np.unique(shingle[mine])
        # more than half of the words, three to a shingle at the worst; a word may stand in the item twice
        must = max(1, int(np.floor(items.length[n] * SHARE / SHINGLE)) + 1 - (len(mine) - len(distinct)))
        keep = max(1, len(distinct) - must + 1)
        rare = distinct[np.lexsort((distinct, frequency[distinct]))][:keep]
        chosen[mine] = np.isin(shingle[mine], rare)
    return chosen


def passage(places: np.ndarray, at: np.ndarray, length: int) -> int:
    """Most words of an item, in its order and in runs, in one window of a document; hits sorted by (place, at)."""
    best, span = 0, WINDOW * length
    end = np.searchsorted(places, places + span - SHINGLE, side="right").tolist()
    fresh = np.flatnonzero(np.diff(places, prepend=-1)).tolist()
    p, a = places.tolist(), at.tolist()
    for s in fresh:
        e = end[s]
        covered = np.zeros(length, dtype=bool)
        for i in range(SHINGLE):
            covered[at[s:e] + i] = True
        if np.count_nonzero(covered) > best:
            best = max(best, _chain(p[s:e], a[s:e], length))
    return best


def _chain(p: list[int], a: list[int], length: int) -> int:
    """Most words in a chain of runs that go up in place and item: a run's next shingle adds what is new in it, a
    later run all of its words. The best chain up to each place of the item is kept as prefix maxima in a tree."""
    tree = [0] * (length + 1)
    waiting = 0
    score: list[int] = []
    runs: dict[int, tuple[int, int]] = {}  # by diagonal: the last shingle's place and score
    for k, (x, y) in enumerate(zip(p, a)):
        while p[waiting] + SHINGLE <= x:
            i = a[waiting] + SHINGLE
            while i <= length:
                if tree[i] < score[waiting]:
                    tree[i] = score[waiting]
                i += i & -i
            waiting += 1
        most, i = 0, y
        while i:
            most = max(most, tree[i])
            i -= i & -i
        own = most + SHINGLE
        before = runs.get(x - y)
        if before and x - before[0] < SHINGLE:
            own = max(own, before[1] + x - before[0])
        runs[x - y] = (x, own)
        score.append(own)
    return max(score)


def _entries(offset: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each shingle, and which hit each belongs to."""
    k = offset[s + 1] - offset[s]
    hit = np.repeat(np.arange(len(s)), k)
    return offset[s][hit] + np.arange(len(hit)) - (np.cumsum(k) - k)[hit], hit


def _verified(known: Items, rare: np.ndarray, row: np.ndarray, place: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Hits of some documents to (row, item, words, length) of each pair that is a case."""
    # the prefix join: only prefix shingles make pairs
    first = np.concatenate(([0], np.cumsum(rare)))[known.offset]
    some = np.flatnonzero(rare)
    n = len(known.ids)
    e, hit = _entries(first, s)
    pairs = np.unique(row[hit] * n + known.item[some[e]])
    if not len(pairs):
        return
    mine = np.zeros(row[-1] + 1, dtype=bool)
    mine[pairs // n] = True
    mine = mine[row]
    row, place, s = row[mine], place[mine], s[mine]
    e, hit = _entries(known.offset, s)
    item = known.item[e]
    pair = row[hit] * n + item
    ok, _ = _lookup(pairs, pair, np.arange(len(pair)))
    pair, item, place, at = pair[ok], item[ok], place[hit[ok]], known.at[e[ok]]
    by = np.lexsort((at, place, pair))
    pair, item, place, at = pair[by], item[by], place[by], at[by]
    # bound by position: a run's first shingle stands for three words, every other for one
    far = np.int64(place.max() + WINDOW * known.length.max() + 2)
    diagonal = (pair * far + place) * (known.at.max() + 2) + at
    goes_on = np.zeros(len(pair), dtype=bool)
    goes_on[_lookup(np.sort(diagonal + known.at.max() + 3), diagonal, np.arange(len(pair)))[0]] = True
    total = np.cumsum(np.where(goes_on, 1, SHINGLE))
    here = pair * far + place
    last = np.searchsorted(here, here + WINDOW * known.length[item] - SHINGLE, side="right") - 1
    # a window may start inside a run
    most = total[last] - total + SHINGLE
    for g in np.unique(pair[most > known.length[item] * SHARE]):
        lo, hi = np.searchsorted(pair, g), np.searchsorted(pair, g, side="right")
        length = int(known.length[item[lo]])
        w = passage(place[lo:hi], at[lo:hi], length)
        if w > length * SHARE:
            yield int(g // n), int(g % n), w, length


def _leaks(docs: DataFrame, known: Items) -> DataFrame:
    shortest = float(known.length.min()) * SHARE if len(known.ids) else 0.0
    longest = int(known.length.max()) * WINDOW if len(known.ids) else 0

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, place, s = known.hits(b["t"].tolist())
            total = np.bincount(s, minlength=len(known.keys))
            # words of item shingles in a window of the longest item: with fewer than the shortest needs, a text holds no passage
            key = row * 2**40 + place
            total_words = np.cumsum(np.minimum(np.diff(key, append=2**62), SHINGLE))
            last = np.searchsorted(key, key + longest, side="right") - 1
            able = np.unique(row[total_words[last] - total_words + SHINGLE > shortest])
            edge = np.searchsorted(row, np.arange(len(b) + 1))
            ids = b["d"].to_numpy()
            out = [(ids[r], place[edge[r] : edge[r + 1]].astype("<i4").tobytes(), s[edge[r] : edge[r + 1]].astype("<i4").tobytes()) for r in able]
            has = np.flatnonzero(total)
            out.append((None, total[has].astype("<i8").tobytes(), has.astype("<i4").tobytes()))
            f = pd.DataFrame(out, columns=["d", "place", "s"])
            yield f.assign(d=f["d"].astype("Int64"))

    hits = durable(docs.mapInPandas(scan, "d bigint, place binary, s binary"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(known.keys), dtype=np.int64)
        for b in batches:
            for n, s in zip(b["place"], b["s"]):
                total[np.frombuffer(s, "<i4")] += np.frombuffer(n, "<i8")
        has = np.flatnonzero(total)
        yield pd.DataFrame({"s": has.astype("int32"), "n": total[has]})

    frequency = np.zeros(len(known.keys), dtype=np.int64)
    counts = hits.where("d is null").drop("d").mapInPandas(add, "s int, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # one row per item shingle
        frequency[r["s"]] = r["n"]
    rare = prefixes(known, frequency)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [len(x) // 4 for x in b["s"]]
            row = np.repeat(np.arange(len(b)), each)
            place, s = (np.frombuffer(b"".join(b[c]), "<i4").astype(np.int64) for c in ("place", "s"))
            ids = b["d"].to_numpy()
            out = [(ids[r], known.ids[i], w, length) for r, i, w, length in _verified(known, rare, row, place, s)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "words", "item_words"])

    return hits.where("d is not null").mapInPandas(find, "doc_id bigint, item_id bigint, words int, item_words int")


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`(doc_id, item_id, words, item_words)`: documents with a passage that repeats more than half of an item's
    words. Null ids and null, empty and very short texts hold and are none; a document or item given twice counts
    once (an item with the greater of its texts). Empty tables give no row.
    """
    rows = _rows(items, "item_id", "item_text")
    docs = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("d"), F.col(text).alias("t"))
    blocks = max(1, -(-(rows.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    parts = []
    for n in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n).orderBy("i").collect()
        parts.append(_leaks(docs, make_items([(r["i"], r["t"]) for r in mine])))
    hits = reduce(DataFrame.unionByName, parts)
    return hits.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.first("item_words").alias("item_words"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per leaked item: in how many documents, and the largest share of it that one gives away."""
    return leaks(documents, items).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.max(F.col("words") / F.col("item_words")).alias("largest_share")
    )
