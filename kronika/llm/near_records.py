"""Problem 6: records that share most of their words, found by the words they share first.

A record is the set of its words, held as ranks in one order, rarest first. Two sets r and s have a Jaccard
similarity of t or more exactly when they share T = ceil(t / (1 + t) * (|r| + |s|)) words. The k-th word that such
a pair shares stands in r behind at most |r| - T others that s lacks, and likewise in s. So every record goes to
the cells of its |r| - ceil(t * |r|) + 1 first words. There the records with a word are a node. As long as a node
has many pairs its records are told apart by the next word they share, within those bounds: a node then stands for
the first k words that its records have in common, and few records share three or four that are not near, however
common each word is. Records that can reach no other of their node by size are dropped on the way. The pairs of
nodes that are small, or that a further word doesn't tell apart, are compared: by parities of their words, which
can only err towards similar, then word by word, and a pair is kept when it reaches T.

A cell never holds more than a bounded number of records of one word: a list above the bound is laid out as
blocks, and each pair of blocks is a cell of its own. No list, record or partner is left out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronika.functions import text as T
from kronika.llm.components import components
from kronika.session import durable

THRESHOLD = Fraction(3, 5)
#: Records a cell holds at most of one word, and from which a list is laid out in blocks.
CELL_ROWS = 400_000
#: Entries of nodes that are looked at together, pairs that are compared at once, and pairs that are probed at once.
BATCH, PAIRS, PROBES = 1 << 17, 1 << 16, 1 << 16
#: A node is told apart by a further word when it has more pairs than so many times the entries this makes.
LEAF = 8
#: Nodes made by a further word have together more than so many times the pairs when their records are alike.
ALIKE = 2
#: Words whose ranks travel with the tasks; a larger vocabulary is joined.
MAX_VOCABULARY = 1 << 20
#: Groups of exact copies up to this size are written out as pairs.
EXPAND_COPIES = 1_000

_WORD = re.compile(r"[^\W_]+")


@lru_cache(1 << 18)
def _words(token: str) -> list[str]:
    """Words of a stretch of text without white space, in lower case."""
    if not token.isascii():
        token = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
    return _WORD.findall(token)


def words_of(text: str | None) -> list[str]:
    """Distinct runs of letters and digits, in lower case and without combining marks, sorted."""
    words = set()
    for token in set((text or "").lower().split()):
        words.update(_words(token))
    return sorted(words)


def texts_of(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`(id, words)`, words being the text of the columns taken together."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.concat_ws(" ", *columns).alias("words"))


def _sets(batch: pa.RecordBatch) -> list[list[str]]:
    values = batch.column("words").to_pylist()
    if pa.types.is_list(batch.schema.field("words").type):
        return [sorted({x for x in v or () if x is not None}) for v in values]
    return [words_of(v) for v in values]


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(words).encode(), digest_size=16).digest()


def _needed(total: np.ndarray, t: Fraction) -> np.ndarray:
    """Smallest number of shared words for sets of together `total` words, in whole numbers."""
    p, q = t.numerator, t.numerator + t.denominator
    return -((-p * total) // q)


def _least(size: np.ndarray, t: Fraction) -> np.ndarray:
    """Words that a record must share with any partner, and the least size of one."""
    return -((-t.numerator * size) // t.denominator)


def _ranges(lo: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo, lo + 1, ... of each range, one after another, and which range each number is of."""
    which = np.repeat(np.arange(len(lo)), length)
    return np.arange(len(which)) + (lo - (np.cumsum(length) - length))[which], which


class _Cell:
    """Records of one cell, by size; finds the pairs whose first common word is one of the cell's own.

    Of a record of `size` words the last `held` are here; those before the first of the cell's own are left out."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, flat: np.ndarray, held: np.ndarray, size: np.ndarray, t: Fraction) -> None:
        by = np.lexsort((ids, size))
        at, owner = _ranges((np.cumsum(held) - held)[by], held[by])
        self.number, self.ids, self.block, self.held, self.size = flat[at], ids[by], block[by], held[by], size[by]
        self.start = np.cumsum(self.held) - self.held
        self.base = self.start - (self.size - self.held)  # where the first word of all would be
        if len(flat) and self.number.max() >= MAX_VOCABULARY:
            self.words, self.number = np.unique(self.number, return_inverse=True)
        else:
            self.words = np.arange(self.number.max(initial=0) + 1)
        self.number = self.number.astype(np.int32)
        self.t, self.least = t, _least(self.size, t)
        largest = int(self.size.max(initial=0))
        self.need = _needed(np.arange(2 * largest + 1), t)
        self.bits = int(largest).bit_length(), len(by).bit_length(), len(self.words).bit_length()
        # parities of 128 buckets each: a bucket that differs stands for a word that only one of two records has
        self.marks = [np.zeros(len(by), dtype=np.uint64) for _ in range(4)]
        for lo in range(0, len(by), BATCH >> 4):
            hi = min(len(by), lo + (BATCH >> 4))
            s, e = self.start[lo], self.start[hi - 1] + self.held[hi - 1]
            mark = self.number[s:e].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for n, shift in enumerate((57, 36)):
                bucket = (mark >> np.uint64(shift)) & np.uint64(127)
                one = np.uint64(1) << (bucket & np.uint64(63))
                for half in (0, 1):
                    self.marks[2 * n + half][lo:hi] = np.bitwise_xor.reduceat(np.where(bucket >> np.uint64(6) == half, one, np.uint64(0)), self.start[lo:hi] - s)

    def reach(self, size: np.ndarray, missed: np.ndarray) -> np.ndarray:
        """The largest partner with which a record that shares all but `missed` words can still have enough in common."""
        p, q = self.t.numerator, self.t.numerator + self.t.denominator
        return (q * (size - missed) - p * size) // p

    def some(self, rec: np.ndarray, at: np.ndarray, node: np.ndarray, k: int, cross: bool, settled: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of every node that can be near; with `settled` only those for which k words are enough."""
        edge = np.flatnonzero(_changes(node))
        before = np.arange(len(node)) - np.repeat(edge, np.diff(np.append(edge, len(node))))
        size, held = self.size[rec], self.held[rec]
        far = self.reach(size, at + 1 - k)
        marks = [m[rec] for m in self.marks]
        work = np.cumsum(before)
        lo = 0
        while lo < len(rec):
            hi = max(lo + 1, int(np.searchsorted(work, work[lo] + PAIRS, side="right")))
            j, i = _ranges(np.arange(lo, hi) - before[lo:hi], before[lo:hi])
            i += lo
            ok = np.flatnonzero((far[j] >= size[i]) & (far[i] >= size[j]))
            i, j = i[ok], j[ok]
            need = self.need[size[i] + size[j]]
            if settled:
                i, j, need = i[need <= k], j[need <= k], need[need <= k]
            if cross:
                ok = np.flatnonzero(self.block[rec[i]] != self.block[rec[j]])
                i, j, need = i[ok], j[ok], need[ok]
            most = held[i] + held[j] - 2 * need
            for low, high in (marks[:2], marks[2:]):
                ok = np.flatnonzero(np.bitwise_count(low[i] ^ low[j]) + np.bitwise_count(high[i] ^ high[j]) <= most)
                i, j, most = i[ok], j[ok], most[ok]
            yield rec[i], rec[j]
            lo = hi

    def level(self, key: np.ndarray, k: int, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`key`: sorted entries, each a node, a record of it and the place of its k-th word shared there. The records of
        a node share k words; those of two that can be near are compared when they are few, else told apart by the next."""
        pb, rb, wb = self.bits
        at, rec, node = key & ((1 << pb) - 1), (key >> pb) & ((1 << rb) - 1), key >> (pb + rb)
        new = _changes(node)
        alone = new.copy()
        alone[:-1] &= new[1:]
        at, rec, node = at[~alone], rec[~alone], np.cumsum(new[~alone])
        if not len(rec):
            return
        # the smallest record of the node that reaches this one's size; records are by size
        size = self.size[rec]
        far = self.reach(size, at + 1 - k)
        wide = 1 << (pb + 2)
        top = np.maximum.accumulate(node * wide + np.minimum(far, wide - 1))
        partner = np.minimum(np.searchsorted(top, node * wide + size), len(rec) - 1)
        low = np.maximum(size[partner], self.least[rec])
        alive = (far >= low) & (node[partner] == node)
        at, rec, node, size, low = at[alive], rec[alive], node[alive], size[alive], low[alive]
        if not len(rec):
            return
        new = _changes(node)
        edge, node = np.flatnonzero(new), np.cumsum(new) - 1
        length = np.diff(np.append(edge, len(node)))
        further = np.maximum(np.minimum(size - 1, size - self.need[size + low] + k) - at, 0)
        pairs = length * (length - 1) / 2
        split = pairs > LEAF * np.add.reduceat(further, edge)
        if not split.all():
            e = np.flatnonzero(~split[node])
            yield from self.some(rec[e], at[e], node[e], k, cross)
        e = np.flatnonzero(split[node])
        if not len(e):
            return
        enough = e[self.least[rec[e]] <= k]
        if len(enough):
            yield from self.some(rec[enough], at[enough], node[enough], k, cross, settled=True)
        nodes = np.cumsum(_changes(node[e])) - 1
        many, first = int(further[e].sum()), edge[split]
        parts = -(-many // (32 * BATCH))
        done = np.zeros(len(first), dtype=bool)
        for part in range(parts):
            made = []
            for lo in range(0, len(e), BATCH):
                own = e[lo : lo + BATCH]
                place, which = _ranges(at[own] + 1, further[own])
                r, n = rec[own][which], nodes[lo : lo + BATCH][which]
                w = self.number[self.base[r] + place].astype(np.int64)
                made.append((((n << wb | w) << rb | r) << pb) | place)
                if parts > 1:
                    made[-1] = made[-1][(w % parts == part) & ~done[n]]
            child = np.sort(np.concatenate(made))
            # a node whose records share the next words, too, is not told apart by them
            child_node = child >> (pb + rb)
            start = np.flatnonzero(_changes(child_node))
            count = np.diff(np.append(start, len(child)))
            left = np.bincount(child_node[start] >> wb, weights=count * (count - 1) / 2, minlength=len(first))
            alike = ~done & (left * parts > ALIKE * pairs[split])
            if alike.any():
                own = e[alike[nodes]]
                yield from self.some(rec[own], at[own], node[own], k, cross)
                done |= alike
                keep = ~alike[child_node >> wb]
                child, child_node = child[keep], child_node[keep]
            yield from self.batches(child, child_node, k + 1, cross)

    def batches(self, key: np.ndarray, node: np.ndarray, k: int, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole nodes, about `BATCH` entries and no more nodes than a key has room for."""
        pb, rb, wb = self.bits
        edge = np.append(np.flatnonzero(_changes(node)), len(key))
        room = 1 << max(0, 62 - pb - rb - wb)
        lo = 0
        while lo < len(edge) - 1:
            hi = max(lo + 1, min(lo + room, int(np.searchsorted(edge, edge[lo] + BATCH, side="right")) - 1))
            part = key[edge[lo] : edge[hi]] & ((1 << (pb + rb)) - 1)
            part |= np.repeat(np.arange(hi - lo), np.diff(edge[lo : hi + 1])) << (pb + rb)
            yield from self.level(part, k, cross)
            lo = hi

    def candidates(self, mine: Callable[[np.ndarray], np.ndarray], cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pb, rb, _ = self.bits
        before = self.size - self.held
        at, rec = _ranges(before, np.maximum(self.size - self.least + 1 - before, 0))
        w = self.number[self.base[rec] + at]
        own = mine(self.words[w])
        key = np.sort(((w[own].astype(np.int64) << rb | rec[own]) << pb) | at[own])
        yield from self.batches(key, key >> (pb + rb), 1, cross)

    def pairs(self, mine: Callable[[np.ndarray], np.ndarray], cross: bool) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        held, many = [], 0

        def distinct() -> np.ndarray:
            return np.unique(np.concatenate(held)) if held else np.array([], dtype=np.int64)

        for x, y in self.candidates(mine, cross):
            held.append(x * n + y)
            many += len(x)
            if many > 64 * PROBES:
                held = [distinct()]
                many = 0
        key = distinct()
        for lo in range(0, len(key), PROBES):
            x, y = key[lo : lo + PROBES] // n, key[lo : lo + PROBES] % n
            i, a = _ranges(self.start[x], self.held[x])
            j, b = _ranges(self.start[y], self.held[y])
            v = len(self.words)
            there, wanted = b * v + self.number[j], a * v + self.number[i]
            k = np.searchsorted(there, wanted)
            k[k == len(there)] = 0
            hit = there[k] == wanted
            common = np.bincount(a[hit], minlength=len(x))
            first = np.full(len(x), -1, dtype=np.int64)
            first[a[hit][::-1]] = self.words[self.number[i[hit][::-1]]]
            ok = (common >= self.need[self.size[x] + self.size[y]]) & mine(first)
            u, w = self.ids[x[ok]], self.ids[y[ok]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(u, w)), pa.array(np.maximum(u, w)), pa.array(common[ok].astype(np.int32))], names=["a", "b", "common"]
            )


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _packed(columns: list[np.ndarray]) -> tuple[int, bytes]:
    """Whole numbers as bytes, those that don't fit one behind them; compressed, with the length before that."""
    parts = [np.array([len(c) for c in columns], "<i8").tobytes()]
    for c in columns:
        fits = (c >= 0) & (c < 255)
        parts += [np.where(fits, c, 255).astype(np.uint8).tobytes(), c[~fits].astype("<i8").tobytes()]
    raw = b"".join(parts)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(length: int, data: bytes, columns: int) -> list[np.ndarray]:
    raw = pa.decompress(data, length, codec="zstd", asbytes=True)
    at, out = 8 * columns, []
    for n in np.frombuffer(raw, "<i8", columns):
        c = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        wide = np.flatnonzero(c == 255)
        at += int(n)
        c[wide] = np.frombuffer(raw, "<i8", len(wide), at)
        at += 8 * len(wide)
        out.append(c)
    return out


def _search(table: pa.Table, t: Fraction, cells: int, hot_from: int) -> pa.Table:
    hot, cell, other = (table.column(c)[0].as_py() for c in ("hot", "i", "j"))
    parts = [_unpacked(n.as_py(), data.as_py(), 5) for n, data in zip(table.column("length"), table.column("data"))]
    ids = np.concatenate([np.cumsum(p[0]) for p in parts])
    block, held, before, gaps = (np.concatenate([p[c] for p in parts]) for c in range(1, 5))
    del parts
    ends = np.cumsum(held)
    flat = np.cumsum(gaps)
    flat -= np.repeat(flat[ends - held] - gaps[ends - held], held)
    c = _Cell(ids, block, flat, held, held + before, t)
    if hot >= 0:
        mine = lambda w: w == hot
    else:
        mine = lambda w: (w >= 0) & (w < hot_from) & (w % cells == cell)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int32())])
    return pa.Table.from_batches(list(c.pairs(mine, hot >= 0 and cell != other)), schema)


_LAID = "id bigint, digest binary, ws binary"


def _laid_out(ids: list[int], digests: list[bytes], ranks: np.ndarray, size: np.ndarray, dtype: str) -> pa.RecordBatch:
    """Records as the ranks of their words, ascending; `ranks` of all of them one after another."""
    edge = np.concatenate(([0], np.cumsum(size))) * np.dtype(dtype).itemsize
    ws = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(ranks.astype(dtype).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), ws], names=["id", "digest", "ws"])


_PLACED = "hot bigint, i int, j int, length bigint, data binary"


def _placed(batch: pa.RecordBatch, t: Fraction, cells: int, cell_rows: int, hot: dict[int, int], hot_from: int, lone: int, dtype: str) -> pa.RecordBatch:
    """Records by the cells of their short words, those of a cell packed into one row; each from its first word of the
    cell on. `hot`: how many records have each word from `hot_from` on; words below `lone` stand in one record only."""
    ids, data = batch.column("id").to_numpy(zero_copy_only=False), batch.column("ws").to_pylist()
    by = np.argsort(ids)
    ids, data = ids[by], [data[x] for x in by]
    flat = np.frombuffer(b"".join(data), dtype).astype(np.int64)
    size = np.array([len(x) for x in data], dtype=np.int64) // np.dtype(dtype).itemsize
    start = np.cumsum(size) - size
    at, rec = _ranges(np.zeros(len(size), dtype=np.int64), size - _least(size, t) + 1)
    word = flat[start[rec] + at]
    cold = (word < hot_from) & (word >= lone)
    places, keys = [(word[cold] % cells, rec[cold], at[cold], np.zeros(int(cold.sum()), dtype=np.int64))], [(-1, c, 0) for c in range(cells)]
    for w in np.unique(word[word >= hot_from]).tolist():
        e = np.flatnonzero(word == w)
        blocks = -(-hot[w] // cell_rows)
        own = np.array([int.from_bytes(hashlib.blake2b(int(x).to_bytes(8, "big", signed=True), digest_size=8).digest(), "big") % blocks for x in ids[rec[e]]])
        for b in range(blocks):
            for o in np.unique(own).tolist():
                k = own == o
                places.append((np.full(int(k.sum()), len(keys)), rec[e[k]], at[e[k]], own[k]))
                keys.append((w, int(min(o, b)), int(max(o, b))))
    cell, rec, at, block = (np.concatenate(x) for x in zip(*places))
    by = np.lexsort((at, rec, cell))
    by = by[_changes(cell[by]) | _changes(rec[by])]
    cell, rec, at, block = cell[by], rec[by], at[by], block[by]
    held = size[rec] - at
    words, _ = _ranges(start[rec] + at, held)
    gaps = flat[words]
    gaps[1:] -= flat[words[:-1]]
    first = np.cumsum(held) - held
    gaps[first] = flat[words[first]]
    edge = np.append(np.flatnonzero(_changes(cell)), len(cell))
    rows = []
    for lo, hi in zip(edge[:-1], edge[1:]):
        own = slice(first[lo], first[hi - 1] + held[hi - 1])
        rows.append((*keys[cell[lo]], *_packed([np.diff(ids[rec[lo:hi]], prepend=0), block[lo:hi], held[lo:hi], at[lo:hi], gaps[own]])))
    hots, i, j, length, data = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(hots, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(length, pa.int64()), pa.array(data, pa.binary())],
        names=["hot", "i", "j", "length", "data"],
    )


def similar_sets(
    sets: DataFrame, threshold: Fraction = THRESHOLD, cell_rows: int = CELL_ROWS, max_vocabulary: int = MAX_VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """`sets(id bigint, words array<string> or string)` to `(pairs, members)`; a string is taken as a text.

    members `(id, rep, copies)`: every id, the smallest id with the very same set and how many have it. pairs
    `(a, b, common)`: representatives a < b whose sets have a Jaccard similarity of the threshold or more, exactly.
    Empty and null sets are members of nothing. An id given twice with different words keeps one of the sets, always
    the same. The order of words is that of their frequency; up to `max_vocabulary` words it travels with the
    tasks, beyond that it is joined.
    """
    rows = sets.where("id is not null").select("id", "words")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _sets(b)
            ids, count = b.column("id").to_pylist(), Counter(w for x in words for w in x)
            kept = [(i, _digest(w)) for i, w in zip(ids, words) if w]
            n = len(count)
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in kept] + [None] * n, pa.int64()), pa.array([d for _, d in kept] + [None] * n, pa.binary()),
                pa.array([None] * len(kept) + list(count), pa.string()), pa.array([0] * len(kept) + list(count.values()), pa.int64()),
            ], names=["id", "digest", "word", "n"])

    first = durable(rows.mapInArrow(read, "id bigint, digest binary, word string, n bigint"))
    one = first.where("id is not null").groupBy("id").agg(F.min("digest").alias("digest"))
    rep = one.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = durable(one.join(rep, "digest"))
    classes = members.where("id = rep").select("id")
    vocabulary = durable(first.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    spark = sets.sparkSession
    cells = max(spark.sparkContext.defaultParallelism, -(-classes.count() * 32 // cell_rows))
    known = vocabulary.count()
    if known <= max_vocabulary:
        order = sorted((r["n"], r["word"]) for r in vocabulary.collect())
        rank = {w: i for i, (_, w) in enumerate(order)}
        frequency = np.array([n for n, _ in order], dtype=np.int64)
        lone, hot_from = (int(np.searchsorted(frequency, n, side="right")) for n in (1, cell_rows))
        hot, dtype = dict(enumerate(frequency[hot_from:].tolist(), hot_from)), "<u2" if known < 1 << 16 else "<u4"

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept = [(i, w) for i, w in zip(b.column("id").to_pylist(), _sets(b)) if w]
                size = np.array([len(w) for _, w in kept], dtype=np.int64)
                ranks = np.array([rank[x] for _, w in kept for x in w], dtype=np.int64)
                ranks = np.sort(np.repeat(np.arange(len(kept)), size) << 32 | ranks) & 0xFFFFFFFF
                yield _laid_out([i for i, _ in kept], [_digest(w) for _, w in kept], ranks, size, dtype)

        laid = rows.mapInArrow(lay, _LAID)
    else:
        # ids that ascend in the sorted order, whatever the number of words
        ordered = durable(vocabulary.orderBy("n", "word").withColumn("rank", F.monotonically_increasing_id()))
        lone, dtype = ordered.where("n > 1").agg(F.min("rank")).first()[0], "<u8"
        lone = 1 << 62 if lone is None else lone
        hot = {r["rank"]: r["n"] for r in ordered.where(F.col("n") > cell_rows).collect()}
        hot_from = min(hot, default=1 << 62)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = _sets(b)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array([_digest(w) for w in words], pa.binary()), pa.array(words, pa.list_(pa.string()))], names=["id", "digest", "words"]
                )

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ranks = b.column("w").to_pylist()
                yield _laid_out(b.column("id").to_pylist(), b.column("digest").to_pylist(), np.array([x for w in ranks for x in w], dtype=np.int64), np.array([len(w) for w in ranks], dtype=np.int64), dtype)

        words = rows.mapInArrow(cut, "id bigint, digest binary, words array<string>").select("id", "digest", F.explode("words").alias("word"))
        ranked = words.join(ordered, "word").groupBy("id", "digest").agg(F.array_sort(F.collect_set("rank")).alias("w"))
        laid = ranked.mapInArrow(lay, _LAID)
    # of an id with several sets the one that `members` keeps; copies of a set are laid out once
    single = laid.groupBy("id").agg(F.min(F.struct("digest", "ws")).alias("s")).select("id", "s.ws").join(classes, "id", "left_semi")
    placed = single.mapInArrow(lambda batches: (_placed(b, threshold, cells, cell_rows, hot, hot_from, lone, dtype) for b in batches if b.num_rows), _PLACED)
    found = placed.groupBy("hot", "i", "j").applyInArrow(lambda table: _search(table, threshold, cells, hot_from), "a bigint, b bigint, common int")
    # a pair can come out of the cells of later common words, too, which hold less of it
    pairs = found.groupBy("a", "b").agg(F.max("common").alias("common"))
    return pairs, members.select("id", "rep", "copies")


def _filled(movements: DataFrame) -> DataFrame:
    return texts_of(movements.where(T.strip(F.col("notes")) != ""), "movement_id", ["place", "operation", "notes"])


def near_pairs(movements: DataFrame, threshold: Fraction = THRESHOLD, expand: int = EXPAND_COPIES) -> DataFrame:
    """`(movement_id_a, movement_id_b)`, the smaller id first, of movements with notes whose place,
    operation and notes share 60 % of their words. Movements without notes (null, empty, blank) are left
    out; a movement given twice counts once. A group of more than `expand` exact copies stands in the pairs
    by its smallest id only; `classes` tells the copies.
    """
    pairs, members = similar_sets(_filled(movements), threshold)
    pairs = durable(pairs.select("a", "b"))
    nodes = members.where((F.col("copies") <= expand) | (F.col("id") == F.col("rep"))).select("id", "rep", "copies")
    several = nodes.where("copies > 1").select("id", "rep")
    # most records are alone in their class
    others = several.where("id <> rep")
    with_a = pairs.join(others.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").select("x", "b")
    left = pairs.select(F.col("a").alias("x"), "b").unionByName(with_a)
    between = left.select("x", F.col("b").alias("y")).unionByName(left.join(others.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y"))
    inside = several.select("rep", F.col("id").alias("x")).join(several.select("rep", F.col("id").alias("y")), "rep").where("x < y")
    every = between.unionByName(inside.select("x", "y"))
    return every.select(F.least("x", "y").alias("movement_id_a"), F.greatest("x", "y").alias("movement_id_b"))


def classes(movements: DataFrame, expand: int = EXPAND_COPIES) -> DataFrame:
    """`(movement_id, class_id, copies, written_out)` of every movement with notes: the smallest id with the very same
    words, how many have them, and whether `near_pairs` has a row for each pair of them (else they are as near to
    each other, and to the partners of class_id, as class_id is)."""
    _, members = similar_sets(_filled(movements))
    return members.select(F.col("id").alias("movement_id"), F.col("rep").alias("class_id"), "copies", (F.col("copies") <= expand).alias("written_out"))


def near_groups(movements: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per movement with notes: `(movement_id, group_id, links)`. group_id is the smallest id of
    all records linked, directly or over others; links counts the different texts it is linked to."""
    pairs, members = similar_sets(_filled(movements), threshold)
    pairs = durable(pairs)
    both = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    links = both.groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    roots = components(pairs.select("a", "b")).withColumnRenamed("id", "rep")
    return members.join(roots, "rep", "left").join(links, "rep", "left").select(
        F.col("id").alias("movement_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
