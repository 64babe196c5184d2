"""Problem 7: placing documents into windows of fixed capacity.

Only lengths matter for which documents share a window, and there are no more lengths than tokens in a
window. So the plan is made over the counts per length, at most `capacity` numbers whatever the corpus
holds: exact complements first (a length that fills the gap, then pairs and triples of lengths that do),
then best fit of what is left. The plan is a short list of patterns of lengths, each with the number of
its windows. Documents are numbered within their length and take their place in the plan by a join.
"""

from __future__ import annotations

import bisect
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Ranks of a byte-level tokenizer, a file of the driver; it is sent to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how that tokenizer parts a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that are numbered in one task, and numbers whose places in the plan lie in one row.
NUMBER_ROWS, SPAN = 100_000, 64

_ENCODINGS: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    key = (path, pattern)
    if key not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def count_tokens(documents: DataFrame, path: str = TOKENIZER, key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """`(doc_id, tokens)`; null and empty texts have 0 tokens, null keys are left out, a key twice counts once.

    The text goes through one Arrow stage and only numbers come out of it.
    """

    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(SparkFiles.get(name), pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]
            yield pd.DataFrame({key: b[key], "tokens": pd.array(n, dtype="int64")})

    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"{key} bigint, tokens bigint").groupBy(key).agg(F.max("tokens").alias("tokens"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Counts per length to `[(lengths in one window, number of such windows)]`; uses every item once.

    From the longest length down: the gap it leaves is looked up among the lengths, then among the sums of
    pairs and of triples that are there in sufficient number; such a combination is used as often as its
    scarcest member allows. Then what is left goes, longest first, each into the fullest window it fits.
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    out: Counter[tuple[int, ...]] = Counter()

    def use(combo: tuple[int, ...]) -> None:
        need = Counter(combo)
        times = min(left[n] // k for n, k in need.items())
        if times:
            out[tuple(sorted(combo, reverse=True))] += times
            for n, k in need.items():
                left[n] -= k * times

    def fits(combo: tuple[int, ...]) -> bool:
        return all(left[n] >= k for n, k in Counter(combo).items())

    for n in sorted(left, reverse=True):
        if n == capacity:
            use((n,))
            continue
        while left[n]:
            gap, had = capacity - n, left[n]
            if fits((n, gap)):
                use((n, gap))
                continue
            lengths = sorted(x for x, c in left.items() if c and x < gap)
            pair = next(((n, a, gap - a) for a in reversed(lengths) if 2 * a >= gap and left[gap - a] and fits((n, a, gap - a))), None)
            if pair:
                use(pair)
                continue
            triple = None
            for a in reversed(lengths):
                rest = gap - a
                if 3 * a < gap:
                    break
                for b in lengths[: bisect.bisect_right(lengths, min(a, rest - 1))][::-1]:
                    if 2 * b < rest:
                        break
                    if left[rest - b] and fits((n, a, b, rest - b)):
                        triple = (n, a, b, rest - b)
                        break
                if triple:
                    break
            if triple:
                use(triple)
            if left[n] == had:
                break

    # best fit over kinds of windows: {room left: {lengths in it: number of such windows}}
    rooms: dict[int, Counter[tuple[int, ...]]] = {}
    sizes: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        room = capacity - sum(lengths)
        if room not in rooms:
            rooms[room] = Counter()
            bisect.insort(sizes, room)
        rooms[room][lengths] += times

    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(sizes, n)
            if at == len(sizes):
                fit = capacity // n
                if todo // fit:
                    put((n,) * fit, todo // fit)
                if todo % fit:
                    put((n,) * (todo % fit), 1)
                break
            room = sizes[at]
            lengths, there = next(iter(rooms[room].items()))
            times = min(todo, there)
            rooms[room][lengths] -= times
            if not rooms[room][lengths]:
                del rooms[room][lengths]
                if not rooms[room]:
                    del rooms[room]
                    sizes.pop(at)
            put((*lengths, n), times)
            todo -= times
    for kinds in rooms.values():
        out.update(kinds)
    return sorted((c, k) for c, k in out.items())


def pack(sized: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """`(doc_id, tokens)` to `(doc_id, piece, tokens, start, window, place)`: where each document lies.

    A document longer than a window is cut into whole windows of its own and a rest, which is placed as a
    document; no other is cut. Documents of 0 tokens, and null counts, take no room: window null. `place`
    is the first token of the piece in its window.
    """
    s = sized.select(F.col(key).alias("id"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("n"))
    cut = s.where("n > 0").select(
        "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity))).alias("piece"), "n"
    ).select("id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity).alias("len"))
    # numbers within a length: counts of slices first, so that no length is ordered in one task
    counts = {r["len"]: r["n"] for r in cut.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    spark = sized.sparkSession
    rows, base = [], 0
    taken: Counter[int] = Counter()
    for lengths, times in plan({int(k): int(v) for k, v in counts.items()}, capacity):
        place = 0
        for n in lengths:
            rows.append((n, taken[n], taken[n] + times, base, place))
            taken[n] += times
            place += n
        base += times
    slots = spark.createDataFrame(rows, "len bigint, lo bigint, hi bigint, base bigint, place bigint")
    largest = max(counts.values(), default=1)
    slices = max(1, -(-largest // NUMBER_ROWS))
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("id", "piece"), F.lit(slices)))
    before = cut.groupBy("len", "slice").agg(F.count(F.lit(1)).alias("c")).withColumn(
        "before", F.coalesce(F.sum("c").over(Window.partitionBy("len").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    order = Window.partitionBy("len", "slice").orderBy("id", "piece")
    numbered = cut.withColumn("r", F.row_number().over(order) - 1).join(before.drop("c"), ["len", "slice"])
    numbered = numbered.withColumn("no", F.col("r") + F.col("before"))
    # the slots that a span of numbers falls into: at most as many as it has numbers
    touched = F.sequence(F.floor(F.col("lo") / SPAN), F.floor((F.col("hi") - 1) / SPAN))
    spans = slots.withColumn("span", F.explode(touched)).groupBy("len", "span").agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "base", "place"))).alias("slots"))
    hit = F.try_element_at(F.filter("slots", lambda x: x["hi"] > F.col("no")), F.lit(1))
    numbered = numbered.withColumn("span", F.floor(F.col("no") / SPAN))
    placed = numbered.join(spans, ["len", "span"]).withColumn("at", hit).select(
        F.col("id").alias(key), F.col("piece").cast("int").alias("piece"), F.col("len").alias("tokens"),
        (F.col("piece") * capacity).alias("start"), (F.col("at.base") + F.col("no") - F.col("at.lo")).alias("window"), F.col("at.place").alias("place"),
    )
    none = s.where("n = 0").select(
        F.col("id").alias(key), F.lit(0).alias("piece"), F.col("n").alias("tokens"), F.lit(0).cast("bigint").alias("start"),
        F.lit(None).cast("bigint").alias("window"), F.lit(None).cast("bigint").alias("place"),
    )
    return placed.unionByName(none)


def windows(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """The window of every document; see `pack`."""
    from kronika.session import durable

    return pack(durable(count_tokens(documents, path)), capacity)


def window_report(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """One row: windows, tokens, the fewest windows that could hold them, and the share of room unused."""
    w = windows(documents, capacity, path).where("window is not null")
    t = w.agg(F.count_distinct("window").alias("windows"), F.sum("tokens").alias("tokens"))
    return t.select(
        "windows", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_windows"),
        (1 - F.col("tokens") / (F.col("windows") * capacity)).alias("unused"),
    )
