"""Numbers, sums and neighbours along an order, for keys of any size.

An integer order is cut into spans. Within a span a window does it; over spans there is one row each. So a key
that holds a tenth of a table is spread over as many tasks as it has spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the order in a span.
SPAN = 4_096


def once(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row of each key, the greatest in the order of `by`, so that it is always the same one."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(by)])).alias("_x")).select(*keys, "_x.*")


def chunk_once(chunks: DataFrame) -> DataFrame:
    """Chunks loaded twice count once: the one with the greatest text, then count, then pages; null before all. Other
    columns, and those of these that are missing, are left out."""
    order = {"text": F.coalesce("text", F.lit("")), "word_count": F.coalesce("word_count", F.lit(-1)), "source_pages": F.coalesce(F.array_join("source_pages", ","), F.lit(""))}
    have = [c for c in order if c in chunks.columns]
    return once(chunks.select("book", "chunk_id", *have), ["book", "chunk_id"], [order[c] for c in have])


def _before(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, by: list[str], order: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """Adds the sum of `value` over the rows of the key that come before; `order` is an integer, unique in the key."""
    df = df.withColumns({"_span": F.floor(F.col(order) / span), "_v": value.cast("bigint")})
    spans = df.groupBy(*by, "_span").agg(F.sum("_v").alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(_before(by, "_span")), F.lit(0))).drop("_t")
    inner = F.coalesce(F.sum("_v").over(_before([*by, "_span"], order)), F.lit(0))
    return df.withColumn("_i", inner).join(spans, [*by, "_span"]).withColumn(name, F.col("_i") + F.col("_base")).drop("_span", "_v", "_i", "_base")


def numbered(df: DataFrame, by: list[str], order: str, name: str, span: int = SPAN) -> DataFrame:
    """Adds the place of each row in its key, from 0."""
    return running(df, by, order, F.lit(1), name, span)


def preceded(df: DataFrame, by: list[str], order: str, columns: list[str], name: str, span: int = SPAN) -> DataFrame:
    """Adds the columns of the row before in the key as a struct; null for the first."""
    df = df.withColumns({"_span": F.floor(F.col(order) / span), "_s": F.struct(*columns)})
    last = df.groupBy(*by, "_span").agg(F.max_by("_s", order).alias("_l"))
    last = last.withColumn("_c", F.lag("_l").over(Window.partitionBy(*by).orderBy("_span"))).drop("_l")
    inner = F.lag("_s").over(Window.partitionBy(*by, "_span").orderBy(order))
    return df.withColumn("_p", inner).join(last, [*by, "_span"]).withColumn(name, F.coalesce("_p", "_c")).drop("_span", "_s", "_p", "_c")
