"""Connected components of a graph given as edges, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronika.session import durable


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`edges(a bigint, b bigint)` to `(id bigint, root bigint)`, root being the smallest id of the component.

    Alternating large-star and small-star steps: each is one pre-aggregated minimum per node and one
    join, so that no neighbourhood is ever held in one task. Every round is cut by a checkpoint in the
    shared folder; the number of rounds grows with the logarithm of the longest path. Null ends and
    loops are left out, repeated edges count once; an empty input gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = durable(e)
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m", "a")
        e2 = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        e = durable(e2.where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum("b"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
