"""Problem 5: one record for each action that was recorded several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronika.functions import text as T
from kronika.llm.components import components
from kronika.session import durable

# Month names as they are written in dates.
MONTHS = [
    ("january", "siječanj", "siječnja", "januar", "gennaio"),
    ("february", "veljača", "veljače", "februar", "febbraio"),
    ("march", "ožujak", "ožujka", "märz", "marzo"),
    ("april", "travanj", "travnja", "aprile"),
    ("may", "svibanj", "svibnja", "mai", "maggio"),
    ("june", "lipanj", "lipnja", "juni", "giugno"),
    ("july", "srpanj", "srpnja", "juli", "luglio"),
    ("august", "kolovoz", "kolovoza", "agosto"),
    ("september", "rujan", "rujna", "settembre"),
    ("october", "listopad", "listopada", "oktober", "ottobre"),
    ("november", "studeni", "studenog", "studenoga", "novembre"),
    ("december", "prosinac", "prosinca", "dezember", "dicembre"),
]
#: The region in which a point counts as right: lat from, lat to, lng from, lng to.
REGION = (42.0, 47.0, 13.0, 20.0)
#: A later stage is trusted more.
STAGES = ["extract", "verify", "polish"]


def parse_date(date: Column) -> Column:
    """A date text as struct<y,m,d>: all three for a full day, d or m and d null for an incomplete date,
    all null for a missing, unreadable or impossible one. 'Early in a month' names the month only."""
    s = F.lower(T.compact(date))
    number = lambda p, g: F.regexp_extract(s, p, g).try_cast("int")
    ymd = r"^(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?\.?$"
    dmy = r"^(\d{1,2})\. ?(\d{1,2})\. ?(\d{4})\.?$|^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    named = r"^(?:.* )?(?:(\d{1,2})\.? )?(\p{L}+),? (\d{4})\.?$"
    day_named = r"^(?:.* )?(\d{1,2})\.? (\p{L}+),? (\d{4})\.?$"
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for name in m for x in (name, i + 1)])
    y = F.coalesce(number(ymd, 1), number(dmy, 3), number(dmy, 6), number(named, 3), number(r"^(\d{4})\.?$", 1))
    m = F.coalesce(number(ymd, 2), number(dmy, 2), number(dmy, 5), F.try_element_at(names, F.regexp_extract(s, named, 2)))
    d = F.coalesce(number(ymd, 3), number(dmy, 1), number(dmy, 4), number(day_named, 1))
    m = F.when(m.between(1, 12), m)
    last = F.dayofmonth(F.last_day(F.make_date(F.greatest(y, F.lit(1)), m, F.lit(1))))
    d = F.when(m.isNotNull() & (d >= 1) & (d <= last), d)
    return F.struct(y.alias("y"), F.when(y.isNotNull(), m).alias("m"), F.when(y.isNotNull(), d).alias("d"))


def plain(text: Column) -> Column:
    """Letters apart from case, accents, spacing and marks at the ends."""
    s = F.regexp_replace(T.normalize(text), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")
    return F.regexp_replace(s, T.WS + "+", "")


def _scored(movements: DataFrame, region: tuple[float, float, float, float], more: tuple[str, ...] = ()) -> DataFrame:
    """Each movement once, kept: `key` is what records of one action agree in, null where a part of it is missing. Of
    rows with one movement_id the greatest in the order of these columns is kept."""
    a, b, c, d = region
    point = F.col("coordinates")
    good = point["lat"].between(a, b) & point["lng"].between(c, d)
    place, operation = plain(F.col("place")), plain(F.col("operation"))
    key = F.when(F.col("book").isNotNull() & (F.col("p") != "") & (F.col("o") != ""), F.unhex(F.md5(F.concat_ws("\0", "book", "p", "o"))))
    rows = movements.where("movement_id is not null").withColumns({"p": place, "o": operation}).select(
        F.col("movement_id").cast("bigint").alias("movement_id"), key.alias("key"), "extracted_at", parse_date(F.col("date")).alias("day"),
        F.array_distinct(F.filter(F.coalesce("source_chunk_ids", F.array().cast("array<int>")), lambda x: x.isNotNull())).alias("chunks"),
        F.coalesce(good, F.lit(False)).alias("good_point"), *more,
    )
    return durable(rows.groupBy("movement_id").agg(F.max(F.struct(*rows.columns[1:])).alias("x")).select("movement_id", "x.*"))


def link_groups(scored: DataFrame) -> DataFrame:
    """`(movement_id, group_id)` of every movement that has at least one other record of the same action.

    Records of one book, place, operation and chunk are first gathered by date: those of one date form
    one node, so that a hot group costs one row per record and never a pair of records. A date then
    links to what it could be short of: the day to its month, its year and to no date. Links of that
    kind are all there is, as two full days are the same or contradict each other. Components of the
    links are the groups. Records without book, place, operation or chunks are linked to nothing.
    """
    spread = scored.where("key is not null").select("movement_id", "key", "day", F.explode("chunks").alias("chunk"))
    key = ["key", "chunk"]
    node = spread.groupBy(*key, "day").agg(F.min("movement_id").alias("head"))
    star = spread.join(node, [*key, "day"]).where("movement_id <> head").select(
        F.col("movement_id").alias("a"), F.col("head").alias("b")
    )
    up = lambda m_, d_: F.struct(F.col("day.y").alias("y"), m_.alias("m"), d_.alias("d"))
    none = F.lit(None).cast("int")
    wider = F.array_distinct(F.array(
        up(F.col("day.m"), none), up(none, none), F.struct(none.alias("y"), none.alias("m"), none.alias("d"))
    ))
    climbs = node.select(*key, F.col("head").alias("a"), "day", F.explode(wider).alias("above")).where("above <> day")
    climbs = climbs.drop("day").withColumnRenamed("above", "day").join(node.withColumnRenamed("head", "b"), [*key, "day"])
    return components(star.unionByName(climbs.select("a", "b"))).select(
        F.col("id").alias("movement_id"), F.col("root").alias("group_id")
    )


def rank_records(movements: DataFrame, region: tuple[float, float, float, float] = REGION) -> DataFrame:
    """Movements of groups of two and more with `group_id` and their rank in it: by completeness, number
    of sources, recency and id, in this order, so that no tie is left. Null extracted_at ranks last."""
    m = _scored(movements, region)
    full = F.col("day.d").isNotNull().cast("int") + F.col("good_point").cast("int")
    joined = link_groups(m).join(m, "movement_id").select("movement_id", "group_id", "extracted_at", full.alias("points"), F.size("chunks").alias("n_chunks"))
    order = Window.partitionBy("group_id").orderBy(
        F.desc("points"), F.desc("n_chunks"), F.desc_nulls_last("extracted_at"), F.asc("movement_id")
    )
    return joined.withColumn("rank", F.row_number().over(order))


def survivors(movements: DataFrame) -> DataFrame:
    """`(group_id, survivor_id)`; the rank filter is pushed below the shuffle as a group limit."""
    return rank_records(movements).where("rank = 1").select("group_id", F.col("movement_id").alias("survivor_id"))


def build_best(movements: DataFrame) -> DataFrame:
    """One built record per group, each field taken from the best record that has it.

    date: a full day before an incomplete date; coordinates: a point within the region, else the most
    complete one; place, operation, division and notes: of the later stage, then the later extraction,
    empty values last; source_chunk_ids: all of the group, sorted. Aggregates only, partly done before
    the shuffle; ties end with the smallest movement_id.
    """
    scored = _scored(movements, REGION, ("book", "stage", "date", "place", "operation", "division", "notes", "coordinates"))
    m = link_groups(scored).join(scored, "movement_id")
    trust = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")), F.lit(0))
    recent = F.coalesce(F.col("extracted_at").cast("timestamp_ltz").cast("double"), F.lit(0.0))
    tail = [trust.alias("t"), recent.alias("r"), (-F.col("movement_id")).alias("i")]

    def best(col: str, score: Column) -> Column:
        return F.max_by(F.col(col), F.struct(score.alias("s"), *tail)).alias(col)

    filled = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False)).cast("int")
    known = sum((F.col(f"day.{x}").isNotNull().cast("int") for x in "ymd"), F.lit(0))
    halves = F.coalesce(F.col("coordinates.lat").isNotNull().cast("int") + F.col("coordinates.lng").isNotNull().cast("int"), F.lit(0))
    return m.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("book").alias("book"),
        best("date", known), best("coordinates", F.col("good_point").cast("int") * 3 + halves),
        *[best(c, filled(c)) for c in ("place", "operation", "division", "notes")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("chunks")))).alias("source_chunk_ids"),
    )
