"""Problem 2: statistics of texts, and the texts that lie in the tails of their language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronika.functions import text as T
from kronika.session import durable

#: Largest table of common words that is taken into the plan; a larger one is joined.
MAX_COMMON = 10_000
#: Robust z from which on a text is no prose: few common words, few words in lower case, many symbols,
#: few words with letters at all.
TAILS = {"common_share": -5.0, "lower_share": -9.0, "symbol_ratio": 20.0, "letter_word_share": -25.0}
#: Words with a letter from which the bound for common words holds as it is.
FULL = 60
#: Least spread of a statistic, for languages in which a quarter of the texts agree.
LEAST_SD = 0.01
#: Ranks of the quantiles that a value's percentile is read from.
PERCENTILES = [x / 100 for x in range(101)]
#: Rows of a language below which the sketch of all languages is used.
MIN_ROWS = 200
STATS = ["n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "lower_share", "letter_word_share"]

# The start of a word with a letter, and of one whose first letter or digit is a letter in lower case.
_LETTER_WORD = r"(?U)(?<![^\s\x1c-\x1f])[^\s\x1c-\x1f\p{L}]*+\p{L}"
_LOWER_WORD = r"(?U)(?<![^\s\x1c-\x1f])[^\s\x1c-\x1f\p{L}\p{N}]*+\p{Ll}"
_SPACE = r"(?U)[\s\x1c-\x1f]"


Common = dict[str, list[str]] | DataFrame


def common_by_language(common_words: DataFrame, most: int = MAX_COMMON) -> Common:
    """Common words as literals by language, or beyond `most` rows as a table `(lang, word)`. Null words and languages are left out."""
    table = common_words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct()
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        return durable(table)
    out: dict[str, list[str]] = {}
    for lang, word in sorted(map(tuple, rows)):
        out.setdefault(lang, []).append(word)
    return out


_WORDS = r"[\p{L}\p{M}]+"


def _with_common(df: DataFrame, t: Column, common: Common) -> DataFrame:
    """Adds `_best`: the language with the most common words in the text, the last in order of several, and their number."""
    if isinstance(common, dict):
        every = sorted({w for ws in common.values() for w in ws})
        # common words are a fourth of a text; the languages are told apart among these only
        found = F.filter(F.regexp_extract_all(F.lower(t), F.lit(_WORDS), F.lit(0)), lambda w: w.isin(every))
        within = lambda ws: F.size(F.filter("_common", lambda w: w.isin(ws)))
        each = [F.struct(within(ws).alias("n"), F.lit(lang).alias("lang")) for lang, ws in common.items()]
        best = F.array_max(F.array(*each)) if each else F.lit(None).cast("struct<n:int,lang:string>")
        return df.withColumn("_common", found).withColumn("_best", best).drop("_common")
    df = durable(df.withColumn("_id", F.monotonically_increasing_id()))
    words = df.select("_id", F.explode(F.regexp_extract_all(F.lower(t), F.lit(_WORDS), F.lit(0))).alias("word"))
    per = words.groupBy("_id", "word").agg(F.count(F.lit(1)).alias("k")).join(common, "word").groupBy("_id", "lang").agg(F.sum("k").cast("int").alias("n"))
    best = per.groupBy("_id").agg(F.max(F.struct("n", "lang")).alias("_best"))
    return df.join(best, "_id", "left").drop("_id")


def statistics(df: DataFrame, common: Common, text: str = "text") -> DataFrame:
    """Adds the statistics and `text_lang` to each row. Null and blank texts have n_words 0, null shares
    and language 'und'; so does, with shares of 0, a text without any common word.

    n_words counts runs without white space. The shares of common and of lower-case words are of the words
    with a letter, so that numbers strewn into prose do not hide it. symbol_ratio: neither letters nor
    digits, of the characters that are no white space. punct_line_share: of the lines that are not blank.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    dense = F.regexp_replace(t, _SPACE + "+", "")
    df = _with_common(df, t, common).withColumns({
        "n_words": T.count_words(t), "_dense": F.length(dense),
        "_n": F.regexp_count(t, F.lit(_LETTER_WORD)), "_lower": F.regexp_count(t, F.lit(_LOWER_WORD)),
        "_symbols": F.length(F.regexp_replace(dense, r"[\p{L}\p{N}\p{M}]+", "")),
        "_lines": F.regexp_count(t, F.lit(r"(?m)^.*\S.*$")),
        "_ends": F.regexp_count(t, F.lit(r"(?m)[.!?…:;][\"'”’»)\]]*[ \t]*$")),
    })
    hits = F.coalesce(F.col("_best.n"), F.lit(0))
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    return df.withColumns({
        "text_lang": F.when(hits > 0, F.col("_best.lang")).otherwise("und"),
        "letter_words": F.col("_n"),
        "mean_word_length": share(F.col("_dense"), F.col("n_words")),
        "symbol_ratio": share(F.col("_symbols"), F.col("_dense")),
        "punct_line_share": share(F.col("_ends"), F.col("_lines")),
        "common_share": F.when(F.col("n_words") > 0, F.coalesce(share(hits, F.col("_n")), F.lit(0.0))),
        "lower_share": F.when(F.col("n_words") > 0, F.coalesce(share(F.col("_lower"), F.col("_n")), F.lit(0.0))),
        "letter_word_share": share(F.col("_n"), F.col("n_words")),
    }).drop("_dense", "_n", "_lower", "_best", "_symbols", "_lines", "_ends")


def sketches(stats: DataFrame, columns: list[str]) -> DataFrame:
    """`(text_lang, rows, <column>...)`: one mergeable KLL sketch per language and statistic. Sketches of
    parts merge, so each is made where the rows lie and only sketches are shuffled. Nulls are left out."""
    return stats.where("n_words > 0").groupBy("text_lang").agg(
        F.count(F.lit(1)).alias("rows"), *[F.kll_sketch_agg_double(F.col(c).cast("double")).alias(c) for c in columns]
    )


def scored(stats: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `<column>_z` (robust: distance from the median in quarter ranges / 1.349) and `<column>_pct` (rank
    in the sketch) by language. Texts of a language with few rows, and of 'und', are held against all languages.

    The sketches, one row per language, are merged to one for all and joined; they do not grow with the rows.
    """
    # one row for each language of the common words: made once, whatever the number of texts
    by = sketches(stats, columns)
    by = stats.sparkSession.createDataFrame(by.collect(), by.schema)
    every = by.agg(F.lit("*").alias("text_lang"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.kll_merge_agg_double(c).alias(c) for c in columns])
    every = every.where("rows > 0")  # an empty sketch has no quantiles
    rank = lambda c, q: F.kll_sketch_get_quantile_double(c, F.lit(q))
    table = by.where((F.col("rows") >= MIN_ROWS) & (F.col("text_lang") != "und")).unionByName(every).select(
        F.col("text_lang").alias("_lang"),
        *[x for c in columns for x in (
            F.kll_sketch_get_quantile_double(c, F.lit(PERCENTILES)).alias(f"_{c}"), rank(F.col(c), 0.5).alias(f"_{c}_mid"),
            ((rank(F.col(c), 0.75) - rank(F.col(c), 0.25)) / 1.349).alias(f"_{c}_sd"),
        )],
    )
    rows = table.collect()
    table = stats.sparkSession.createDataFrame(rows, table.schema)
    have = [r["_lang"] for r in rows]
    keyed = stats.withColumn("_lang", F.when(F.col("text_lang").isin(have), F.col("text_lang")).otherwise("*"))
    joined = keyed.join(F.broadcast(table), "_lang", "left")
    z = {f"{c}_z": (F.col(c) - F.col(f"_{c}_mid")) / F.greatest(F.col(f"_{c}_sd"), F.lit(LEAST_SD)) for c in columns}
    below = lambda c: F.size(F.filter(f"_{c}", lambda v: v <= F.col(c))) / F.lit(float(len(PERCENTILES)))
    pct = {f"{c}_pct": below(c) for c in columns}
    return joined.withColumns(z | pct).drop("_lang", *[f"_{c}{x}" for c in columns for x in ("", "_mid", "_sd")])


def in_tail(tails: dict[str, float] = TAILS) -> Column:
    """A score beyond its bound, on the bound's side of the median. The bound for the common words, of which a
    short text has few by chance, is wider by the square root of what it has less than FULL words."""
    wider = F.sqrt(F.greatest(F.lit(1.0), FULL / F.greatest(F.col("letter_words"), F.lit(1))))
    bound = lambda c, z: z * wider if c == "common_share" else F.lit(z)
    hits = [(F.col(f"{c}_z") <= bound(c, z)) if z < 0 else (F.col(f"{c}_z") >= bound(c, z)) for c, z in tails.items()]
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits], F.lit(False)))


def _once(chunks: DataFrame, common: Common) -> DataFrame:
    """Statistics of each chunk, kept while the sketches are made of them. Texts are not shuffled: a chunk loaded twice
    has the same statistics twice, and those are made one."""
    s = statistics(chunks.select("book", "chunk_id", "text"), common)
    return durable(s.select("book", "chunk_id", "text_lang", "letter_words", *STATS).distinct())


def found(chunks: DataFrame, pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """`(item, book, item_no)`: chunks in a tail, and pages whose word_count is null or wrong. Blank chunks are
    no case. A key loaded twice comes out once."""
    common = common_by_language(common_words)
    s = scored(_once(chunks, common), list(TAILS)).where(in_tail())
    return (
        s.select(F.lit("chunk").alias("item"), "book", F.col("chunk_id").alias("item_no"))
        .unionByName(wrong_counts(pages).select(F.lit("page").alias("item"), "book", F.col("page_number").alias("item_no"))).distinct()
    )


def wrong_counts(pages: DataFrame) -> DataFrame:
    """`(book, page_number, word_count, n_words)` of pages whose word_count is null or not the number of words of the text."""
    p = pages.select("book", "page_number", "word_count", T.count_words(F.coalesce("text", F.lit(""))).alias("n_words"))
    return p.where(F.col("word_count").isNull() | (F.col("word_count") != F.col("n_words"))).distinct()


def page_report(pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """Every page with its statistics, and its scores among the pages of its language. A page loaded twice comes out once
    for each different text or count."""
    s = statistics(pages.select("book", "page_number", "text", "word_count"), common_by_language(common_words))
    s = durable(s.select("book", "page_number", "word_count", "text_lang", "letter_words", *STATS).distinct())
    return scored(s, STATS).withColumn("right_count", F.coalesce(F.col("word_count") == F.col("n_words"), F.lit(False)))


def report(chunks: DataFrame, common_words: DataFrame) -> DataFrame:
    """Every chunk with its statistics, scores and verdict; no shuffle but for the repeated rows."""
    s = _once(chunks, common_by_language(common_words))
    return scored(s, STATS).withColumn("prose", ~in_tail() & (F.col("n_words") > 0))
