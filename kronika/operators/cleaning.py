"""From printed page to clean text: page numbers and footnotes out, lines to paragraphs.

All per page and without a state machine: the first footnote line is a minimum over line numbers, and a
line's place in its paragraph depends on the line before it only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronika.functions import text as T

# What a footnote, an inline footnote, a page number and a heading look like.
FOOTNOTE = r"^\s*(?:\^?\s*)?(?:\d{1,2}|I\d{1,2})[a-z]?[)\.'\"]\s+[A-ZČĆŽŠĐ]"
INLINE = r"^(.{40,}?[.!?\"'])\s*((?:\d{1,2}|I\d{1,2})[a-z]?[)\.'\"]\s+[A-ZČĆŽŠĐ].*)$"
PAGE_NUMBER = r"(?U)^\s*\d+\s*\z"
HEADING = r"^[A-ZČĆŽŠĐ0-9 .,:;()\-\"«»]+\z"
HEADING_WORDS = 8


def lines(text: Column) -> Column:
    """Python's str.splitlines(): no empty line after the last line end."""
    parts = F.split(F.coalesce(text, F.lit("")), T.LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_heading_text(s: Column) -> Column:
    """Of a stripped line."""
    return (s != "") & (T.count_words(s) <= HEADING_WORDS) & s.rlike(HEADING)


def with_footnotes(pages: DataFrame) -> DataFrame:
    """Adds `_main` and `_notes`, arrays of lines. From the first line that starts or holds a footnote on, all is
    footnote; a start counts in the lower half of the page only, an inline one anywhere.

    Each step is a column of its own, so that it is computed once for a page and not once for each line.
    """
    n = F.size("_lines")
    df = pages.withColumn("_lines", lines(F.col("text")))
    df = df.withColumn("_at", F.transform("_lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"), x.rlike(PAGE_NUMBER).alias("p"), x.rlike(INLINE).alias("inline"))))
    starts = lambda s: ~s["p"] & (s["inline"] | ((s["i"] >= F.floor(n / 2)) & s["x"].rlike(FOOTNOTE)))
    df = df.withColumn("_hit", F.try_element_at(F.filter("_at", starts), F.lit(1)))
    hit = F.col("_hit")
    df = df.withColumn("_cut", F.coalesce(hit["i"], n))
    kept = lambda cond: F.transform(F.filter("_at", lambda s: cond(s) & ~s["p"]), lambda s: s["x"])
    none = F.array().cast("array<string>")
    inline = F.coalesce(hit["inline"], F.lit(False))
    first = F.when(hit.isNull(), none).when(inline, F.array(F.regexp_extract(hit["x"], INLINE, 2))).otherwise(F.array(hit["x"]))
    return df.withColumns({
        "_main": F.concat(kept(lambda s: s["i"] < F.col("_cut")), F.when(inline, F.array(F.regexp_extract(hit["x"], INLINE, 1))).otherwise(none)),
        "_notes": F.concat(first, kept(lambda s: s["i"] > F.col("_cut"))),
    }).drop("_lines", "_at", "_hit", "_cut")


def with_paragraphs(df: DataFrame) -> DataFrame:
    """Adds `_text`, `_dehyphenations` and `_merges` for the lines in `_main`: a heading stands alone, a blank line ends a
    paragraph, a line after one that ends in a hyphen is glued to it where it starts in lower case."""
    state = "struct<parts:array<string>,cur:string,open:boolean,dehyphenated:int,merged:int>"
    zero = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"), F.lit(False).alias("open"),
        F.lit(0).alias("dehyphenated"), F.lit(0).alias("merged"),
    ).cast(state)

    def step(acc: Column, line: Column) -> Column:
        s, heading = line["s"], line["h"]
        blank = s == ""
        stands = blank | heading
        glue = ~stands & acc["open"] & acc["cur"].endswith("-") & line["low"]
        on = ~stands & acc["open"]
        flushed = F.when(stands & acc["open"], F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"])
        return F.struct(
            F.when(heading, F.concat(flushed, F.array(s))).otherwise(flushed).alias("parts"),
            F.when(stands, F.lit("")).when(glue, F.concat(F.substring(acc["cur"], F.lit(1), F.length(acc["cur"]) - 1), s))
            .when(on, F.concat(acc["cur"], F.lit(" "), s)).otherwise(s).alias("cur"),
            (~stands).alias("open"), (acc["dehyphenated"] + glue.cast("int")).alias("dehyphenated"), (acc["merged"] + on.cast("int")).alias("merged"),
        )

    df = df.withColumn("_read", F.transform(F.transform("_main", T.strip), lambda s: F.struct(s.alias("s"), is_heading_text(s).alias("h"), s.rlike(r"^\p{IsLowercase}").alias("low"))))
    df = df.withColumn("_end", F.aggregate("_read", zero, step))
    end = F.col("_end")
    parts = F.when(end["open"], F.concat(end["parts"], F.array(end["cur"]))).otherwise(end["parts"])
    text = F.regexp_replace(F.regexp_replace(F.array_join(parts, "\n\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return df.withColumns({
        "_text": T.strip(text), "_dehyphenations": end["dehyphenated"], "_merges": end["merged"],
    }).drop("_read", "_end")


def clean(pages: DataFrame) -> DataFrame:
    """Pages `(book, page_number, text, ...)` to `(book, page_number, text, word_count, footnotes, footnote_lines,
    dehyphenations, merges)`. Null texts give empty ones; footnotes is null where there is none. No shuffle."""
    s = with_paragraphs(with_footnotes(pages.select("book", "page_number", "text")))
    s = s.withColumn("_shown", F.filter(F.transform("_notes", T.strip), lambda x: x != ""))
    return s.select(
        "book", "page_number", F.col("_text").alias("text"), T.count_words(F.col("_text")).alias("word_count"),
        F.when(F.size("_shown") > 0, F.array_join("_shown", "\n")).alias("footnotes"), F.size("_notes").alias("footnote_lines"),
        F.col("_dehyphenations").alias("dehyphenations"), F.col("_merges").alias("merges"),
    )


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """One row per book. Footnote lines count blank ones too, merges count dehyphenations too."""
    return cleaned.groupBy("book").agg(
        F.count(F.lit(1)).alias("pages_processed"), F.count_if(F.col("footnote_lines") > 0).alias("pages_with_footnotes_removed"),
        F.sum("footnote_lines").alias("total_footnote_lines_removed"), F.sum("dehyphenations").alias("total_dehyphenations"),
        F.sum("merges").alias("total_line_merges"),
    )
