"""Problem 1: cutting oversized texts at natural boundaries, with overlap.

The fresh words of a piece are taken by one regular expression with bounded quantifiers. Its
alternatives stand in the order of the strength of their boundary: the whole rest, the last end of a
paragraph, sentence or line in the later part of the room, then anywhere in it, then a word at the
limit. The last alternative takes characters, for runs without white space beyond `run_limit`. The
overlap of a piece is looked back from its start, with array functions over the words before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronika.functions import text as T

LIMIT, OVERLAP = 200, 24
#: Characters of a run without white space from which it is cut inside; one piece takes at most that many of it.
RUN_LIMIT = 20_000
#: Share of the room that a piece fills before a weaker boundary later in it is preferred to a stronger one earlier.
LATER = 0.5

_S = r"[\s\x1c-\x1f]"
_W = r"[^\s\x1c-\x1f]"
# Boundaries, strongest first, as what stands around the end of the last word. A sentence ends with a mark,
# closing quotes or brackets after it, and goes on with a capital, digit, quote or dash.
_PARAGRAPH = rf"(?=[ \t]*(?:\r\n|[\n\r  ]){_S}*?(?:\r\n|[\n\r  ]))"
_SENTENCE = rf"(?<=[.!?…][\"'”’»)\]]{{0,2}})(?={_S}+[\p{{Lu}}\p{{N}}\"'„“«»(–—•-])"
_LINE = r"(?=[ \t]*[\n\r  ])"


def _fresh(room: int, run_limit: int) -> str:
    """Alternatives that take up to `room` words from where the last piece ended."""
    word = rf"{_W}{{1,{run_limit}}}+(?!{_W})"
    take = lambda least: rf"(?:{word}{_S}++){{{max(least - 1, 0)},{room - 1}}}{word}"
    later = max(1, int(room * LATER))
    ordered = [rf"{take(1)}(?={_S}*\z)"]
    ordered += [take(least) + b for least in (later, 1) for b in (_PARAGRAPH, _SENTENCE, _LINE)]
    ordered += [take(1), rf"{_W}{{1,{run_limit}}}"]
    return "(?:" + "|".join(ordered) + ")"


def pattern(limit: int = LIMIT, overlap: int = OVERLAP, run_limit: int = RUN_LIMIT) -> str:
    """Matches one fresh part after the other: `limit` words at the start of the text, then `limit - overlap`."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    return rf"(?U)(?:\A{_S}*{_fresh(limit, run_limit)}|{_fresh(limit - overlap, run_limit)})"


def split_column(text: Column, limit: int = LIMIT, overlap: int = OVERLAP, run_limit: int = RUN_LIMIT) -> Column:
    """array<struct<text, overlap_words, fresh_words>> of the pieces of a text; empty for a null or blank one.

    The part between two fresh parts is white space only, so the fresh parts hold every character of
    the text but that. A piece is the last `overlap` words of the piece before, as they stand in the
    text, and the fresh part.
    """
    parts = F.regexp_extract_all(text, F.lit(pattern(limit, overlap, run_limit)), F.lit(0))
    parts = F.transform(parts, lambda x: T.strip(x))
    # the words with the white space before them: their tails are the overlap as printed
    tail_words = lambda x: F.regexp_extract_all(x, F.lit(rf"(?U){_W}+{_S}*"), F.lit(0))

    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        before = F.coalesce(tail_words(last["text"]), F.array().cast("array<string>"))
        look = F.slice(before, F.greatest(F.size(before) - overlap + 1, F.lit(1)), overlap) if overlap else F.array().cast("array<string>")
        joined = F.when(F.size(look) > 0, F.concat(T.strip(F.array_join(look, "")), F.lit(" "), part)).otherwise(part)
        made = F.struct(joined.alias("text"), F.size(look).alias("overlap_words"), T.count_words(part).alias("fresh_words"))
        return F.concat(acc, F.array(made))

    zero = F.array().cast("array<struct<text:string,overlap_words:int,fresh_words:int>>")
    return F.aggregate(F.coalesce(parts, F.array().cast("array<string>")), zero, step)


def split_oversized(
    chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, run_limit: int = RUN_LIMIT, all_rows: bool = False
) -> DataFrame:
    """`(book, chunk_id, piece, pieces, source_pages, text, overlap_words, word_count)` of every chunk over
    the limit, or of every chunk. The stored word_count is not looked at.

    A row given twice counts once; rows of one key with different texts are kept apart by their text.
    Null and blank texts give no piece. Extra columns are left out. No shuffle but for the repeated rows.
    """
    rows = chunks.select("book", "chunk_id", "source_pages", "text")
    n = T.count_words(F.col("text"))
    rows = rows.where((n > 0) if all_rows else (n > limit))
    rows = rows.dropDuplicates(["book", "chunk_id", "text"])
    made = rows.withColumn("made", split_column(F.col("text"), limit, overlap, run_limit))
    return made.select(
        "book", "chunk_id", F.size("made").alias("pieces"), "source_pages", F.posexplode("made").alias("pos", "p")
    ).select(
        "book", "chunk_id", (F.col("pos") + 1).alias("piece"), "pieces", "source_pages", F.col("p.text").alias("text"),
        F.col("p.overlap_words").alias("overlap_words"), (F.col("p.overlap_words") + F.col("p.fresh_words")).alias("word_count"),
    )


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`(book, chunk_id)` of each chunk that the splitter cuts."""
    return split_oversized(chunks, limit).where("piece = 2").select("book", "chunk_id").distinct()
