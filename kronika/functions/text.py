"""Text functions as Column expressions.

Everything here stays in the JVM: the folding table is generated from `unicodedata` once per Python
process and becomes literals of the plan.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() also splits at the four information separators; Java's \s does not.
WS = r"(?U)[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]+"


@functools.cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without combining marks: source and target of the one-to-one
    foldings, with the marks, which have no target, at the end of the source; the one-to-many map."""
    one, many, marks = {}, {}, []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one[c] = plain
        elif plain != c:
            many[c] = plain
    return "".join(one) + "".join(marks), "".join(one.values()), many


def strip_marks(text: Column) -> Column:
    """Compatibility decomposition with combining marks removed, letter case kept.

    One `translate` does it for most texts. One-to-many foldings (ligatures, fractions) run only for
    texts that have a character of the ranges in which such characters lie. Precomposed Hangul is left
    as it is. Null stays null.
    """
    source, target, many = _folding()
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")  # folded to one literal
    chars = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    wide = F.when(
        text.rlike(r"[\u00A8-\u00BE\u0132-\u0149\u01C4-\u01F3\u02D8-\u02DD\u037A-\u0385\u0587-\u1FFF\u2017\u2024-\uFFFF\x{10000}-\x{10FFFF}]"),
        F.array_join(chars, ""),
    ).otherwise(text)
    return F.translate(wide, source, target)


def normalize(text: Column) -> Column:
    """Search form: decomposed, marks removed, lower case; `đ` keeps its stroke. Null stays null."""
    return F.lower(strip_marks(text))


def tokens(text: Column) -> Column:
    """Words of the search form, in order; null counts as empty."""
    return F.regexp_extract_all(normalize(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters without white space, in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda x: x != "")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def compact(text: Column) -> Column:
    return F.array_join(words(text), " ")


def strip(text: Column) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(text, f"(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z", "")


def preview(text: Column, limit: int = 240) -> Column:
    c = compact(text)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 3), F.lit("...")))


def _ascii(text: Column) -> Column:
    return F.regexp_replace(strip_marks(F.coalesce(text, F.lit(""))), r"[^\x00-\x7F]", "")


def slug_filename(text: Column) -> Column:
    s = F.regexp_replace(F.replace(_ascii(text), F.lit("_"), F.lit(" ")), r"[^\w\s.-]", "")
    s = F.regexp_replace(s, r"[\s\x1c-\x1f]+", " ")
    s = F.regexp_replace(s, r"^[ .]+|[ .]+\z", "")
    return F.when(s == "", F.lit("book")).otherwise(s)


def slug_name(text: Column) -> Column:
    s = F.replace(F.lower(_ascii(text)), F.lit("_"), F.lit("-"))
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9-]+", "-"), r"^-+|-+\z", "")
    s = F.when(s == "", F.lit("book")).otherwise(s)
    s = F.when(F.length(s) < 3, F.concat(s, F.lit("-rag"))).otherwise(s)
    return F.substring(s, 1, 63)


def collection_name(text: Column) -> Column:
    s = slug_name(text)
    s = F.when(s.rlike("^[a-z0-9]"), s).otherwise(F.concat(F.lit("b-"), s))
    s = F.when(s.rlike("[a-z0-9]\\z"), s).otherwise(F.concat(s, F.lit("0")))
    return F.substring(s, 1, 63)


def page_list(csv: Column) -> Column:
    """A comma list of pages as integers; blank items are skipped, null gives an empty list."""
    items = F.filter(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.transform(items, lambda x: F.trim(x).cast("int"))


def page_citation(pages: Column) -> Column:
    """`p. 12`, `pp. 1-3, 7`; runs of consecutive pages in the given order; none: `page unknown`."""
    run = "struct<s:int,e:int>"
    empty = F.array().cast(f"array<{run}>")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fresh = F.struct(p.cast("int").alias("s"), p.cast("int").alias("e"))
        grown = F.struct(last["s"].alias("s"), p.cast("int").alias("e"))
        return F.when(
            F.size(acc) == 0, F.array(fresh)
        ).when(
            p == last["e"] + 1, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))
        ).otherwise(F.concat(acc, F.array(fresh)))

    runs = F.aggregate(F.filter(pages, lambda x: x.isNotNull()), empty, step)
    label = lambda r: F.when(r["s"] == r["e"], r["s"].cast("string")).otherwise(
        F.concat(r["s"].cast("string"), F.lit("-"), r["e"].cast("string"))
    )
    first = F.try_element_at(runs, F.lit(1))
    several = (F.size(runs) > 1) | (first["s"] != first["e"])
    return F.when(F.coalesce(F.size(runs), F.lit(0)) <= 0, F.lit("page unknown")).otherwise(
        F.concat(F.when(several, F.lit("pp. ")).otherwise(F.lit("p. ")), F.array_join(F.transform(runs, label), ", "))
    )


def duration(seconds: Column) -> Column:
    total = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60), F.pmod(total, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h.cast("bigint"), m.cast("bigint"), s)).otherwise(
        F.format_string("%02d:%02d", m.cast("bigint"), s)
    )


def contains_any(text: Column, phrases: list[str]) -> Column:
    """OR of plain `contains`, which stays inside generated code; an empty list is false."""
    return functools.reduce(lambda a, b: a | b, [text.contains(p) for p in phrases], F.lit(False))


def starts_with_any(text: Column, phrases: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.startswith(p) for p in phrases], F.lit(False))


def count_contained(text: Column, phrases: list[str]) -> Column:
    return functools.reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases], F.lit(0))


def date_number(date: Column) -> Column:
    """Pseudo-day number of a `YYYY-MM-DD` text, without a calendar check; null for any other text."""
    d = strip(date)
    part = lambda i: F.get(F.split(d, "-"), F.lit(i)).cast("int")
    return F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}\z"), part(0) * 372 + part(1) * 31 + part(2))


def date_distance(left: Column, right: Column) -> Column:
    return F.abs(date_number(left) - date_number(right))


def longer_text(current: Column, candidate: Column) -> Column:
    """The stripped text that is longer; the current one on ties and where the candidate is empty."""
    a, b = strip(F.coalesce(current, F.lit(""))), strip(F.coalesce(candidate, F.lit("")))
    return F.when(F.length(b) > F.length(a), b).otherwise(a)


def clip(text: Column, limit: int) -> Column:
    cut = F.rtrim(F.substring(text, 1, limit - 3), F.lit(" ,;:-"))
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("..."))).otherwise(text)


def combine_notes(left: Column, right: Column, limit: int = 700) -> Column:
    a, b = compact(left), compact(right)
    both = F.when(a == "", b).when((b == "") | (a == b), a).otherwise(F.concat_ws(" ", a, b))
    return clip(both, limit)


# Sentences with one of these are remarks on the records, not on the events.
META_MARKERS: list[str] = [
    "estimated", "estimate", "chapter range", "source text", "context indicates", "best date", "placed at", "placed in",
    "exact date not given", "date reflects", "date retained", "interpreted as", "unsupported", "candidate",
    "roman numeral date",
]


def trim_note(text: Column, markers: list[str] = META_MARKERS, limit: int = 500) -> Column:
    """Drop sentences that contain a marker (plain lower case); keep the whole where nothing is left."""
    c = compact(text)
    kept = F.array_join(
        F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: ~contains_any(F.lower(s), markers) & (s != "")), " "
    )
    return clip(F.when(kept == "", c).otherwise(kept), limit)


def clean_operation(text: Column, limit: int = 100) -> Column:
    c = F.trim(F.btrim(compact(text), F.lit("\"'")))
    prefix = lambda sep: F.when(c.contains(sep), F.nullif(F.trim(F.substring_index(c, sep, 1)), F.lit("")))
    short = F.coalesce(prefix(" – "), prefix(": "), prefix("; "), F.rtrim(F.substring(c, 1, limit), F.lit(" ,;:-")))
    return F.when(F.length(c) <= limit, c).otherwise(short)
