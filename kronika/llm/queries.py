"""Queries of the training-data operators, and their SQL where SQL can say the same on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kronika.llm import encoding, leakage, near_records, packing, quality, scans, splitting, survivors, truncation

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Query]:
    t = _table
    corpus = lambda s, d: [(t(s, d, "pages"), "text"), (t(s, d, "documents"), "text")]
    scanned = lambda s, d: (t(s, d, "pages"), t(s, d, "cleaned_pages"), t(s, d, "metadata"), [(t(s, d, "documents"), "text")])
    return {
        "p1_found": lambda s, d: splitting.oversized(t(s, d, "chunks")),
        "p1_pieces": lambda s, d: splitting.split_oversized(t(s, d, "chunks")),
        "p2_found": lambda s, d: quality.found(t(s, d, "chunks"), t(s, d, "pages"), t(s, d, "common_words")),
        "p2_statistics": lambda s, d: quality.report(t(s, d, "chunks"), t(s, d, "common_words")),
        "p2_pages": lambda s, d: quality.page_report(t(s, d, "pages"), t(s, d, "common_words")),
        "p2_wrong_counts": lambda s, d: quality.wrong_counts(t(s, d, "pages")),
        "p3_found": lambda s, d: scans.found(*scanned(s, d)),
        "p3_repaired": lambda s, d: scans.repaired(*scanned(s, d)),
        "p4_found": lambda s, d: encoding.found(t(s, d, "metadata"), corpus(s, d)),
        "p4_restored": lambda s, d: encoding.restored(t(s, d, "metadata"), corpus(s, d)),
        "p5_found": lambda s, d: survivors.survivors(t(s, d, "movements")),
        "p5_best": lambda s, d: survivors.build_best(t(s, d, "movements")),
        "p6_found": lambda s, d: near_records.near_pairs(t(s, d, "movements")),
        "p6_classes": lambda s, d: near_records.classes(t(s, d, "movements")),
        "p6_groups": lambda s, d: near_records.near_groups(t(s, d, "movements")),
        "p7_windows": lambda s, d: packing.windows(t(s, d, "documents")),
        "p7_report": lambda s, d: packing.window_report(t(s, d, "documents")),
        "p8_found": lambda s, d: leakage.found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_report": lambda s, d: leakage.report(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_found": lambda s, d: truncation.found(t(s, d, "documents")),
        "p9_by_source": lambda s, d: truncation.by_source(t(s, d, "documents")),
    }


_WORDS = r"list_distinct(regexp_extract_all(lower(strip_accents(concat_ws(' ', place, operation, notes))), '[\p{L}\p{N}]+'))"


_PLAIN = r"regexp_replace(regexp_replace(lower(strip_accents(coalesce({}, ''))), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'), '\s+', '', 'g')"


def _date_sql() -> str:
    """[year, month, day] of a date text, as `survivors.parse_date` reads it."""
    s = r"lower(trim(regexp_replace(coalesce(date, ''), '\s+', ' ', 'g')))"
    n = lambda p, g: f"try_cast(nullif(regexp_extract({s}, '{p}', {g}), '') AS INT)"
    ymd, named = r"^(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?\.?$", r"^(?:.* )?(?:(\d{1,2})\.? )?(\p{L}+),? (\d{4})\.?$"
    dot, slash = r"^(\d{1,2})\. ?(\d{1,2})\. ?(\d{4})\.?$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    names = "map {" + ", ".join(f"'{x}': {i + 1}" for i, m in enumerate(survivors.MONTHS) for x in m) + "}"
    y = f"coalesce({n(ymd, 1)}, {n(dot, 3)}, {n(slash, 3)}, {n(named, 3)}, {n(r'^(\d{4})\.?$', 1)})"
    m = f"coalesce({n(ymd, 2)}, {n(dot, 2)}, {n(slash, 2)}, {names}[regexp_extract({s}, '{named}', 2)])"
    d = f"coalesce({n(ymd, 3)}, {n(dot, 1)}, {n(slash, 1)}, {n(r'^(?:.* )?(\d{1,2})\.? (\p{L}+),? (\d{4})\.?$', 1)})"
    mm = f"CASE WHEN {m} BETWEEN 1 AND 12 THEN {m} END"
    last = f"day(last_day(make_date(coalesce({y}, 2000), {mm}, 1)))"
    return f"[{y}, CASE WHEN {y} IS NOT NULL THEN {mm} END, CASE WHEN {y} IS NOT NULL AND {mm} IS NOT NULL AND {d} BETWEEN 1 AND {last} THEN {d} END]"


_DATE = _date_sql()


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            SELECT DISTINCT book, chunk_id FROM chunks
            WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 200""",
        "p2_wrong_counts": r"""
            SELECT DISTINCT book, page_number, word_count, n_words FROM (
                SELECT book, page_number, word_count, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))::INT AS n_words FROM pages)
            WHERE word_count IS NULL OR word_count <> n_words""",
        "p5_found": rf"""
            WITH RECURSIVE m AS (
                SELECT movement_id AS id, book, {_PLAIN.format("place")} AS p, {_PLAIN.format("operation")} AS o, extracted_at, {_DATE} AS d,
                    list_distinct(list_filter(coalesce(source_chunk_ids, []::INT[]), lambda x: x IS NOT NULL)) AS ch,
                    coalesce(coordinates.lat BETWEEN 42 AND 47 AND coordinates.lng BETWEEN 13 AND 20, false)::INT AS pt
                FROM movements),
            l AS (
                SELECT a.id AS x, b.id AS y FROM m a JOIN m b ON a.book = b.book AND a.p = b.p AND a.o = b.o AND a.id <> b.id
                WHERE a.p <> '' AND a.o <> '' AND list_has_any(a.ch, b.ch) AND (a.d[1] IS NULL OR b.d[1] IS NULL OR (a.d[1] = b.d[1] AND (a.d[2] IS NULL OR b.d[2] IS NULL OR (
                    a.d[2] = b.d[2] AND (a.d[3] IS NULL OR b.d[3] IS NULL OR a.d[3] = b.d[3])))))),
            r AS (SELECT DISTINCT x AS id, x AS root FROM l UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id),
            g AS (SELECT id, min(root) AS group_id FROM r GROUP BY id),
            k AS (SELECT group_id, id AS survivor_id, row_number() OVER (PARTITION BY group_id ORDER BY (d[3] IS NOT NULL)::INT + pt DESC, len(ch) DESC, extracted_at DESC NULLS LAST, id) AS n FROM g JOIN m USING (id))
            SELECT group_id, survivor_id FROM k WHERE n = 1""",
        "p6_found": f"""
            WITH r AS (
                SELECT DISTINCT ON (movement_id) movement_id AS id, {_WORDS} AS w
                FROM movements WHERE notes IS NOT NULL AND trim(notes) <> ''
            ), p AS (
                SELECT a.id AS x, b.id AS y, len(list_intersect(a.w, b.w)) AS c, len(a.w) + len(b.w) AS n
                FROM r a JOIN r b ON a.id < b.id
            )
            SELECT x AS movement_id_a, y AS movement_id_b FROM p WHERE c > 0 AND 5 * c >= 3 * (n - c)""",
    }
