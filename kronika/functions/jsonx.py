"""Tolerant reading of JSON that a model wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object_text(raw: Column) -> Column:
    """The object in a fenced block, else from the first `{` to the last `}`; trailing commas are dropped only
    where the text can't be read with them. Null where there is no object that can be read."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    first, last = F.locate("{", raw), F.length(raw) - F.locate("}", F.reverse(raw)) + 1
    bare = F.when((first > 0) & F.contains(raw, F.lit("}")) & (last > first), F.substring(raw, first, last - first + 1))
    text = F.when(fenced != "", fenced).otherwise(bare)
    mended = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    ok = lambda t: F.try_parse_json(t).isNotNull()
    return F.when(ok(text), text).when(ok(mended), mended)
