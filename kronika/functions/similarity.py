"""Ratcliff-Obershelp similarity, the one text function Catalyst has nothing like."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def plain_normalize(text: str | None) -> str:
    """The search form in Python, for folds that run there."""
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()


def plain_ratio(left: str, right: str) -> float:
    """Of texts as they stand."""
    return SequenceMatcher(None, left, right).ratio()


def ratio(left: str | None, right: str | None) -> float:
    """Of normalised texts; two empty ones are alike. The order of the arguments matters for long texts."""
    return plain_ratio(plain_normalize(left), plain_normalize(right))


def alike(left: str | None, right: str | None, least: float) -> bool:
    """Whether the ratio reaches `least`; the cheap upper bounds, by length and by letters, are asked first."""
    m = SequenceMatcher(None, plain_normalize(left), plain_normalize(right))
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def text_similarity(left: Column, right: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")(left, right)
