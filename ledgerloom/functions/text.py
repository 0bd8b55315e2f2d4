"""Sequence similarity of two texts: the one function that needs Python."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matching_share(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def _matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([matching_share(x, y) for x, y in zip(a, b)], dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    """Share of matching blocks, order of arguments kept. Score distinct text pairs only."""
    return _matcher_ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def ratio_bound(a: Column, b: Column) -> Column:
    """No similarity is above this, from the lengths alone."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / (la + lb))
