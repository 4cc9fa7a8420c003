"""Similarity of names: the ratio of matching blocks as Python's difflib computes it, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 where either is null. The order of the arguments matters, as in difflib."""
    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio cannot exceed, by length alone."""
    la, lb = F.length(a), F.length(b)
    return F.coalesce(2.0 * F.least(la, lb) / F.nullif(la + lb, F.lit(0)), F.lit(1.0))
