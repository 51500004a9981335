"""Text functions without a JVM counterpart, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("double")
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two titles in lower case, null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
