"""difflib's ratio and unified diffs, for the pairs that built-ins can't settle."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def ratio(a: str | None, b: str | None) -> float:
    return 1.0 if a == b else difflib.SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(StringType())
def unified_diff(a: pd.Series, b: pd.Series, label: pd.Series) -> pd.Series:
    """Labels old/<label> and new/<label>; equal texts give ''."""

    def one(x: str | None, y: str | None, name: str) -> str:
        lines = difflib.unified_diff((x or "").splitlines(keepends=True), (y or "").splitlines(keepends=True), f"old/{name}", f"new/{name}")
        return "".join(lines)

    return pd.Series([one(*row) for row in zip(a, b, label)])
