"""Row filters applied right after the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window(
    df: DataFrame,
    period: str,
    lo,
    hi,
    ranges: Mapping[str, tuple] | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Keep periods in ``lo..hi`` and values inside their closed ranges; drop rows with a NULL in ``required``."""
    keep = F.col(period).between(lo, hi)
    for name, (low, high) in (ranges or {}).items():
        keep = keep & F.col(name).between(low, high)
    out = df.filter(keep)
    return out.dropna("any", subset=list(required)) if required else out


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col) > 0)


def with_unit(df: DataFrame, col: str, divisor: float, name: str) -> DataFrame:
    """Derived unit, such as milliseconds to seconds."""
    return df.withColumn(name, F.col(col) / F.lit(float(divisor)))
