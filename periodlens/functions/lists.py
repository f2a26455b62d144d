"""Lists written as text, circular values, and lists of periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that separate or wrap the entries of a list-like string.
LIST_SEPARATORS = r"""[\[\]'",;]"""


def parse_list(text: Column | str, separators: str = LIST_SEPARATORS) -> Column:
    """``"['A', 'B']"`` or ``"A; B"`` → ``["A", "B"]``; entries trimmed, empty ones dropped."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(text, separators), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def fold_circular(value: Column | str, top: int = 11) -> Column:
    """Distance from the nearer end of ``0..top`` as double; values outside are unknown and give NULL."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.between(0, top), F.least(value, F.lit(top) - value).cast("double"))


def join_periods(periods: Column | str, sep: str = ";") -> Column:
    """Array of periods → text, for the sinks."""
    periods = F.col(periods) if isinstance(periods, str) else periods
    return F.array_join(F.transform(periods, lambda p: p.cast("string")), sep)


def parse_periods(text: Column | str, sep: str = ";") -> Column:
    """Text → array of ints. Blank parts are skipped, ``"2007.0"`` reads as 2007, other text is dropped."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.transform(
        F.split(F.coalesce(text, F.lit("")), sep),
        lambda p: F.trim(p).try_cast("double").try_cast("int"),
    )
    return F.filter(parts, lambda p: p.isNotNull())
