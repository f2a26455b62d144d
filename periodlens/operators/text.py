"""Text tables: lines and chunks as rows, lexicon counts and their statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.functions import text as fx


def lines(df: DataFrame, text: str) -> DataFrame:
    """One row per trimmed, non-empty line in column ``text``; other columns are kept."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.explode(fx.line_array(text, escaped=False)).alias("text"))


def chunks(df: DataFrame, keys: Sequence[str], text: str, lines: int = 8, keep_empty: bool = False) -> DataFrame:
    """One row per chunk with its position. Rows without text vanish unless ``keep_empty`` (then chunk is NULL)."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return df.select(*keys, explode(fx.chunk(text, lines)).alias("chunk_no", "chunk"))


def lexicon_counts(df: DataFrame, text: str, lexicons: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """``<name>_count`` per lexicon, next to the ``keep`` columns. The text itself is not carried along."""
    counted = df.select(*keep, fx.lexicon_counts(text, list(lexicons.values())).alias("_counts"))
    return counted.select(*keep, *[F.get("_counts", F.lit(i)).alias(f"{n}_count") for i, n in enumerate(lexicons)])


def lexicon_stats(df: DataFrame, by: str, text: str, lexicons: Mapping[str, Sequence[str]]) -> DataFrame:
    """``total_<name>_words`` and ``avg_<name>_per_song`` per group; each text is counted once."""
    counted = lexicon_counts(df, text, lexicons, [by])
    totals = [F.sum(f"{n}_count").alias(f"total_{n}_words") for n in lexicons]
    means = [F.avg(f"{n}_count").alias(f"avg_{n}_per_song") for n in lexicons]
    return counted.groupBy(by).agg(*totals, *means)
