"""Votes of many analyses over periods. Input: signals as rows ``(signal, grp, ord, t)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signal(breaks: DataFrame, grp: str, ord_: int, name: str | None = None, suffix: str = "") -> DataFrame:
    """``(series, t)`` → signal rows; ``name`` replaces the series name. ``ord_`` is the group's place in listings."""
    named = F.lit(name) if name else F.concat(F.col("series"), F.lit(suffix))
    return breaks.select(named.alias("signal"), F.lit(grp).alias("grp"), F.lit(ord_).alias("ord"), "t")


def reliable_breaks(report: DataFrame, grp: str, ord_: int, mark: str = " (Pettitt)", suffix: str = "") -> DataFrame:
    """Signals of a change report: its breaks, or the single ranked break where the search hit its cap."""
    chosen = F.when(F.col("reliable"), F.col("breaks")).otherwise(F.array("pettitt_t"))
    name = F.concat("series", F.when(F.col("reliable"), F.lit("")).otherwise(F.lit(mark)), F.lit(suffix))
    return report.select(name.alias("signal"), F.lit(grp).alias("grp"), F.lit(ord_).alias("ord"), F.explode(chosen).alias("t"))


def signals(*parts: DataFrame) -> DataFrame:
    """All signals in one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vote(votes: DataFrame, spine: DataFrame, tol: int = 1, names: bool = False) -> DataFrame:
    """``t, votes, votes_pm<tol>[, signals]`` for every period of the spine; votes outside it do not count.

    Each vote is spread to the periods within ``tol`` and everything is one aggregate, so no window runs over
    the whole spine. ``names`` lists the voters of a period in one row, in signal order: for a fixed set of analyses
    only. Where every entity casts a vote, :func:`voters` has them as rows.
    """
    near = votes.join(spine, "t", "left_semi").select(
        "signal", "ord", F.explode(F.sequence(F.col("t") - tol, F.col("t") + tol)).alias("t2"), F.col("t").alias("t1")
    )
    direct = F.col("t1") == F.col("t2")
    listed = F.array_sort(F.collect_list(F.when(direct, F.struct("ord", "signal"))))
    aggs = [F.count_if(direct).alias("votes"), F.count("*").alias(f"votes_pm{tol}")]
    if names:
        aggs.append(F.array_join(F.transform(listed, lambda s: s["signal"]), "; ").alias("signals"))
    counted = near.groupBy(F.col("t2").alias("t")).agg(*aggs)
    out = spine.select("t").distinct().join(counted, "t", "left").na.fill(0, ["votes", f"votes_pm{tol}"])
    return out.na.fill("", ["signals"]) if names else out


def voters(votes: DataFrame, spine: DataFrame) -> DataFrame:
    """Who voted when, one row per vote on the spine."""
    return votes.join(spine, "t", "left_semi").select("t", "ord", "grp", "signal")


def top(voted: DataFrame, n: int = 12, tol: int = 1) -> DataFrame:
    """The n periods with most votes, then most smoothed votes, then earliest; periods without a vote never."""
    return voted.filter("votes > 0").orderBy(F.desc("votes"), F.desc(f"votes_pm{tol}"), "t").limit(n)


def peaks(voted: DataFrame, least: int = 5, tol: int = 1) -> DataFrame:
    return voted.filter(F.col(f"votes_pm{tol}") >= least)


def listing(votes: DataFrame) -> DataFrame:
    """Signals with their periods, in group order then name."""
    grouped = votes.groupBy("ord", "grp", "signal").agg(F.array_sort(F.collect_list("t")).alias("periods"))
    return grouped.orderBy("ord", "signal")
