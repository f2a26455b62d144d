"""All analyses of one table as signals, and the vote over periods."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.operators import changepoint, consensus, series
from periodlens.plans import changes
from periodlens.sources.tables import settle


def cluster_signal(clusters: DataFrame, period: str, name: str, grp: str, ord_: int) -> DataFrame:
    labelled = clusters.select(F.lit(name).alias("series"), F.col(period).alias("t"), F.col("cluster").alias("label"))
    return consensus.signal(series.boundaries(labelled), grp, ord_)


def collect(
    features: DataFrame,
    joint: tuple[str, ...],
    clusters: Mapping[str, tuple[DataFrame, str]],
    period: str,
    label_shares: DataFrame | None = None,
    cap: int = changepoint.REPORT_CAP,
    names: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Signals of cluster boundaries, joint breaks, ranked breaks, each feature's breaks and label shares.

    ``features`` and ``label_shares`` are long tables; ``clusters`` maps a signal name to its clustered
    periods and group; ``names`` maps a single series to its displayed name and its group, which is "feature"
    otherwise. Where a search hits its cap the ranked break stands in. Both long tables are settled first.
    """
    features = settle(features, "features")
    shown = names or {}
    parts = [
        cluster_signal(table, period, name, grp, 0) for name, (table, grp) in clusters.items()
    ]
    name = " x ".join(joint)
    both = changepoint.detect(changes.standardised(features, joint, name))
    parts.append(
        consensus.signal(both.select("series", F.explode("breaks").alias("t")), "joint", 1, suffix=" change-points")
    )
    ranked = changepoint.pettitt(features.filter(F.col("series").isin(list(joint))))
    parts.append(consensus.signal(ranked.select("series", F.col("break_t").alias("t")), "joint", 1, suffix=" (Pettitt)"))
    single = features.filter(~F.col("series").isin(list(joint)))
    report = settle(changes.report(single, cap), "report")
    groups: dict[str, list[str]] = {}
    for series_name, (_, grp) in shown.items():
        groups.setdefault(grp, []).append(series_name)
    for grp, members in groups.items():
        renamed = F.create_map(*[F.lit(x) for m in members for x in (m, shown[m][0])])
        mine = report.filter(F.col("series").isin(members)).withColumn("series", renamed[F.col("series")])
        parts.append(consensus.reliable_breaks(mine, grp, 2))
    rest = report.filter(~F.col("series").isin(list(shown))) if shown else report
    parts.append(consensus.reliable_breaks(rest, "feature", 2))
    if label_shares is not None:
        label_shares = settle(label_shares, "shares")
        parts.append(consensus.reliable_breaks(changes.report(label_shares, cap), "label", 3, mark="", suffix=" (label)"))
    return consensus.signals(*parts)
