"""Votes of many change analyses over months."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodlens.functions.lists import join_periods, parse_periods
from periodlens.operators import changepoint, cluster, consensus, mix, series
from periodlens.plans import synthesis
from periodlens.queries.inputs import events, lineitem, month_scores, month_series, supplier_series
from periodlens.queries.sql import CHOSEN, MONTH, MONTH_SCORES, PETTITT, SUPPLIER_SERIES, eras, mix_points, month_means, partitions


def _signals(spark, sf):
    """Breaks of the monthly features, kept as text in between, and the ranked break of every supplier."""
    found = changepoint.detect(month_scores(spark, sf), 5).select("series", join_periods("breaks").alias("breaks"))
    features = consensus.signal(found.select("series", F.explode(parse_periods("breaks")).alias("t")), "feature", 1)
    ranked = changepoint.pettitt(supplier_series(spark, sf)).select("series", F.col("break_t").alias("t"))
    return consensus.signals(features, consensus.signal(ranked, "supplier", 2, suffix=" (Pettitt)"))


def _spine(spark, sf):
    return lineitem(spark, sf).select(F.col("m").alias("t")).distinct()


def _voted(spark, sf):
    return consensus.vote(_signals(spark, sf), _spine(spark, sf))


def signals(spark, sf):
    return _signals(spark, sf)


def signal_listing(spark, sf):
    return consensus.listing(_signals(spark, sf)).select("ord", "grp", "signal", join_periods("periods").alias("periods"))


def consensus_votes(spark, sf):
    """Votes of the feature analyses with their names: breaks and ranked break of every feature."""
    scores = month_scores(spark, sf)
    found = changepoint.detect(scores, 5).select("series", F.explode("breaks").alias("t"))
    ranked = changepoint.pettitt(scores).select("series", F.col("break_t").alias("t"))
    both = consensus.signals(
        consensus.signal(found, "feature", 1), consensus.signal(ranked, "ranked", 2, suffix=" (Pettitt)")
    )
    return consensus.vote(both, _spine(spark, sf), names=True)


def supplier_votes(spark, sf):
    """Votes of the features and of every supplier, counted only."""
    return _voted(spark, sf)


def supplier_voters(spark, sf):
    return consensus.voters(_signals(spark, sf), _spine(spark, sf))


def consensus_top(spark, sf):
    return consensus.top(_voted(spark, sf))


def consensus_peaks(spark, sf):
    return consensus.peaks(_voted(spark, sf))


def synthesis_votes(spark, sf):
    """Cluster boundaries, joint breaks, ranked breaks and feature breaks voted over all months."""
    items = lineitem(spark, sf)
    long = month_series(spark, sf)
    joint = ("l_quantity", "l_discount")
    mood = cluster.by_means(items, "m", list(joint))
    kinds = cluster.by_mix(items, "m", "l_returnflag")
    shares = mix.category_mix(items, "m", "l_returnflag").selectExpr("l_returnflag AS series", "m AS t", "round(share, 6) AS x")
    found = synthesis.collect(
        long, joint, {"means clusters": (mood.clusters, "eras"), "mix clusters": (kinds.clusters, "mix")}, "m", shares
    )
    return consensus.vote(found, items.select(F.col("m").alias("t")).distinct(), names=True)


def synthesis_given(spark, sf):
    """All signals of the synthesis against eras that are given, with names and groups of their own."""
    items = lineitem(spark, sf)
    months = month_series(spark, sf).select(F.col("t").alias("m")).distinct()
    shares = mix.category_mix(items, "m", "l_returnflag").selectExpr("l_returnflag AS series", "m AS t", "round(share, 6) AS x")
    return synthesis.collect(
        month_series(spark, sf), ("l_quantity", "l_discount"),
        {"two years": (months.withColumn("cluster", F.expr("m div 24")), "eras"),
         "five years": (months.withColumn("cluster", F.expr("m div 60")), "long eras")}, "m", shares,
        names={"l_tax": ("rate of tax", "money")},
    )


QUERIES = {
    f.__name__: f
    for f in (
        signals, signal_listing, consensus_votes, supplier_votes, supplier_voters, consensus_top, consensus_peaks,
        synthesis_votes, synthesis_given,
    )
}

_SIGNALS = f"""{MONTH_SCORES}, uni AS (SELECT series, '' AS dim, t, x FROM long), {partitions(5, 'uni')}, {CHOSEN},
    {SUPPLIER_SERIES.replace('long AS', 'sup AS', 1)}, {PETTITT.replace('FROM long a JOIN long b', 'FROM sup a JOIN sup b')},
    sig AS (SELECT series AS signal, 'feature' AS grp, 1 AS ord, unnest(string_split(path, ';'))::INTEGER AS t
            FROM chosen WHERE path <> ''
            UNION ALL SELECT series || ' (Pettitt)', 'supplier', 2, break_t FROM pettitt)"""
_FEATURE_SIGNALS = f"""{MONTH_SCORES}, uni AS (SELECT series, '' AS dim, t, x FROM long), {partitions(5, 'uni')}, {CHOSEN},
    {PETTITT},
    sig AS (SELECT series AS signal, 'feature' AS grp, 1 AS ord, unnest(string_split(path, ';'))::INTEGER AS t
            FROM chosen WHERE path <> ''
            UNION ALL SELECT series || ' (Pettitt)', 'ranked', 2, break_t FROM pettitt)"""
_COUNT = f"""spine AS (SELECT DISTINCT {MONTH} AS t FROM lineitem),
    direct AS (SELECT t, count(*) AS votes, string_agg(signal, '; ' ORDER BY ord, signal) AS signals FROM sig GROUP BY 1),
    near AS (SELECT s.t, count(*) AS c FROM spine s JOIN sig g ON abs(g.t - s.t) <= 1
             WHERE g.t IN (SELECT t FROM spine) GROUP BY 1),
    voted AS (SELECT s.t, coalesce(votes, 0) AS votes, coalesce(c, 0) AS votes_pm1, coalesce(signals, '') AS signals
              FROM spine s LEFT JOIN direct d ON s.t = d.t LEFT JOIN near n ON s.t = n.t)"""
_VOTES = f"{_SIGNALS}, {_COUNT}"

def _all(spans: str, of_spans: str, shown: str = "series", grp: str = "'feature'") -> str:
    """All signals as ``sig``; ``of_spans`` selects those of the eras that ``spans`` defines."""
    return f"""{MONTH_SCORES.split(', long AS', 1)[0]}, mixed AS (
        SELECT l_returnflag, t, round(n::DOUBLE / sum(n) OVER (PARTITION BY t), 6) AS x
        FROM (SELECT l_returnflag, {MONTH} AS t, count(*) AS n FROM lineitem GROUP BY 1, 2)),
    both_parts AS (SELECT 'l_quantity x l_discount' AS series, series AS dim, t, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x
        FROM raw WHERE series IN ('l_quantity', 'l_discount') WINDOW w AS (PARTITION BY series)),
    uni AS (SELECT * FROM both_parts
        UNION ALL SELECT series, '', t, x FROM raw WHERE series NOT IN ('l_quantity', 'l_discount')
        UNION ALL SELECT 'label:' || l_returnflag, '', t, x FROM mixed),
    {partitions(8, 'uni')},
    able AS (SELECT * FROM parts WHERE series <> 'l_quantity x l_discount' OR m <= 5), {CHOSEN.replace('FROM parts', 'FROM able')},
    long AS (SELECT series, t, x FROM raw UNION ALL SELECT 'label:' || l_returnflag, t, x FROM mixed), {PETTITT},
    single AS (SELECT c.series, CASE WHEN m < 8 THEN path ELSE break_t::VARCHAR END AS path, m < 8 AS reliable
               FROM chosen c JOIN pettitt q ON c.series = q.series),
    {spans},
    sig AS (
        {of_spans}
        UNION ALL SELECT series || ' change-points', 'joint', 1, unnest(string_split(path, ';'))::INTEGER FROM chosen
            WHERE series = 'l_quantity x l_discount' AND path <> ''
        UNION ALL SELECT series || ' (Pettitt)', 'joint', 1, break_t FROM pettitt WHERE series IN ('l_quantity', 'l_discount')
        UNION ALL SELECT {shown} || CASE WHEN reliable THEN '' ELSE ' (Pettitt)' END,
            {grp}, 2, unnest(string_split(path, ';'))::INTEGER FROM single
            WHERE series NOT LIKE 'label:%' AND path <> ''
        UNION ALL SELECT substr(series, 7) || ' (label)', 'label', 3, unnest(string_split(path, ';'))::INTEGER FROM single
            WHERE series LIKE 'label:%' AND path <> '')"""


_GIVEN = _all(
    "spans AS (SELECT DISTINCT t, t // 24 AS a, t // 60 AS b FROM raw)",
    """SELECT 'two years' AS signal, 'eras' AS grp, 0 AS ord, t FROM spans QUALIFY a <> lag(a) OVER (ORDER BY t)
        UNION ALL SELECT 'five years', 'long eras', 0, t FROM spans QUALIFY b <> lag(b) OVER (ORDER BY t)""",
    "CASE series WHEN 'l_tax' THEN 'rate of tax' ELSE series END", "CASE series WHEN 'l_tax' THEN 'money' ELSE 'feature' END",
)
# Eras by means and by mix are both fitted; the tables of the first one are renamed apart.
_FITTED = _all(
    f"""spans AS (WITH {month_means(("l_quantity", "l_discount"))}, {eras("pts")} SELECT p AS t, cluster AS c FROM era),
    mixes AS (WITH {mix_points(MONTH, "l_returnflag", "lineitem")}, {eras("pts")} SELECT p AS t, cluster AS c FROM era)""",
    """SELECT 'means clusters' AS signal, 'eras' AS grp, 0 AS ord, t FROM spans QUALIFY c <> lag(c) OVER (ORDER BY t)
        UNION ALL SELECT 'mix clusters', 'mix', 0, t FROM mixes QUALIFY c <> lag(c) OVER (ORDER BY t)""",
)

ORACLES = {
    "synthesis_votes": f"WITH {_FITTED}, {_COUNT} SELECT * FROM voted",
    "synthesis_given": f"WITH {_GIVEN} SELECT signal, grp, ord, t FROM sig",
    "signals": f"WITH {_SIGNALS} SELECT signal, grp, ord, t FROM sig",
    "signal_listing": f"""WITH {_SIGNALS} SELECT ord, grp, signal, string_agg(t::VARCHAR, ';' ORDER BY t) AS periods
        FROM sig GROUP BY 1, 2, 3""",
    "consensus_votes": f"WITH {_FEATURE_SIGNALS}, {_COUNT} SELECT * FROM voted",
    "supplier_votes": f"WITH {_VOTES} SELECT t, votes, votes_pm1 FROM voted",
    "supplier_voters": f"WITH {_VOTES} SELECT t, ord, grp, signal FROM sig WHERE t IN (SELECT t FROM spine)",
    "consensus_top": f"""WITH {_VOTES} SELECT t, votes, votes_pm1 FROM voted WHERE votes > 0
        ORDER BY votes DESC, votes_pm1 DESC, t LIMIT 12""",
    "consensus_peaks": f"WITH {_VOTES} SELECT t, votes, votes_pm1 FROM voted WHERE votes_pm1 >= 5",
}
