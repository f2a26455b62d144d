"""Change points in monthly and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodlens.functions.lists import join_periods
from periodlens.operators import changepoint, cluster, mix, series
from periodlens.plans import changes as plans
from periodlens.queries.inputs import FEATURES, day_series, events, lineitem, month_scores, month_series, rounded, supplier_series
from periodlens.queries.sql import (
    CHOSEN, DAY, DAY_SERIES, MONTH_SCORES, MONTH_SERIES, PETTITT, SUPPLIER_SERIES, eras, month_means, partitions,
)

JOINT = ("l_quantity", "l_extendedprice")


def prefix_sums(spark, sf):
    return rounded(changepoint.prefix_sums(month_scores(spark, sf)).drop("dim"))


def segment_cost(spark, sf):
    """Every calendar year as one segment of the monthly scores."""
    scores = month_scores(spark, sf)
    years = scores.filter(F.col("t") % 12 == 0).select("series", "t")
    return rounded(changepoint.segment_cost(scores, years))


def optimal_partition(spark, sf):
    out = changepoint.partition(month_scores(spark, sf), 5)
    return rounded(out.withColumn("breaks", join_periods("breaks")))


def change_points(spark, sf):
    out = changepoint.detect(month_scores(spark, sf), 5)
    return rounded(out.withColumn("breaks", join_periods("breaks")))


def change_points_raw(spark, sf):
    """Breaks of the monthly means as they are, large levels and small ones."""
    out = changepoint.detect(month_series(spark, sf), 5).select("series", "n", "m", join_periods("breaks").alias("breaks"))
    return out


def change_points_shifted(spark, sf):
    """The same means on a level of a thousand million: the breaks stay where they are."""
    raised = month_series(spark, sf).withColumn("x", F.col("x") + F.lit(1e9))
    return changepoint.detect(raised, 5).select("series", "n", "m", join_periods("breaks").alias("breaks"))


def change_report_raw(spark, sf):
    out = plans.report(month_series(spark, sf), cap=8)
    return rounded(out.withColumn("breaks", join_periods("breaks")))


def change_points_joint(spark, sf):
    out = changepoint.detect(plans.standardised(month_series(spark, sf), JOINT, "joint"), 5)
    return rounded(out.withColumn("breaks", join_periods("breaks")))


def elbow_pick(spark, sf):
    """Elbow of each series' curve of squared error over the number of breaks."""
    curve = changepoint.partition(month_scores(spark, sf), 5).select("series", F.col("m").alias("k"), F.col("sse").alias("cost"))
    return rounded(cluster.elbow(curve, ("series",)))


def pettitt(spark, sf):
    return rounded(changepoint.pettitt(month_series(spark, sf)), 9)


def supplier_pettitt(spark, sf):
    return rounded(changepoint.pettitt(supplier_series(spark, sf)), 9)


def change_report(spark, sf):
    out = plans.report(month_scores(spark, sf), cap=8)
    return rounded(out.withColumn("breaks", join_periods("breaks")))


def label_boundaries(spark, sf):
    """Days on which the most frequent event type changes."""
    top = mix.dominant_category(events(spark, sf), "day", "event_type")
    labelled = top.select(F.lit("top").alias("series"), F.col("day").alias("t"), F.col("dominant_event_type").alias("label"))
    return series.boundaries(labelled)


def boundary_agreement(spark, sf):
    """Breaks of the daily mean with exactly three breaks that lie within a day of a change of the top event type."""
    best = changepoint.partition(day_series(spark, sf), 3).filter("m = 3")
    return changepoint.agreement(best.select(F.explode("breaks").alias("t")), label_boundaries(spark, sf), tol=1)


def mood_report(spark, sf):
    """Joint breaks, ranked breaks and cluster boundaries of two features."""
    found = cluster.by_means(lineitem(spark, sf), "m", list(JOINT))
    return rounded(plans.mood(month_series(spark, sf), JOINT, found.clusters, "m"))


def mood_report_given(spark, sf):
    """The same report against eras that are given: two years each."""
    months = month_series(spark, sf).select(F.col("t").alias("m")).distinct()
    return rounded(plans.mood(month_series(spark, sf), JOINT, months.withColumn("cluster", F.expr("m div 24")), "m"))


QUERIES = {
    f.__name__: f
    for f in (
        prefix_sums, segment_cost, optimal_partition, change_points, change_points_raw, change_points_shifted,
        change_points_joint, elbow_pick, pettitt, supplier_pettitt, change_report, change_report_raw, label_boundaries, boundary_agreement, mood_report,
        mood_report_given,
    )
}

_ONE_DIM = "uni AS (SELECT series, '' AS dim, t, x FROM long)"
_FOUND = "SELECT series, n::INTEGER AS n, d::INTEGER AS d, m::INTEGER AS m, round(sse, 6) AS sse, {extra} path AS breaks FROM {table}"
_PET = "SELECT series, n, k, break_t, round(p, 9) AS p FROM pettitt"
_RAW = f"""WITH {MONTH_SERIES}, {_ONE_DIM}, {partitions(5, 'uni')}, {CHOSEN}
    SELECT series, n::INTEGER AS n, m::INTEGER AS m, path AS breaks FROM chosen"""


def _report(source: str) -> str:
    return f"""WITH {source}, {_ONE_DIM}, {partitions(8, 'uni')}, {CHOSEN}, {PETTITT}
        SELECT c.series, c.n::INTEGER AS n_periods, m::INTEGER AS n_change_points, path AS breaks, m < 8 AS reliable,
            break_t AS pettitt_t, k AS pettitt_k, round(p, 6) AS pettitt_p, p < 0.05 AS pettitt_significant
        FROM chosen c LEFT JOIN pettitt q ON c.series = q.series"""


def _mood(edges: str) -> str:
    """The report with boundaries from the table expressions ``edges``."""
    return f"""WITH {MONTH_SERIES.replace('long AS (', 'raw AS (', 1)}, multi AS (
        SELECT 'l_quantity+l_extendedprice' AS series, series AS dim, t, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x
        FROM raw WHERE series IN ('l_quantity', 'l_extendedprice') WINDOW w AS (PARTITION BY series)),
        {partitions(5, 'multi')}, {CHOSEN},
        long AS (SELECT * FROM raw WHERE series IN ('l_quantity', 'l_extendedprice')), {PETTITT},
        {edges},
        found AS (SELECT unnest(string_split(path, ';'))::INTEGER AS t FROM chosen WHERE path <> ''),
        near AS (SELECT DISTINCT f.t FROM found f JOIN edges e ON abs(f.t - e.t) <= 1),
        out AS (SELECT 'optimal_partition_bic' AS method, series AS target, m::INTEGER AS n_change_points, path AS break_periods,
                    NULL::DOUBLE AS p_value FROM chosen
                UNION ALL SELECT 'pettitt', series, 1, break_t::VARCHAR, round(p, 6) FROM pettitt
                UNION ALL SELECT 'kmeans_cluster_boundaries', 'l_quantity+l_extendedprice', count(*)::INTEGER,
                    coalesce(string_agg(t::VARCHAR, ';' ORDER BY t), ''), NULL FROM edges
                UNION ALL SELECT 'breaks_near_boundaries', 'l_quantity+l_extendedprice', count(*)::INTEGER,
                    coalesce(string_agg(t::VARCHAR, ';' ORDER BY t), ''), NULL FROM near)
        SELECT * FROM out"""


_EDGES = f"""c AS (SELECT {DAY} AS t, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    top AS (SELECT t, event_type FROM c QUALIFY row_number() OVER (PARTITION BY t ORDER BY n DESC, event_type) = 1),
    edges AS (SELECT t FROM top QUALIFY event_type <> lag(event_type) OVER (ORDER BY t))"""

ORACLES = {
    "prefix_sums": f"""WITH {MONTH_SCORES} SELECT series, t, round(x, 6) + 0.0 AS x,
        row_number() OVER w::INTEGER AS pos, round(sum(x) OVER w, 6) + 0.0 AS p1, round(sum(x * x) OVER w, 6) AS p2
        FROM long WINDOW w AS (PARTITION BY series ORDER BY t)""",
    "segment_cost": f"""WITH {MONTH_SCORES} SELECT series, min(t) AS t_from, max(t) AS t_to, count(*) AS points,
        round(var_pop(x) * count(*), 6) AS cost FROM long GROUP BY series, t // 12""",
    "optimal_partition": f"WITH {MONTH_SCORES}, {_ONE_DIM}, {partitions(5, 'uni')} {_FOUND.format(extra='', table='parts')}",
    "change_points": f"""WITH {MONTH_SCORES}, {_ONE_DIM}, {partitions(5, 'uni')}, {CHOSEN}
        {_FOUND.format(extra='round(bic, 6) AS bic,', table='chosen')}""",
    "change_points_joint": f"""WITH {MONTH_SERIES.replace('long AS (', 'raw AS (', 1)}, multi AS (
        SELECT 'joint' AS series, series AS dim, t, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM raw
        WHERE series IN ('l_quantity', 'l_extendedprice') WINDOW w AS (PARTITION BY series)),
        {partitions(5, 'multi')}, {CHOSEN} {_FOUND.format(extra='round(bic, 6) AS bic,', table='chosen')}""",
    "elbow_pick": f"""WITH {MONTH_SCORES}, {_ONE_DIM}, {partitions(5, 'uni')},
        e AS (SELECT series, min(m) AS x1, max(m) AS x2, arg_min(sse, m) AS y1, arg_max(sse, m) AS y2 FROM parts GROUP BY 1)
        SELECT series, m::INTEGER AS best_k, round(sse, 6) AS best_cost FROM parts JOIN e USING (series)
        QUALIFY row_number() OVER (PARTITION BY series
            ORDER BY abs((y2 - y1) * m - (x2 - x1) * sse + x2 * y1 - x1 * y2) DESC, m) = 1""",
    "pettitt": f"WITH {MONTH_SERIES}, {PETTITT} {_PET}",
    "supplier_pettitt": f"WITH {SUPPLIER_SERIES}, {PETTITT} {_PET}",
    "change_points_raw": _RAW,
    "change_points_shifted": _RAW,
    "change_report": _report(MONTH_SCORES),
    "change_report_raw": _report(MONTH_SERIES),
    "mood_report": _mood(f"""edges AS (WITH {month_means(JOINT)}, {eras('pts')}
        SELECT p AS t FROM era QUALIFY cluster <> lag(cluster) OVER (ORDER BY p))"""),
    "mood_report_given": _mood("edges AS (SELECT t FROM (SELECT DISTINCT t, t // 24 AS c FROM raw) QUALIFY c <> lag(c) OVER (ORDER BY t))"),
    "label_boundaries": f"WITH {_EDGES} SELECT 'top' AS series, t FROM edges",
    "boundary_agreement": f"""WITH {DAY_SERIES}, {_ONE_DIM}, {partitions(3, 'uni')}, {_EDGES},
        b AS (SELECT unnest(string_split(path, ';'))::INTEGER AS t FROM parts WHERE m = 3)
        SELECT DISTINCT b.t FROM b JOIN edges e ON abs(b.t - e.t) <= 1""",
}
