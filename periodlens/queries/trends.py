"""Trend tests on monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodlens.operators import changepoint, mix, trend
from periodlens.plans import trends as plans
from periodlens.queries.inputs import events, month_series, read, rounded, supplier_series
from periodlens.queries.sql import DAY, MANN_KENDALL, MONTH_SERIES, NORMAL_P, PETTITT, SEN, SUPPLIER_SERIES, fdr
from periodlens.sources.tables import settle


def mann_kendall(spark, sf):
    return rounded(trend.with_p(trend.mann_kendall(month_series(spark, sf))), 8)


def supplier_mann_kendall(spark, sf):
    """One series per supplier."""
    return rounded(trend.with_p(trend.mann_kendall(supplier_series(spark, sf))), 8)


def sens_slope(spark, sf):
    return rounded(trend.sens_slope(month_series(spark, sf)), 9)


def supplier_sens_slope(spark, sf):
    return rounded(trend.sens_slope(supplier_series(spark, sf)), 9)


def sens_slope_long(spark, sf):
    """Series of more than 1500 points with many ties: events by their number in a cycle, in whole steps and in halves."""
    cycle = events(spark, sf).groupBy((F.col("event_id") % 1700).cast("int").alias("t")).agg(F.avg("value").alias("v"))
    long = cycle.select("t", F.explode(F.array(
        F.struct(F.lit("whole").alias("series"), F.round("v", 0).alias("x")),
        F.struct(F.lit("halves").alias("series"), (F.round(F.col("v") * 2, 0) / 2 + 1e6).alias("x")),
    )).alias("p")).select("p.series", "t", "p.x")
    return rounded(trend.sens_slope(long), 9)


def bh_by_family(spark, sf):
    """Suppliers' ranked breaks adjusted within each nation; suppliers whose break falls into an even month have no p."""
    tested = changepoint.pettitt(supplier_series(spark, sf)).select(
        F.split("series", ":")[0].cast("long").alias("s_suppkey"), F.when(F.col("break_t") % 2 == 1, F.col("p")).alias("p")
    )
    nations = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    joined = settle(tested.join(nations, "s_suppkey"), "tests")
    return rounded(trend.bh(joined, "p", ["s_nationkey"]), 9)


def bh_adjust(spark, sf):
    tested = changepoint.pettitt(supplier_series(spark, sf)).select("series", "p")
    return rounded(trend.bh(settle(tested, "tests"), "p"), 9)


def trend_table(spark, sf):
    return rounded(plans.table(month_series(spark, sf), decade=120.0))


def supplier_trend_table(spark, sf):
    return rounded(plans.table(supplier_series(spark, sf), decade=120.0))


def share_trend_table(spark, sf):
    shares = mix.category_mix(events(spark, sf), "day", "event_type")
    long = shares.selectExpr("event_type AS series", "day AS t", "round(share, 6) AS x")
    return rounded(plans.share_table(long))


QUERIES = {
    f.__name__: f
    for f in (
        mann_kendall, supplier_mann_kendall, sens_slope, supplier_sens_slope, sens_slope_long, bh_adjust, bh_by_family, trend_table,
        supplier_trend_table, share_trend_table,
    )
}

_MK = """SELECT series, n, s, round(var_s, 8) AS var_s, round(z, 8) + 0.0 AS z, round(tau, 8) + 0.0 AS tau,
    round(p_raw, 8) AS p_raw FROM mkp"""
_SEN = """SELECT series, n, round(slope, 9) + 0.0 AS slope, round(ci_lo, 9) + 0.0 AS ci_lo, round(ci_hi, 9) + 0.0 AS ci_hi
    FROM sen JOIN size USING (series)"""


def _table(source: str) -> str:
    return f"""WITH {source}, {MANN_KENDALL}, {NORMAL_P}, {SEN}, {fdr('mkp', 'p_raw', 'adj')},
    ends AS (SELECT series, min(t) AS t0, max(t) AS t1, arg_min(x, t) AS x0 FROM long GROUP BY 1)
    SELECT series, n, round(tau, 6) + 0.0 AS tau, s, round(z, 6) + 0.0 AS z, round(p_raw, 6) AS p_raw,
        round(slope, 6) + 0.0 AS sen_slope, round(ci_lo, 6) + 0.0 AS ci_lo, round(ci_hi, 6) + 0.0 AS ci_hi,
        round(slope * 120, 6) + 0.0 AS change_per_decade, round(slope * (t1 - t0), 6) + 0.0 AS total_change,
        CASE WHEN x0 > 0 THEN round(slope * (t1 - t0) / x0 * 100, 6) + 0.0 END AS pct_change_vs_first,
        CASE WHEN tau > 0 THEN 'increasing' WHEN tau < 0 THEN 'decreasing' ELSE 'none' END AS direction,
        round(p_bh, 6) AS p_bh, p_bh <= 0.05 AS significant_fdr
    FROM adj JOIN sen USING (series) JOIN ends USING (series)"""


ORACLES = {
    "mann_kendall": f"WITH {MONTH_SERIES}, {MANN_KENDALL}, {NORMAL_P} {_MK}",
    "supplier_mann_kendall": f"WITH {SUPPLIER_SERIES}, {MANN_KENDALL}, {NORMAL_P} {_MK}",
    "sens_slope": f"WITH {MONTH_SERIES}, {MANN_KENDALL}, {SEN} {_SEN}",
    "supplier_sens_slope": f"WITH {SUPPLIER_SERIES}, {MANN_KENDALL}, {SEN} {_SEN}",
    "sens_slope_long": f"""WITH c AS (SELECT (event_id % 1700)::INTEGER AS t, avg(value) AS v FROM events GROUP BY 1),
        long AS (SELECT 'whole' AS series, t, round(v, 0) AS x FROM c
                 UNION ALL SELECT 'halves', t, round(v * 2, 0) / 2 + 1e6::DOUBLE FROM c), {MANN_KENDALL}, {SEN} {_SEN}""",
    "bh_by_family": f"""WITH {SUPPLIER_SERIES}, {PETTITT},
        tested AS (SELECT s_suppkey, s_nationkey, CASE WHEN break_t % 2 = 1 THEN p END AS p
                   FROM pettitt JOIN supplier ON s_suppkey = split_part(series, ':', 1)::BIGINT),
        usable AS (SELECT * FROM tested WHERE p IS NOT NULL), {fdr('usable', 'p', 'adj', 's_nationkey')}
        SELECT s_suppkey, s_nationkey, round(t.p, 9) AS p, round(p_bh, 9) AS p_bh, p_bh <= 0.05 AS significant_fdr
        FROM tested t LEFT JOIN adj USING (s_suppkey, s_nationkey)""",
    "bh_adjust": f"""WITH {SUPPLIER_SERIES}, {PETTITT}, {fdr('pettitt', 'p', 'adj')}
        SELECT series, round(p, 9) AS p, round(p_bh, 9) AS p_bh, p_bh <= 0.05 AS significant_fdr FROM adj""",
    "trend_table": _table(MONTH_SERIES),
    "supplier_trend_table": _table(SUPPLIER_SERIES),
    "share_trend_table": f"""WITH c AS (SELECT event_type, {DAY} AS t, count(*) AS n FROM events GROUP BY 1, 2),
        long AS (SELECT event_type AS series, t, round(n::DOUBLE / sum(n) OVER (PARTITION BY t), 6) AS x FROM c),
        {MANN_KENDALL}, {NORMAL_P}, {fdr('mkp', 'p_raw', 'adj')},
        ends AS (SELECT series, arg_min(x, t) AS x0, arg_max(x, t) AS x1 FROM long GROUP BY 1)
        SELECT series AS label, round(tau, 6) + 0.0 AS tau, round(z, 6) + 0.0 AS z, round(p_raw, 6) AS p_raw,
            x0 AS share_first, x1 AS share_last,
            CASE WHEN tau > 0 THEN 'increasing' WHEN tau < 0 THEN 'decreasing' ELSE 'none' END AS direction,
            round(p_bh, 6) AS p_bh, p_bh <= 0.05 AS significant_fdr FROM adj JOIN ends USING (series)""",
}
