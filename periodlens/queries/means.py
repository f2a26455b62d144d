"""Cleaning, period averages, category mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodlens.functions import lists
from periodlens.operators import clean, mix, series
from periodlens.queries.inputs import (
    EVENT_TYPES, FEATURES, PRIORITIES, events, lineitem, month_series, r, read, rounded,
)
from periodlens.queries.sql import DAY, MONTH, MONTH_SERIES


def clean_window(spark, sf):
    kept = clean.window(
        lineitem(spark, sf), "m", 1996 * 12, 2000 * 12 + 11, {"l_discount": (0.02, 0.08)},
        ["l_quantity", "l_extendedprice", "l_returnflag"],
    )
    return clean.positive(kept, "l_tax").select("m", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")


def period_mean(spark, sf):
    df = clean.with_unit(lineitem(spark, sf), "l_extendedprice", 1000, "price_k")
    return rounded(series.period_mean(df, "m", [*FEATURES, "price_k"]))


def feature_by_period(spark, sf):
    return rounded(series.feature_by_period(lineitem(spark, sf), "m", "l_quantity"))


def category_stats(spark, sf):
    return rounded(series.category_stats(read(spark, sf, "part"), "p_type", "p_retailprice")).orderBy(
        F.desc("avg_p_retailprice")
    )


def category_mix(spark, sf):
    return rounded(mix.category_mix(events(spark, sf), "day", "event_type"))


def category_mix_wide(spark, sf):
    return rounded(mix.category_mix_wide(events(spark, sf), "day", "event_type", EVENT_TYPES))


def dominant_category(spark, sf):
    orders = read(spark, sf, "orders").withColumn("m", series.month_index("o_orderdate"))
    return mix.dominant_category(orders, "m", "o_orderpriority")


def stacked_share(spark, sf):
    orders = read(spark, sf, "orders").withColumn("m", series.month_index("o_orderdate"))
    bands = mix.stacked_share(mix.category_mix(orders, "m", "o_orderpriority"), "m", "o_orderpriority", PRIORITIES)
    return rounded(bands.select("m", "o_orderpriority", "position", "lower", "upper"))


def zscore(spark, sf):
    return rounded(series.zscore(month_series(spark, sf)))


def min_max(spark, sf):
    return rounded(series.min_max(month_series(spark, sf)))


def first_last(spark, sf):
    return series.first_last(month_series(spark, sf))


def combine_series(spark, sf):
    return series.combine(month_series(spark, sf), ("l_quantity", "l_tax"), "quantity+tax")


def parse_list(spark, sf):
    part = read(spark, sf, "part")
    text = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("'; ]"), F.col("p_brand"))
    parsed = part.select("p_partkey", lists.parse_list(text).alias("l"))
    return parsed.select("p_partkey", F.size("l").alias("items"), F.array_join("l", "|").alias("names"))


def fold_circular(spark, sf):
    part = read(spark, sf, "part")
    return part.select("p_partkey", lists.fold_circular(F.pmod("p_size", F.lit(13)) - 1).alias("key_folded"))


def period_lists(spark, sf):
    """Periods joined to text and read back, with their number and sum as proof."""
    orders = read(spark, sf, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y")).distinct()
    joined = orders.groupBy("o_orderpriority").agg(lists.join_periods(F.array_sort(F.collect_list("y"))).alias("years"))
    back = lists.parse_periods("years")
    return joined.select(
        "o_orderpriority", "years", F.size(back).alias("n"),
        F.aggregate(back, F.lit(0), lambda a, v: a + v).alias("total"),
    )


def period_series_long(spark, sf):
    return month_series(spark, sf)


def distinct_periods(spark, sf):
    return lineitem(spark, sf).select("m").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        clean_window, period_mean, feature_by_period, period_series_long, distinct_periods, category_stats,
        category_mix, category_mix_wide, dominant_category, stacked_share, zscore, min_max, first_last,
        combine_series, parse_list, fold_circular, period_lists,
    )
}

_avgs = ", ".join(
    f"round(avg({e}), 6) AS avg_{n}, count({e}) AS num_{n}"
    for n, e in [*[(f, f) for f in FEATURES], ("price_k", "l_extendedprice / 1000")]
)
_wide = ", ".join(f"count(*) FILTER (event_type = '{v}') AS g{i}" for i, v in enumerate(EVENT_TYPES))
_wide_shares = ", ".join(f"round(g{i}::DOUBLE / num_rows, 6) AS share_g{i}" for i in range(len(EVENT_TYPES)))
_OMONTH = "(year(o_orderdate) * 12 + month(o_orderdate) - 1)::INTEGER"

ORACLES = {
    "clean_window": f"""SELECT {MONTH} AS m, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2001-01-01'
          AND l_discount BETWEEN 0.02::DOUBLE AND 0.08::DOUBLE AND l_tax > 0
          AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL""",
    "period_mean": f"SELECT {MONTH} AS m, {_avgs}, count(*) AS num_rows FROM lineitem GROUP BY 1",
    "feature_by_period": f"""SELECT {MONTH} AS m, round(avg(l_quantity), 6) AS avg_l_quantity,
        count(l_quantity) AS num_songs FROM lineitem GROUP BY 1""",
    "period_series_long": f"WITH {MONTH_SERIES} SELECT series, t, x FROM long",
    "distinct_periods": f"SELECT DISTINCT {MONTH} AS m FROM lineitem",
    "category_stats": """SELECT p_type, round(avg(p_retailprice), 6) AS avg_p_retailprice,
        round(stddev_samp(p_retailprice), 6) AS p_retailprice_std FROM part GROUP BY 1 ORDER BY 2 DESC""",
    "category_mix": f"""SELECT {DAY} AS day, event_type, count(*) AS category_count,
        (sum(count(*)) OVER (PARTITION BY {DAY}))::BIGINT AS num_rows,
        round(count(*) / sum(count(*)) OVER (PARTITION BY {DAY})::DOUBLE, 6) AS share
        FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2""",
    "category_mix_wide": f"""WITH w AS (SELECT {DAY} AS day, {_wide}, count(*) AS num_rows FROM events
        WHERE event_type IS NOT NULL GROUP BY 1) SELECT *, {_wide_shares} FROM w""",
    "dominant_category": f"""WITH c AS (SELECT {_OMONTH} AS m, o_orderpriority, count(*) AS n FROM orders
        WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2)
        SELECT m, o_orderpriority AS dominant_o_orderpriority, n AS dominant_o_orderpriority_count FROM c
        QUALIFY row_number() OVER (PARTITION BY m ORDER BY n DESC, o_orderpriority) = 1""",
    "stacked_share": f"""WITH c AS (SELECT {_OMONTH} AS m, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
        s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY m) AS share,
              left(o_orderpriority, 1)::INTEGER AS position FROM c),
        e AS (SELECT *, sum(share) OVER (PARTITION BY m ORDER BY position) AS upper FROM s)
        SELECT m, o_orderpriority, position, round(upper - share, 6) + 0.0 AS lower, round(upper, 6) AS upper FROM e""",
    "zscore": f"""WITH {MONTH_SERIES} SELECT series, t, x,
        round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS z FROM long WINDOW w AS (PARTITION BY series)""",
    "min_max": f"""WITH {MONTH_SERIES} SELECT series, t, x,
        round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS x_norm
        FROM long WINDOW w AS (PARTITION BY series)""",
    "first_last": f"""WITH {MONTH_SERIES} SELECT series, min(t) AS t_first, max(t) AS t_last,
        arg_min(x, t) AS x_first, arg_max(x, t) AS x_last FROM long GROUP BY 1""",
    "combine_series": f"""WITH {MONTH_SERIES}, shared AS (SELECT a.t FROM long a JOIN long b ON a.t = b.t
            AND a.series = 'l_quantity' AND b.series = 'l_tax')
        SELECT 'quantity+tax' AS series, series AS dim, t, x FROM long
        WHERE series IN ('l_quantity', 'l_tax') AND t IN (SELECT t FROM shared)""",
    "parse_list": r"""WITH p AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(
            '[''' || replace(p_name, ' ', ''', ''') || '''; ]' || p_brand, '[\[\]''",;]'), lambda s: trim(s)),
            lambda s: s <> '') AS l FROM part)
        SELECT p_partkey, len(l)::INTEGER AS items, array_to_string(l, '|') AS names FROM p""",
    "fold_circular": """SELECT p_partkey, CASE WHEN p_size % 13 - 1 BETWEEN 0 AND 11
        THEN least(p_size % 13 - 1, 11 - (p_size % 13 - 1))::DOUBLE END AS key_folded FROM part""",
    "period_lists": """WITH y AS (SELECT DISTINCT o_orderpriority, year(o_orderdate)::INTEGER AS y FROM orders)
        SELECT o_orderpriority, string_agg(y::VARCHAR, ';' ORDER BY y) AS years, count(*)::INTEGER AS n,
               sum(y)::INTEGER AS total FROM y GROUP BY 1""",
}
