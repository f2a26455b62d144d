"""Clustering of periods."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from periodlens.operators import cluster, series
from periodlens.queries.inputs import FEATURES, documents, events, lineitem, read, rounded
from periodlens.queries.sql import DAY, MONTH, eras as eras_sql, mix_points, month_means
from periodlens.sources.tables import settle

MOOD = ["l_quantity", "l_discount"]


def standardise(spark, sf):
    means = series.period_mean(lineitem(spark, sf), "m", MOOD)
    _, scaled = cluster.scale(means, [f"avg_{f}" for f in MOOD])
    z = vector_to_array("features")
    return rounded(scaled.select("m", z[0].alias("z_quantity"), z[1].alias("z_discount")))


def kscan(spark, sf):
    """Cost of every K for the daily mix of event types."""
    return rounded(cluster.by_mix(events(spark, sf), "day", "event_type").elbow)


def cluster_period_means(spark, sf):
    return rounded(cluster.by_means(lineitem(spark, sf), "m", MOOD).clusters)


def cluster_period_mix(spark, sf):
    return cluster.by_mix(events(spark, sf), "day", "event_type").clusters


def cluster_many_categories(spark, sf):
    """Months by their mix of thousands of categories, the pairs of part and status; six steps."""
    items = lineitem(spark, sf).withColumn("pair", F.concat_ws(":", "l_partkey", "l_linestatus"))
    return cluster.by_mix(items, "m", "pair", range(2, 5), rounds=6).clusters


def _held(eras, model, coords):
    """Per clustered point, from the model's centres: is it with the nearest one, and at which squared distance?"""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    rows = model.transform(eras.points).select("*", vector_to_array("features").alias("_x"))
    far = F.transform(
        centres, lambda c: F.aggregate(F.zip_with("_x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    )
    rows = rows.withColumn("_far", far)
    own = F.element_at("_far", F.col("prediction") + 1)
    return rows.select(*coords, "prediction", own.alias("_d"), (own <= F.array_min("_far") + 1e-9).alias("nearest"))


def kscan_checks(spark, sf):
    """For every K: points, whether each is with its nearest centre, and whether the cost is their squared distances."""
    eras = cluster.by_mix(events(spark, sf), "day", "event_type")
    out = None
    for k, model in sorted(eras.models.items()):
        cost = float(model.cost)
        one = _held(eras, model, []).agg(
            F.lit(k).alias("k"), F.count("*").alias("points"), F.every("nearest").alias("nearest"),
            (F.abs(F.sum("_d") - cost) <= 1e-6 * max(1.0, cost)).alias("cost_is_their_sum"),
        )
        out = one if out is None else out.unionByName(one)
    out = settle(out, "checks")
    eras.release()
    return out


def _numbered(clusters, period):
    """Whether clusters are numbered in the order of their first periods: a new one is the next number."""
    w = W.orderBy(period)
    before = F.max("cluster").over(w.rowsBetween(W.unboundedPreceding, -1))
    return clusters.withColumn("numbered", F.col("cluster") <= F.coalesce(before, F.lit(-1)) + 1)


def cluster_means_checks(spark, sf):
    """Eras by means: the months' means, and whether each month is with its nearest centre and numbered in order."""
    eras = cluster.by_means(lineitem(spark, sf), "m", MOOD)
    held = _held(eras, eras.model, ["m"]).select("m", "nearest")
    out = settle(_numbered(eras.clusters, "m").drop("cluster").join(held, "m"), "checks")
    eras.release()
    return rounded(out)


def cluster_mix_checks(spark, sf):
    """Eras by mix: the days' top types, and whether each day is with its nearest centre and numbered in order."""
    eras = cluster.by_mix(events(spark, sf), "day", "event_type")
    held = _held(eras, eras.model, ["day"]).select("day", "nearest")
    out = settle(_numbered(eras.clusters, "day").drop("cluster").join(held, "day"), "checks")
    eras.release()
    return out


def cluster_centroid(spark, sf):
    """Centre of every given group of vectors."""
    return rounded(cluster.vector_centroids(read(spark, sf, "embeddings"), "embedding", "label"))


def period_centroid(spark, sf):
    """Monthly points grouped by calendar month: mean of the members' coordinates."""
    means = series.period_mean(lineitem(spark, sf), "m", MOOD)
    grouped = means.withColumn("cluster", (F.col("m") % 12).cast("int"))
    return rounded(cluster.centroids(grouped, [f"avg_{f}" for f in MOOD]))


def cluster_categories(spark, sf):
    out = cluster.categories_per_cluster(documents(spark, sf), "source", "lang")
    return out.select("lang", F.array_join("categories", "|").alias("categories"))


QUERIES = {
    f.__name__: f
    for f in (
        standardise, kscan, kscan_checks, cluster_period_means, cluster_means_checks, cluster_period_mix,
        cluster_mix_checks, cluster_many_categories, cluster_centroid, period_centroid,
        cluster_categories,
    )
}

_MEANS = f"w AS (SELECT {MONTH} AS m, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1)"

ORACLES = {
    "standardise": f"""WITH {_MEANS} SELECT m, round((q - avg(q) OVER ()) / stddev_samp(q) OVER (), 6) + 0.0 AS z_quantity,
        round((d - avg(d) OVER ()) / stddev_samp(d) OVER (), 6) + 0.0 AS z_discount FROM w""",
    "kscan": f"WITH {mix_points(DAY, 'event_type', 'events')}, {eras_sql('pts')} SELECT k, round(wssse, 6) AS wssse FROM curve",
    "cluster_period_means": f"""WITH {month_means(MOOD)}, {eras_sql('pts')}
        SELECT p AS m, round(avg(l_quantity), 6) AS avg_l_quantity, round(avg(l_discount), 6) AS avg_l_discount,
            count(l_quantity) AS num_songs, cluster FROM lineitem JOIN era ON {MONTH} = p GROUP BY p, cluster""",
    "cluster_period_mix": f"""WITH {mix_points(DAY, 'event_type', 'events')}, {eras_sql('pts')}
        SELECT p AS day, (sum(n) OVER (PARTITION BY p))::BIGINT AS num_songs, g AS dominant_event_type,
            n AS dominant_event_type_count, cluster FROM counted JOIN era USING (p)
        QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, g) = 1""",
    "cluster_many_categories": f"""WITH {mix_points(MONTH, "l_partkey || ':' || l_linestatus", 'lineitem')}, {eras_sql('pts', 4, 6)}
        SELECT p AS m, (sum(n) OVER (PARTITION BY p))::BIGINT AS num_songs, g AS dominant_pair,
            n AS dominant_pair_count, cluster FROM counted JOIN era USING (p)
        QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, g) = 1""",
    "kscan_checks": f"""SELECT k::INTEGER AS k, (SELECT count(DISTINCT {DAY}) FROM events) AS points, true AS nearest,
        true AS cost_is_their_sum FROM range(2, 11) r(k)""",
    "cluster_means_checks": f"""SELECT {MONTH} AS m, round(avg(l_quantity), 6) AS avg_l_quantity,
        round(avg(l_discount), 6) AS avg_l_discount, count(l_quantity) AS num_songs, true AS numbered, true AS nearest
        FROM lineitem GROUP BY 1""",
    "cluster_mix_checks": f"""WITH c AS (SELECT {DAY} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT day, (sum(n) OVER (PARTITION BY day))::BIGINT AS num_songs, event_type AS dominant_event_type,
            n AS dominant_event_type_count, true AS numbered, true AS nearest FROM c
        QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) = 1""",
    "cluster_centroid": """SELECT label, (i - 1)::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 6) + 0.0 AS center
        FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2""",
    "period_centroid": f"""WITH {_MEANS} SELECT (m % 12)::INTEGER AS cluster, round(avg(q), 6) AS avg_l_quantity,
        round(avg(d), 6) AS avg_l_discount, count(*) AS members FROM w GROUP BY 1""",
    "cluster_categories": """SELECT lang, string_agg(source, '|' ORDER BY source) AS categories
        FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1""",
}
