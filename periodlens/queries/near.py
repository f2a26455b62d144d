"""Nearest neighbours over the vector table; a neighbour may not share the seed's group."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from periodlens.operators import neighbour_store, neighbours
from periodlens.queries.inputs import read, rounded
from periodlens.sources.tables import settle, work_dir

K = 10


def _seeds(vectors):
    """One seed per group: its first vector."""
    return vectors.groupBy("label").agg(F.min("vec_id").alias("id")).select("id")


def nearest_exact(spark, sf):
    vectors = read(spark, sf, "embeddings")
    catalog = neighbours.plain(vectors, "vec_id", "embedding", exclude="label")
    seeds = catalog.join(_seeds(vectors), "id", "left_semi")
    return rounded(neighbours.exact(catalog, seeds, K))


def nearest_lsh(spark, sf):
    """Hashed search where all rows share one bucket in each of two tables, which makes it exact."""
    vectors = read(spark, sf, "embeddings")
    index = neighbours.build(vectors, "vec_id", "embedding", exclude="label", standardise=False)
    one = F.array(F.lit(3), F.lit(8)).cast("array<bigint>")
    index = replace(index, catalog=index.catalog.withColumn("hashes", one))
    found = neighbours.recommend(index, _seeds(vectors), K)
    return rounded(neighbours.with_display(found, vectors, "vec_id", ["label"]))


def nearest_lsh_checks(spark, sf):
    """Hashed search with the usual buckets: neighbours per seed, whether any is of the seed's group, and recall."""
    vectors = read(spark, sf, "embeddings")
    index = neighbours.build(vectors, "vec_id", "embedding", exclude="label")
    seeds = _seeds(vectors)
    found = settle(neighbours.recommend(index, seeds, K), "found")
    best = neighbours.exact(index.catalog, index.catalog.join(seeds, "id", "left_semi"), K)
    hits = best.select("seed", "id").join(found.select("seed", "id"), ["seed", "id"], "left_semi").groupBy("seed").count()
    groups = vectors.select(F.col("vec_id").alias("id"), "label")
    named = found.join(groups, "id").join(groups.select(F.col("id").alias("seed"), F.col("label").alias("own")), "seed")
    checked = named.groupBy("seed").agg(F.count("*").alias("found"), F.count_if(F.col("label") == F.col("own")).alias("barred"))
    return checked.join(hits, "seed").agg(
        F.count("*").alias("seeds"), F.min("found").alias("fewest"), F.sum("barred").alias("barred"),
        (F.sum("count") >= 0.8 * K * F.count("*")).alias("recall_is_good"),
    )


def nearest_names(spark, sf):
    """Neighbours that share no name with the seed, where each row lists several names."""
    vectors = read(spark, sf, "embeddings").withColumn(
        "names", F.array(F.concat(F.lit("l"), "label"), F.concat(F.lit("m"), F.col("vec_id") % 7))
    )
    catalog = neighbours.plain(vectors, "vec_id", "embedding", exclude="names")
    return rounded(neighbours.exact(catalog, catalog.join(_seeds(vectors), "id", "left_semi"), K))


def nearest_all(spark, sf):
    """Every vector as a seed."""
    catalog = neighbours.plain(read(spark, sf, "embeddings"), "vec_id", "embedding", exclude="label")
    return rounded(neighbours.exact(catalog, catalog, K))


TRAITS = ["price", "day", "priority"]


def _stored(spark, sf):
    """A stored index of all orders: every other one first, the rest appended. And the orders that are looked up."""
    orders = read(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )
    path = work_dir(spark, "index")
    built = neighbour_store.create(
        orders.filter("o_orderkey % 2 = 0"), path, "o_orderkey", TRAITS, exclude="o_orderstatus", bucket_length=0.2
    )
    neighbour_store.append(built, orders.filter("o_orderkey % 2 <> 0"))
    return neighbour_store.open_store(spark, path), orders.filter("o_orderkey % 250 = 3")


def nearest_stored(spark, sf):
    """Orders most like some others, but of another status, out of a stored index with real cells."""
    store, seeds = _stored(spark, sf)
    return rounded(neighbour_store.recommend(store, seeds, K).drop("compared"))


def nearest_stored_checks(spark, sf):
    """Recall of the stored index against exact search, and whether it compared few pairs.

    Few are less than 5 % of all, and for tables of any size 20 rows for each neighbour asked for.
    """
    store, seeds = _stored(spark, sf)
    found = settle(neighbour_store.recommend(store, seeds, K), "found")
    catalog = store.rows.filter("tab = 0").select("id", "vec", "grp")
    best = neighbours.exact(catalog, catalog.join(seeds.select(F.col("o_orderkey").alias("id")), "id", "left_semi"), K)
    hits = best.join(found.select("seed", "id"), ["seed", "id"], "left_semi").count()
    cost = found.groupBy("seed").agg(F.max("compared").alias("compared"))
    return cost.agg(
        F.count("*").alias("seeds"), (F.lit(hits) >= 0.9 * K * F.count("*")).alias("recall_is_good"),
        (F.sum("compared") < F.count("*") * (0.05 * F.lit(catalog.count()) + 20 * K)).alias("few_are_compared"),
    )


QUERIES = {
    f.__name__: f
    for f in (nearest_exact, nearest_lsh, nearest_lsh_checks, nearest_names, nearest_all, nearest_stored, nearest_stored_checks)
}

_TOP = """d AS (SELECT s.seed, b.vec_id AS id, list_distance(a.e, b.e) AS dist, b.label
              FROM s JOIN v a ON a.vec_id = s.seed JOIN v b ON b.label <> s.label {more}),
        o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY dist, id)::INTEGER AS rank FROM d)"""
_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_S = "s AS (SELECT min(vec_id) AS seed, label FROM embeddings GROUP BY 2)"
_OUT = "SELECT seed, id, round(dist, 6) AS dist, rank FROM o WHERE rank <= 10"

ORACLES = {
    "nearest_exact": f"WITH {_V}, {_S}, {_TOP.format(more='')} {_OUT}",
    "nearest_lsh": f"WITH {_V}, {_S}, {_TOP.format(more='')} SELECT seed, id, round(dist, 6) AS dist, rank, label FROM o WHERE rank <= 10",
    "nearest_lsh_checks": """SELECT count(DISTINCT label) AS seeds, 10::BIGINT AS fewest, 0::BIGINT AS barred, true AS recall_is_good
        FROM embeddings""",
    "nearest_names": f"WITH {_V}, {_S}, {_TOP.format(more='AND b.vec_id % 7 <> s.seed % 7')} {_OUT}",
    "nearest_stored": """WITH l AS (SELECT o_orderkey AS id, o_orderstatus AS g, [o_totalprice,
            date_diff('day', DATE '1970-01-01', o_orderdate::DATE), o_orderpriority[1]::INTEGER]::DOUBLE[] AS v FROM orders),
        m AS (SELECT i, avg(x) AS mean, stddev_samp(x) AS sd
            FROM (SELECT unnest(v) AS x, unnest(range(3)) AS i FROM l WHERE id % 2 = 0) GROUP BY 1),
        z AS (SELECT id, g, list((x - mean) / sd ORDER BY i) AS v
            FROM (SELECT id, g, unnest(v) AS x, unnest(range(3)) AS i FROM l) JOIN m USING (i) GROUP BY 1, 2),
        d AS (SELECT s.id AS seed, b.id, list_distance(s.v, b.v) AS dist FROM z s JOIN z b ON s.id % 250 = 3 AND b.g <> s.g)
        SELECT seed, id, round(dist, 6) AS dist, (row_number() OVER (PARTITION BY seed ORDER BY dist, id))::INTEGER AS rank
        FROM d QUALIFY rank <= 10""",
    "nearest_stored_checks": """SELECT count(*) AS seeds, true AS recall_is_good, true AS few_are_compared
        FROM orders WHERE o_orderkey % 250 = 3""",
    "nearest_all": f"WITH {_V}, s AS (SELECT vec_id AS seed, label FROM v), {_TOP.format(more='')} {_OUT}",
}
