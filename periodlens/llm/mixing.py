"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Slots of the mix are numbered; the golden-ratio point of a slot falls into the share of one source, so every stretch
of the schedule holds all sources in proportion. A slot's rank among the slots of its source names the block it
takes: the words of a source, its documents shuffled by a hash, are cut into blocks of equal length, taken in order
and begun again when they are through.

Prefix sums over a source and ranks within it are taken in two steps (sums by hash prefix or stretch of slots, then
within it), so no task holds a source, even one with most of the rows.

Defined results: a null text or one without words has size 0 and nothing of it is taken; a null source is a source of
its own, the last one; rows with equal ids are mixed each for itself; an empty table gives an empty result. Other
columns are not looked at. A rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodlens.llm.common import narrow
from periodlens.sources.tables import settle

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 4096
# A source has at least so many blocks, if it has the words, so that small sources come near their targets too.
LEAST_BLOCKS = 256
# Hexadecimal digits of the hash that part a source, and slots ranked together.
PREFIX = 3
STRETCH = 1 << 16
CELLS = 1 << 12
# 2 ** 32 divided by the golden ratio.
GOLDEN = 2654435769


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size, place)``: words of the text, and the hash whose order shuffles a source."""
    cut = narrow(docs, id=id_col, source=source_col, text=text_col)
    return cut.select(
        "id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("place"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """One row per source: ``source, source_size, target, length, low, high``.

    Targets share the sum of all sizes by weight and stop at ``repeats`` times the source's size; the excess goes to
    the others by weight, until none is above. That is one level per weight for all sources not stopped: sources are
    ordered by the level at which they stop, and each is stopped if the level of those from it on is above. ``length``
    is the words of a block, ``low`` and ``high`` bound the source's share of the schedule in thousandths of a slot.
    One row per source passes through one task.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), nth + 1)
    capped = sums.select("source", "source_size", weight.alias("w"), (F.col("source_size") * repeats).alias("cap"))
    stops = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = stops.rowsBetween(Window.unboundedPreceding, -1), stops.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    levelled = capped.select(
        "*", F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("gone"), F.sum("w").over(after).alias("left"),
    )
    stopped = levelled.withColumn("stopped", F.col("w") * (F.col("total") - F.col("gone")).cast("double") / F.col("left") > F.col("cap"))
    free = ~F.col("stopped")
    shared = stopped.select(
        "*", F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(every), F.lit(0)).alias("gone_all"),
        F.sum(F.when(free, F.col("w"))).over(every).alias("left_all"),
    )
    share = F.col("w") * (F.col("total") - F.col("gone_all")).cast("double") / F.col("left_all")
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    done = shared.select(
        "source", "source_size", F.when(free, share).otherwise(F.col("cap").cast("double")).alias("target"), length.alias("length")
    )
    units = F.round(F.col("target") / F.col("length") * 1000).cast("long")
    return done.withColumn("units", units).select(
        "*", F.sum("units").over(order).alias("high")
    ).withColumn("low", F.col("high") - F.col("units")).drop("units")


def points(spark: SparkSession, plan: DataFrame, first: int = 0, last: int | None = None) -> DataFrame | None:
    """``(slot, stretch, source, source_size, length)``: the source of every slot, or of those from ``first`` to before ``last``.

    A point is mapped to its source through cells of the unit interval: an equality join of points with the few
    sources that touch their cell, not a comparison with all sources. None if there is nothing to mix. Points repeat after
    2 ** 32 slots, by when they have been at every step of the interval once.
    """
    total = plan.agg(F.max("high")).first()[0] or 0
    if not total:
        return None
    wide = F.lit(float(total))
    cells = plan.filter("high > low").select(
        "source", "source_size", "length", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * CELLS / wide), F.floor(F.col("high") * CELLS / wide))).alias("cell"),
    )
    # The product modulo 2 ** 32 by halves of 16 bits, which fit into a long for any slot.
    upper = F.floor(F.col("id") / (1 << 16)) % (1 << 16) * GOLDEN % (1 << 32) * (1 << 16)
    turned = (upper + F.col("id") % (1 << 16) * GOLDEN) % (1 << 32)
    slots = spark.range(first, -(-total // 1000) if last is None else last).select(
        F.col("id").alias("slot"), (turned.cast("double") * wide / float(1 << 32)).alias("point")
    ).withColumn("cell", F.floor(F.col("point") * CELLS / wide))
    return slots.join(cells, "cell").filter("point >= low and point < high").select(
        "slot", F.floor(F.col("slot") / STRETCH).alias("stretch"), "source", "source_size", "length"
    )


def schedule(spark: SparkSession, plan: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``(slot, source, rank, epoch, block)`` for every slot of the mix. ``plan`` is what :func:`targets` returns.

    Slots beyond the last repeat stay empty.
    """
    placed = points(spark, plan)
    if placed is None:
        return spark.createDataFrame([], f"slot bigint, source {dict(plan.dtypes)['source']}, rank bigint, epoch bigint, block bigint")
    placed = settle(placed, "slots")
    counts = placed.groupBy("source", "stretch").count()
    earlier = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("source", "stretch").orderBy("slot")
    ranked = placed.withColumn("place", F.row_number().over(within) - 1).join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t"))
    )
    blocks = F.ceil(F.col("source_size") / F.col("length"))
    rank = F.col("offset") + F.col("place")
    return ranked.select(
        "slot", "source", rank.alias("rank"), F.floor(rank / blocks).alias("epoch"), (rank % blocks).alias("block")
    ).filter(F.col("epoch") < repeats)


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``, the words before a document in its shuffled source. Documents without words are left out."""
    parted = rows.filter("size > 0").withColumn("part", F.substring("place", 1, PREFIX))
    sums = parted.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("source", "part").orderBy("place", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    return parted.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    ).select("id", "source", "size", "place", (F.col("offset") + F.col("inner")).alias("start"))


def mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix: ``(slot, id, source, start, epoch, first, words)``, the words taken of a document by a slot.

    ``start`` tells rows with equal ids apart, ``first`` counts the words of the document before the stretch.
    """
    lengths = plan.select(F.col("source").alias("s"), "length")
    placed = positions(rows).join(lengths, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first, last = F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
    pieces = placed.withColumn("b", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("b") * F.col("length"), F.col("start"))
    end = F.least((F.col("b") + 1) * F.col("length"), F.col("start") + F.col("size"))
    pieces = pieces.select(
        "id", F.col("source").alias("s"), "start", "b", (begin - F.col("start")).alias("first"), (end - begin).alias("words")
    )
    slots = schedule(rows.sparkSession, plan)
    return slots.join(pieces, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select(
        "slot", "id", "source", "start", "epoch", "first", "words"
    )


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row: what the mix takes of each document."""
    rows, plan = prepared(docs, id_col, text_col, source_col)
    used = mix(rows, plan).groupBy("source", "start").agg(F.sum("words").alias("taken"))
    placed = positions(rows)
    counted = placed.join(
        used.select(F.col("source").alias("s"), F.col("start").alias("at"), "taken"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")), "left",
    ).select("id", "source", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    counted = counted.union(rows.filter("size = 0").select("id", "source", "size", F.lit(0).cast("long")))
    per_source = plan.select(F.col("source").alias("s"), "source_size", "target")
    return counted.join(per_source, F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "size", "source_size", "target", "taken"
    )


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Sizes and targets, written once: texts are read a single time, and the size of the plan is known."""
    rows = settle(sized(docs, id_col, text_col, source_col), "sizes")
    return rows, settle(targets(rows), "targets")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` (all columns) as mixed: a document as often as slots take its first word, whole each time.

    Documents without words are in no block and go. Rows equal in id, source and size share their count, rounded up.
    """
    rows, plan = prepared(docs, id_col, text_col, source_col)
    times = mix(rows, plan).filter("first = 0").groupBy("source", "start").agg(F.count("*").alias("times"))
    counted = positions(rows).join(
        times.select(F.col("source").alias("s"), F.col("start").alias("at"), "times"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")),
    )
    summed = counted.groupBy("id", "source", "size").agg(F.sum("times").alias("times"))
    copies = rows.groupBy("id", "source", "size").agg(F.count("*").alias("copies"))
    per_row = summed.join(
        copies.select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "copies"),
        F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")),
    ).select(
        F.col("id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"),
        F.ceil(F.col("times") / F.col("copies")).cast("int").alias("_mix_times"),
    )
    size = F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.join(
        per_row,
        F.col(f"`{id_col}`").eqNullSafe(F.col("_mix_id")) & F.col(f"`{source_col}`").eqNullSafe(F.col("_mix_source"))
        & (size == F.col("_mix_size")),
    ).withColumn("_mix_time", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*[docs[c] for c in docs.columns])


# The same in SQL, with the fixed parameters of the registered query.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
capped AS (
  SELECT *, source_size * 3 AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sums),
levelled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone,
         CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS remaining
  FROM capped),
stopped AS (SELECT *, w * CAST(total - gone AS DOUBLE) / remaining > cap AS stopped FROM levelled),
shared AS (
  SELECT *, CAST(coalesce(sum(cap) FILTER (stopped) OVER (), 0) AS BIGINT) AS gone_all,
         CAST(sum(w) FILTER (NOT stopped) OVER () AS BIGINT) AS left_all
  FROM stopped),
aimed AS (
  SELECT source, source_size, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE w * CAST(total - gone_all AS DOUBLE) / left_all END AS target,
         CAST(greatest(1, least(4096, ceil(source_size / 256))) AS BIGINT) AS length
  FROM shared),
bounded AS (
  SELECT *, CAST(round(target / length * 1000) AS BIGINT) AS units FROM aimed),
plan AS (
  SELECT *, CAST(sum(units) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS high FROM bounded),
width AS (SELECT max(high) AS total FROM plan),
slots AS (
  SELECT slot, CAST(CAST(slot AS HUGEINT) * 2654435769 % 4294967296 AS DOUBLE) * CAST(total AS DOUBLE) / 4294967296.0::DOUBLE AS point
  FROM width, generate_series(0, CAST(ceil(total / 1000) AS BIGINT) - 1) AS g(slot)),
ranked AS (
  SELECT source, source_size, length, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM slots JOIN plan ON point >= high - units AND point < high),
blocks AS (
  SELECT source, rank % CAST(ceil(source_size / length) AS BIGINT) AS block, count(*) AS times
  FROM ranked WHERE rank // CAST(ceil(source_size / length) AS BIGINT) < 3 GROUP BY ALL),
placed AS (
  SELECT s.*, p.source_size, p.target, p.length, row_number() OVER () AS row_id,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, size, doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
pieces AS (
  SELECT row_id, source, start, size, length, unnest(generate_series(start // length, (start + size - 1) // length)) AS block
  FROM placed WHERE size > 0),
used AS (
  SELECT row_id, sum(times * (least((p.block + 1) * length, start + size) - greatest(p.block * length, start))) AS taken
  FROM pieces p JOIN blocks b ON p.source IS NOT DISTINCT FROM b.source AND p.block = b.block GROUP BY row_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN used USING (row_id)
"""
