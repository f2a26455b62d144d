"""Label every chunk of a text table, restartable by period, and roll the labels up per entity."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodlens.operators import labels as ops
from periodlens.operators import text as text_ops
from periodlens.sources import progress, tables


# Rows of the text table that one commit takes, unless a single period has more.
ROWS_PER_COMMIT = 1_000_000


def _commits(todo: list[tuple], rows: int) -> list[list]:
    """Pending periods in order, joined into commits of at most ``rows`` rows; a larger period is a commit of its own."""
    out, held = [], 0
    for value, count in todo:
        if not out or held + count > rows:
            out.append([])
            held = 0
        out[-1].append(value)
        held += count
    return out


def run(
    df: DataFrame,
    out: str,
    keys: Sequence[str],
    period: str,
    text: str,
    labeller: ops.Labeller,
    labels: Sequence[str],
    lines: int = 8,
    rows_per_commit: int = ROWS_PER_COMMIT,
    partitions: int | None = None,
) -> list:
    """Label the pending periods into ``out/chunks`` and return them. Eager. A NULL period is one as well.

    A commit writes its periods' folders and then records them in ``out/done``. What a failed run left of an
    unrecorded period is replaced by the next one. Labels are kept by text digest in ``out/labels``, so a text is
    labelled once over all commits and runs. ``keys`` starts with the entity id.
    """
    spark = df.sparkSession
    manifest, type_ = f"{out}/done", df.schema[period].dataType.simpleString()
    columns = list(dict.fromkeys([*keys, period]))
    batches = _commits(progress.pending(df, manifest, period), rows_per_commit)
    for batch in batches:
        # One row per calendar period, so this side is small whatever the size of the table.
        wanted = spark.createDataFrame([(p,) for p in batch], f"_wanted {type_}")
        rows = df.join(F.broadcast(wanted), F.col(period).eqNullSafe(F.col("_wanted")), "left_semi")
        chunks = text_ops.chunks(rows, columns, text, lines)
        store, part = _label_new(chunks, out, labeller, labels, partitions)
        labelled = ops.attach_labels(chunks, store, [keys[0], "chunk_no"])
        tables.write_periods(labelled, f"{out}/chunks", period)
        progress.record(spark, f"{out}/parts", "part", "string", [part])
        progress.record(spark, manifest, period, type_, batch)
    return [p for batch in batches for p in batch]


def _label_new(chunks, out, labeller, labels, partitions) -> tuple[DataFrame, str]:
    """Label the texts that no finished commit has labelled, write them, and return the whole store and the new part.

    Finished commits have recorded their parts, one name each. A part that was not recorded is never read.
    """
    spark = chunks.sparkSession
    parts = [r[0] for r in progress.finished(spark, f"{out}/parts", "part", "string").collect()]
    distinct = ops.by_digest(ops.distinct_texts(chunks), keep_text=True)
    if parts:
        kept = spark.read.parquet(*[f"{out}/labels/{p}" for p in parts])
        had = kept.select(F.col("_digest").alias("_had"))
        distinct = distinct.join(had, F.col("_digest").eqNullSafe(F.col("_had")), "left_anti")
    fresh = ops.run_labeller(distinct.drop("copies"), labeller, labels, "chunk", partitions).drop("chunk")
    part = f"{len(parts):06d}-{uuid.uuid4().hex}"
    fresh.write.parquet(f"{out}/labels/{part}")
    return spark.read.parquet(*[f"{out}/labels/{p}" for p in [*parts, part]]), part


def saved_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunk rows of all finished periods; reading one period touches only its folder."""
    return tables.read_parquet(spark, f"{out}/chunks")


def roll_up(spark: SparkSession, out: str, keys: Sequence[str], labels: Sequence[str], ties: str = "first") -> DataFrame:
    """Label counts per entity and the entity's label."""
    counts = ops.count_labels(saved_chunks(spark, out), keys, labels, confidences=ties == "confidence")
    return ops.dominant(counts, labels, ties)


def labelled_texts(spark: SparkSession, out: str) -> DataFrame:
    """Number of texts that each finished commit has labelled: ``(part, texts)``, parts in the order of commits."""
    parts = progress.finished(spark, f"{out}/parts", "part", "string")
    rows = spark.read.parquet(f"{out}/labels/*").select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("part"))
    return parts.join(rows.groupBy("part").agg(F.count("*").alias("texts")), "part", "left").na.fill(0, ["texts"])
