"""Sinks and sources, each written and read back, and the restartable label job."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodlens.operators import labels, series
from periodlens.plans import label_job
from periodlens.queries.inputs import FEATURES, LABELS, NAMES, documents, events, lineitem, read, rounded
from periodlens.queries.sql import CHUNKS, COUNTS, DAY, FIRST, MONTH, MONTH_SERIES, PERIOD
from periodlens.sources import split_csv, tables


def tsv_roundtrip(spark, sf):
    path = tables.work_dir(spark, "tsv")
    tables.write_delimited(
        rounded(series.feature_by_period(events(spark, sf), "day", "value")).orderBy("day"), path, single_file=True
    )
    return tables.read_csv(spark, path, "day int, avg_value double, num_songs long", sep="\t")


def csv_roundtrip(spark, sf):
    """Texts with line breaks, commas and quotes through a comma-separated file."""
    path = tables.work_dir(spark, "csv")
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    tables.write_delimited(docs, path, sep=",")
    schema = docs.schema
    return tables.read_csv(spark, path, schema, multi_line=True)


def csv_multiline(spark, sf):
    """The same texts out of few large files, read by as many tasks as they have byte ranges: digests and lengths of the texts.

    One file holds all but very large tables; of these a file is as much as one task should write.
    """
    path = tables.work_dir(spark, "csv")
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    tables.write_delimited(docs, path, sep=",", file_chars=tables.FILE_CHARS)
    back = split_csv.read_split_csv(spark, path, docs.schema)
    return back.select("doc_id", "lang", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


def period_parquet(spark, sf):
    """One folder per period, read back with the period from the folder name."""
    path = tables.work_dir(spark, "periods")
    tables.write_periods(documents(spark, sf).select("doc_id", "lang", "n_chars", "period"), path, "period")
    return tables.read_parquet(spark, path)


def feature_tables(spark, sf):
    """One text table per feature, read back as named series."""
    path = tables.work_dir(spark, "features")
    wide = rounded(series.period_mean(lineitem(spark, sf), "m", FEATURES))
    return tables.read_features(spark, tables.write_features(wide, path, "m", FEATURES), "m")


def resume_labels(spark, sf):
    """Label half of the periods, then run again over all of them: the second run takes only the rest."""
    out = tables.work_dir(spark, "labels")
    docs, keys = documents(spark, sf), ["doc_id", "lang", "period"]
    lexicon = labels.LexiconLabeller(LABELS)
    label_job.run(docs.filter(F.col("period") < 10), out, keys, "period", "text", lexicon, NAMES)
    label_job.run(docs, out, keys, "period", "text", lexicon, NAMES)
    return label_job.roll_up(spark, out, keys, NAMES)


def resume_texts(spark, sf):
    """How many texts each of two such runs has labelled: the second leaves out those the first has seen."""
    out = tables.work_dir(spark, "labels")
    docs, keys = documents(spark, sf), ["doc_id", "lang", "period"]
    lexicon = labels.LexiconLabeller(LABELS)
    for rows in (docs.filter(F.col("period") < 10), docs):
        label_job.run(rows, out, keys, "period", "text", lexicon, NAMES, rows_per_commit=1 << 40)
    counted = label_job.labelled_texts(spark, out)
    return counted.select((F.substring("part", 1, 6).cast("int") + 1).alias("run"), "texts")


def final_parquet(spark, sf):
    """A result table in one Parquet folder, written over and read back."""
    path = tables.work_dir(spark, "final")
    means = rounded(series.feature_by_period(events(spark, sf), "day", "value"))
    for table in (means.limit(3), means):
        tables.write_parquet(table, path)
    return tables.read_parquet(spark, path, leaves=True)


QUERIES = {
    f.__name__: f
    for f in (tsv_roundtrip, csv_roundtrip, csv_multiline, period_parquet, final_parquet, feature_tables, resume_labels, resume_texts)
}

ORACLES = {
    "tsv_roundtrip": f"SELECT {DAY} AS day, round(avg(value), 6) AS avg_value, count(value) AS num_songs FROM events GROUP BY 1",
    "final_parquet": f"SELECT {DAY} AS day, round(avg(value), 6) AS avg_value, count(value) AS num_songs FROM events GROUP BY 1",
    "resume_texts": f"""WITH {CHUNKS}, n AS (SELECT count(DISTINCT chunk) FILTER (period < 10) AS a, count(DISTINCT chunk) AS b FROM chunks)
        SELECT 1 AS run, a AS texts FROM n UNION ALL SELECT 2, b - a FROM n""",
    "csv_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "csv_multiline": "SELECT doc_id, lang, md5(text) AS digest, length(text) AS chars FROM documents",
    "period_parquet": f"SELECT doc_id, lang, n_chars, {PERIOD} AS period FROM documents",
    "feature_tables": f"WITH {MONTH_SERIES} SELECT series, t, x FROM long",
    "resume_labels": f"WITH {COUNTS} SELECT doc_id, lang, period, {', '.join(NAMES)}, {FIRST} AS entity_label FROM counts",
}
