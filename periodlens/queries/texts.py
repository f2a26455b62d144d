"""Text shaping and lexicon counts over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodlens.functions import text as fx
from periodlens.functions.words import LONELY, LOVE, LUST
from periodlens.operators import series, text
from periodlens.queries.inputs import LEXICONS, documents, read, rounded
from periodlens.queries.sql import CHUNKS, PERIOD, count_words, lines


def flatten_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", fx.flatten("text").alias("flat"))


def chunk_text(spark, sf):
    return text.chunks(read(spark, sf, "documents"), ["doc_id"], "text")


def lines_of_text(spark, sf):
    return text.lines(read(spark, sf, "documents").select("doc_id", "text"), "text")


def lexicon_counts(spark, sf):
    return text.lexicon_counts(documents(spark, sf), "text", LEXICONS, ["doc_id", "lang", "period"])


def lexicon_by_category(spark, sf):
    return rounded(text.lexicon_stats(documents(spark, sf), "lang", "text", LEXICONS)).orderBy(
        F.desc("total_common_words")
    )


def lexicon_by_period(spark, sf):
    return rounded(text.lexicon_stats(documents(spark, sf), "period", "text", LEXICONS)).orderBy(F.desc("period"))


def lyric_themes(spark, sf):
    """The three song themes over all texts of each language."""
    return rounded(text.lexicon_stats(documents(spark, sf), "lang", "text", {"love": LOVE, "lust": LUST, "lonely": LONELY}))


def lexicon_minmax(spark, sf):
    stats = text.lexicon_stats(documents(spark, sf), "period", "text", {"common": LEXICONS["common"]})
    long = series.to_long(stats.withColumnRenamed("avg_common_per_song", "avg_common"), "period", ["common"])
    return rounded(series.min_max(long))


def chat_lexicon_by_role(spark, sf):
    return rounded(text.lexicon_stats(read(spark, sf, "conversations"), "role", "text", LEXICONS))


QUERIES = {
    f.__name__: f
    for f in (
        flatten_text, chunk_text, lines_of_text, lexicon_counts, lexicon_by_category, lexicon_by_period,
        lyric_themes, lexicon_minmax, chat_lexicon_by_role,
    )
}


def _stats(by: str, lexicons: dict, table: str = "documents") -> str:
    counted = ", ".join(f"{count_words('text', w)} AS {n}" for n, w in lexicons.items())
    out = ", ".join(
        f"sum({n})::BIGINT AS total_{n}_words, round(avg({n}), 6) AS avg_{n}_per_song" for n in lexicons
    )
    name = by.split(" AS ")[-1]
    return f"WITH c AS (SELECT {by}, {counted} FROM {table}) SELECT {name}, {out} FROM c GROUP BY 1"


_counted = ", ".join(f"{count_words('text', w)}::INTEGER AS {n}_count" for n, w in LEXICONS.items())
_raw_lines = lines("text").replace("replace(text, '\\n', chr(10))", "text")

ORACLES = {
    "flatten_text": f"SELECT doc_id, coalesce(array_to_string({lines('text')}, ' '), '') AS flat FROM documents",
    "chunk_text": f"WITH {CHUNKS} SELECT doc_id, chunk_no, chunk FROM chunks",
    "lines_of_text": f"SELECT doc_id, unnest({_raw_lines}) AS text FROM documents",
    "lexicon_counts": f"SELECT doc_id, lang, {PERIOD} AS period, {_counted} FROM documents",
    "lexicon_by_category": _stats("lang", LEXICONS),
    "lexicon_by_period": _stats(f"{PERIOD} AS period", LEXICONS),
    "lyric_themes": _stats("lang", {"love": LOVE, "lust": LUST, "lonely": LONELY}),
    "lexicon_minmax": f"""WITH c AS (SELECT {PERIOD} AS t, avg({count_words('text', LEXICONS['common'])}) AS x
            FROM documents GROUP BY 1)
        SELECT 'common' AS series, t, round(x, 6) AS x,
               round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS x_norm FROM c""",
    "chat_lexicon_by_role": _stats("role", LEXICONS, "conversations"),
}
