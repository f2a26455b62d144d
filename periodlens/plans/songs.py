"""The analyses with the column names of a song table (``sources.tables.SONG_SCHEMA``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodlens.functions.lists import fold_circular, parse_list
from periodlens.functions.words import (
    AUDIO_FEATURES, EMOTIONS, FIRST_YEAR, LAST_YEAR, LONELY, LOVE, LUST, NEIGHBOUR_FEATURES, REQUIRED_COLUMNS,
)
from periodlens.operators import changepoint, clean, cluster, consensus, labels, neighbours, series, text
from periodlens.plans import changes, label_job, synthesis, trends
from periodlens.sources import split_csv, tables

# Series of the per-feature change report, and columns shown for a neighbour.
REPORTED = ("danceability", "duration_sec", "liveness", "loneliness", "love", "lust")
DISPLAY = [
    "id", "name", "artists", "genre", "year", "popularity", "niche_genres", "danceability", "energy", "key",
    "loudness", "mode", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo", "lyrics",
]
KEYS = ["id", "year", "genre", "niche_genres"]


# Displayed names and groups of the single series in the vote.
THEME_NAMES = {"loneliness": "loneliness", "love": "love words", "lust": "lust"}
SHOWN = {s: (THEME_NAMES[s], "Lyrics: themes") if s in THEME_NAMES else (s, "Audio features") for s in REPORTED}


def load(spark: SparkSession, path: str) -> DataFrame:
    """The song table. Its texts hold line breaks and it may be one large file, which many tasks read."""
    return split_csv.read_split_csv_by_name(spark, path, tables.SONG_SCHEMA)


def usable(songs: DataFrame) -> DataFrame:
    """Songs inside the year window with a valid valence and all required columns."""
    return clean.window(songs, "year", FIRST_YEAR, LAST_YEAR, {"valence": (0, 1)}, REQUIRED_COLUMNS)


def popular(songs: DataFrame) -> DataFrame:
    return clean.positive(songs, "popularity")


def features_by_year(songs: DataFrame) -> DataFrame:
    """Averages and counts of all ten features per year, from one scan."""
    return series.period_mean(
        clean.with_unit(songs, "duration_ms", 1000, "duration_sec"), "year", [*AUDIO_FEATURES, "duration_sec"]
    )


def feature_series(songs: DataFrame) -> DataFrame:
    return series.to_long(features_by_year(songs), "year", [*AUDIO_FEATURES, "duration_sec"])


def tempo_by_genre(songs: DataFrame) -> DataFrame:
    return series.category_stats(songs, "genre", "tempo").orderBy(F.desc("avg_tempo"))


def love_and_lust(songs: DataFrame, by: str = "genre") -> DataFrame:
    stats = text.lexicon_stats(songs, by, "lyrics", {"love": LOVE, "lust": LUST})
    return stats.orderBy(F.desc("year") if by == "year" else F.desc("total_love_words"))


def loneliness_by_year(songs: DataFrame) -> DataFrame:
    """``year, avg_val, normalized_lonely``."""
    stats = text.lexicon_stats(songs, "year", "lyrics", {"lonely": LONELY})
    long = stats.select(F.lit("lonely").alias("series"), "year", F.col("avg_lonely_per_song").alias("avg_val"))
    return series.min_max(long, "avg_val", "normalized_lonely").drop("series").orderBy(F.desc("year"))


def theme_series(songs: DataFrame) -> DataFrame:
    """Yearly means of the three lyric themes as series, from one pass over the lyrics."""
    themes = {"loneliness": LONELY, "love": LOVE, "lust": LUST}
    stats = text.lexicon_stats(songs, "year", "lyrics", themes)
    means = stats.select("year", *[F.col(f"avg_{n}_per_song").alias(f"avg_{n}") for n in themes])
    return series.to_long(means, "year", list(themes))


def mood_eras(songs: DataFrame, ks: Sequence[int] = cluster.KS) -> cluster.Eras:
    return cluster.by_means(songs, "year", ["valence", "energy"], ks)


def genre_eras(songs: DataFrame, ks: Sequence[int] = cluster.KS) -> cluster.Eras:
    return cluster.by_mix(songs, "year", "genre", ks)


def label_emotions(songs: DataFrame, out: str, labeller: labels.Labeller, **options) -> list:
    """Label the lyrics chunk by chunk into ``out``; a repeated call takes only the years that are missing."""
    return label_job.run(songs, out, KEYS, "year", "lyrics", labeller, EMOTIONS, **options)


def song_emotions(spark: SparkSession, out: str, ties: str = "first") -> DataFrame:
    return label_job.roll_up(spark, out, KEYS, EMOTIONS, ties).withColumnRenamed("entity_label", "song_emotion")


def emotion_shares(emotions: DataFrame) -> DataFrame:
    """Yearly shares of each emotion by song and by chunk."""
    return labels.share_report(emotions, "year", EMOTIONS)


def emotion_series(emotions: DataFrame) -> DataFrame:
    return series.to_long(labels.shares(emotions, "year", EMOTIONS), "year", EMOTIONS, prefix="")


def emotion_trends(emotions: DataFrame) -> DataFrame:
    return trends.share_table(emotion_series(emotions))


def feature_trends(songs: DataFrame) -> DataFrame:
    return trends.table(feature_series(songs))


def feature_changes(songs: DataFrame) -> DataFrame:
    """Change report of the reported features and lyric themes."""
    both = feature_series(songs).unionByName(theme_series(songs))
    return changes.report(both.filter(F.col("series").isin(list(REPORTED))), changepoint.REPORT_CAP)


def mood_changes(songs: DataFrame, eras: cluster.Eras) -> DataFrame:
    return changes.mood(feature_series(songs), ("valence", "energy"), eras.clusters, "year")


def consensus_years(songs: DataFrame, emotions: DataFrame, mood: cluster.Eras, genre: cluster.Eras) -> DataFrame:
    """All analyses as votes over the year window."""
    wanted = [*REPORTED, "valence", "energy"]
    long = feature_series(songs).unionByName(theme_series(songs)).filter(F.col("series").isin(wanted))
    found = synthesis.collect(
        long, ("valence", "energy"),
        {"mood clusters": (mood.clusters, "mood"), "genre clusters": (genre.clusters, "genre")}, "year",
        emotion_series(emotions), names=SHOWN,
    )
    spine = songs.sparkSession.range(FIRST_YEAR, LAST_YEAR + 1).select(F.col("id").cast("int").alias("t"))
    return consensus.vote(found, spine, names=True)


def neighbour_index(songs: DataFrame) -> neighbours.Index:
    """Index over eleven features; songs of the same artist exclude each other."""
    prepared = songs.withColumns(
        {"key_folded": fold_circular("key"), "mode": F.col("mode").cast("double"), "artist_list": parse_list("artists")}
    )
    return neighbours.build(prepared, "id", NEIGHBOUR_FEATURES, exclude="artist_list")


def recommend(index: neighbours.Index, songs: DataFrame, seed_ids: Sequence[str], k: int = 10) -> DataFrame:
    """The k nearest songs of other artists for every seed, with their display columns and ``dist``."""
    seeds = songs.sparkSession.createDataFrame([(s,) for s in seed_ids], "id string")
    return neighbours.with_display(neighbours.recommend(index, seeds, k), songs, "id", DISPLAY)
