"""Label chunks, each distinct text once, and roll the labels up per entity and period."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.functions import labels as fx
from periodlens.functions.text import let, lexicon_counts
from periodlens.operators import skew
from periodlens.sources.tables import settle


# Hashes and logs of the words that workers may be sent; some five million words under two labels.
MOST_BYTES = 128 << 20


class Labeller(Protocol):
    """Anything that adds ``label`` (string) and ``scores`` (map of label → confidence) to a table of texts."""

    def transform(self, df: DataFrame, text: str) -> DataFrame: ...


@dataclass(frozen=True)
class LexiconLabeller:
    """Scores a text by the share of lexicon matches that fall into each label's word list.

    A text without any match has no scores and no label.
    """

    lexicons: Mapping[str, Sequence[str]]

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        names = list(self.lexicons)

        def score(counts):
            total = sum((F.get(counts, F.lit(i)) for i in range(1, len(names))), F.get(counts, F.lit(0)))
            shares = F.transform(counts, lambda v: v / total)
            return F.when(total > 0, F.map_from_arrays(F.array(*[F.lit(n) for n in names]), shares))

        scored = df.withColumn("scores", let(lexicon_counts(text, list(self.lexicons.values())), score))
        return scored.withColumn("label", fx.argmax_confidence("scores", names))


@dataclass(frozen=True)
class PipelineLabeller:
    """A fitted ``spark.ml`` classification pipeline whose class index i stands for ``labels[i]``."""

    model: PipelineModel
    labels: Sequence[str]
    probability: str = "probability"
    input_col: str = "text"

    @classmethod
    def fit(cls, pipeline: Estimator, df: DataFrame, labels: Sequence[str], input_col: str = "text") -> "PipelineLabeller":
        return cls(pipeline.fit(df), list(labels), input_col=input_col)

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        keep = df.columns
        scored = self.model.transform(df.withColumn(self.input_col, F.col(text)))
        scores = F.map_from_arrays(
            F.array(*[F.lit(n) for n in self.labels]), vector_to_array(F.col(self.probability))
        )
        scored = scored.select(*keep, scores.alias("scores"))
        return scored.withColumn("label", fx.argmax_confidence("scores", list(self.labels)))


@dataclass(frozen=True)
class WordBayesLabeller:
    """Multinomial naive Bayes on words, as a table of each word's log probability under every label.

    The vocabulary is that of the training texts, whole; words outside it say nothing. Ties go to the first label.
    ``size`` is the number of words, counted if it is not given. A table of up to ``MOST_BYTES`` is sent to the workers,
    which score a batch of texts at once; a larger one stays where it is and the texts' words are joined to it.
    """

    words: DataFrame
    prior: Sequence[float]
    labels: Sequence[str]
    size: int | None = None

    @staticmethod
    def fit(train: DataFrame, text: str, label: str, labels: Sequence[str]) -> "WordBayesLabeller":
        """Learn from the texts with one of the ``labels``; counts are smoothed by one. The table of words is settled."""
        known = train.filter(F.col(label).isin(list(labels)))
        rows = known.select(F.col(label).alias("_label"), F.explode(words_of(text)).alias("word"))
        counted = rows.groupBy("word").agg(*[F.count_if(F.col("_label") == name).alias(f"n{i}") for i, name in enumerate(labels)])
        counted = settle(counted, "words")
        size, *sums = counted.agg(F.count("*"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(labels))]).first()
        texts = known.agg(*[F.count_if(F.col(label) == name) for name in labels]).first()
        prior = [math.log((n + 1) / (sum(texts) + len(labels))) for n in texts]
        logs = [F.log((F.col(f"n{i}") + 1.0) / float(sums[i] + max(size, 1))).alias(f"log{i}") for i in range(len(labels))]
        return WordBayesLabeller(counted.select("word", *logs), prior, tuple(labels), size)

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        size = self.words.count() if self.size is None else self.size
        table = self._table() if size * 8 * (1 + len(self.labels)) <= MOST_BYTES else None
        # Two words of one hash cannot be told apart in the table.
        scored = self._joined(df, text) if table is None else df.withColumn("_p", self._batched(df.sparkSession, *table)(hashes_of(text)))
        scores = F.map_from_arrays(F.array(*map(F.lit, self.labels)), F.col("_p"))
        return scored.select(*df.columns, scores.alias("scores")).withColumn("label", fx.argmax_confidence("scores", list(self.labels)))

    def _table(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Hashes of all words in order, and a row of logs for each; nothing if two words share a hash."""
        logs = [f"log{i}" for i in range(len(self.labels))]
        found = self.words.select(F.xxhash64("word").alias("h"), *logs).toArrow()
        hashes = found["h"].to_numpy()
        order = np.argsort(hashes)
        if hashes.size > 1 and (np.diff(hashes[order]) == 0).any():
            return None
        return hashes[order], np.stack([found[c].to_numpy() for c in logs], axis=1)[order]

    def _batched(self, spark, hashes: np.ndarray, logs: np.ndarray):
        """Arrow function: hashes of the words of each text → probability of every label.

        The words of a batch lie in one array; they are looked up together and summed between the texts' borders.
        """
        model = spark.sparkContext.broadcast((hashes, logs, np.array(self.prior)))

        @F.arrow_udf("array<double>")
        def score(texts: pa.Array) -> pa.Array:
            known, logs, prior = model.value
            words = texts.flatten().to_numpy(zero_copy_only=False)
            ends = np.asarray(texts.offsets) - texts.offsets[0].as_py()
            at = np.minimum(np.searchsorted(known, words), max(known.size - 1, 0))
            hit = known[at] == words if known.size else np.zeros(words.size, bool)
            rows = np.flatnonzero(hit)
            # Borders of the texts among the known words; a text without any has an empty stretch.
            ends = np.searchsorted(rows, ends)
            summed = np.tile(prior, (len(texts), 1))
            filled = np.flatnonzero(np.diff(ends))
            if filled.size:
                summed[filled] += np.add.reduceat(logs[at[rows]], ends[filled], axis=0)
            p = np.exp(summed - summed.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * prior.size, p.ravel())

        return score

    def _joined(self, df: DataFrame, text: str) -> DataFrame:
        """Words are counted per text before they meet the table; texts are told apart by their digests."""
        digest = F.sha2(F.col(text), 256)
        every = df.select(digest.alias("_text"), F.explode(words_of(text)).alias("word")).groupBy("_text", "word").agg(F.count("*").alias("_n"))
        n = range(len(self.labels))
        # Equal texts have been counted together; the number of them divides out.
        copies = df.groupBy(digest.alias("_text")).agg(F.count("*").alias("_copies"))
        sums = every.join(self.words, "word").groupBy("_text").agg(*[F.sum(F.col("_n") * F.col(f"log{i}")).alias(f"_s{i}") for i in n])
        sums = copies.join(sums, "_text", "left").select(
            "_text", *[(F.coalesce(F.col(f"_s{i}") / F.col("_copies"), F.lit(0.0)) + self.prior[i]).alias(f"_s{i}") for i in n]
        )
        top = F.greatest(*[F.col(f"_s{i}") for i in n]) if len(self.labels) > 1 else F.col("_s0")
        parts = [F.exp(F.col(f"_s{i}") - top) for i in n]
        total = sum(parts[1:], parts[0])
        scored = df.withColumn("_key", digest).join(sums, F.col("_key").eqNullSafe(F.col("_text")), "left")
        return scored.select(*df.columns, F.array(*[p / total for p in parts]).alias("_p"))


def words_of(text: str):
    """Lower-case words of a text: runs of letters, marks, digits and connectors."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"), lambda w: w != "")


def hashes_of(text: str):
    """The words of a text as 64-bit hashes."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def distinct_texts(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    """Each text once, with the number of rows holding it."""
    return chunks.groupBy(text).agg(F.count("*").alias("copies"))


def run_labeller(
    texts: DataFrame, labeller: Labeller, labels: Sequence[str], text: str = "chunk", partitions: int | None = None
) -> DataFrame:
    """``label``, ``conf_<label>`` per label and ``dominant_label`` for every row.

    ``partitions`` spreads a slow labeller over that many tasks, since small texts would otherwise be merged
    into few of them.
    """
    spread = texts.repartition(partitions, F.xxhash64(text)) if partitions else texts
    scored = labeller.transform(spread, text)
    return scored.select(
        *texts.columns,
        "label",
        *[fx.confidence("scores", name).alias(f"conf_{name}") for name in labels],
        fx.argmax_confidence("scores", labels).alias("dominant_label"),
    )


def label_distinct(
    chunks: DataFrame, labeller: Labeller, labels: Sequence[str], text: str = "chunk", partitions: int | None = None
) -> DataFrame:
    """Distinct texts with their labels; the labeller sees each text once."""
    return run_labeller(distinct_texts(chunks, text), labeller, labels, text, partitions)


def label_chunks(
    chunks: DataFrame,
    labeller: Labeller,
    labels: Sequence[str],
    spread: Sequence[str],
    text: str = "chunk",
    partitions: int | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Every chunk row with the label of its text; repeats keep their multiplicity.

    ``spread`` names columns that tell the copies of one text apart (entity id and chunk position). The texts
    are dropped before the rows are shuffled, and the SHA-256 digest stands in for them; ``keep_text`` takes
    them along and joins on the texts themselves.
    """
    distinct = distinct_texts(chunks, text)
    labelled = run_labeller(distinct, labeller, labels, text, partitions)
    if keep_text:
        return skew.join_unique(chunks, labelled, [text], skew.hot_keys(distinct, [text], "copies"), spread, "copies")
    hot = skew.hot_keys(by_digest(distinct, text), ["_digest"], "copies")
    return skew.join_unique(by_digest(chunks, text), by_digest(labelled, text), ["_digest"], hot, spread, "copies").drop("_digest")


def by_digest(df: DataFrame, text: str = "chunk", keep_text: bool = False) -> DataFrame:
    """The rows with the SHA-256 digest of their text in its place, or beside it. A NULL text has a NULL digest."""
    out = df.withColumn("_digest", F.unhex(F.sha2(text, 256)))
    return out if keep_text else out.drop(text)


def attach_labels(chunks: DataFrame, store: DataFrame, spread: Sequence[str], text: str = "chunk") -> DataFrame:
    """Every chunk row with the label its text has in a store of labels by digest."""
    rows = by_digest(chunks, text)
    counted = rows.groupBy("_digest").agg(F.count("*").alias("copies"))
    hot = skew.hot_keys(counted, ["_digest"], "copies")
    return skew.join_unique(rows, store.withColumn("copies", F.lit(1)), ["_digest"], hot, spread, "copies").drop("_digest")


def count_labels(
    df: DataFrame, keys: Sequence[str], labels: Sequence[str], label: str = "dominant_label", confidences: bool = False
) -> DataFrame:
    """One count column per label and entity in a single aggregate; rows without a label count nowhere.

    ``confidences`` adds ``sum_conf_<label>`` for the confidence tie rule.
    """
    counts = [F.count_if(F.col(label) == name).alias(name) for name in labels]
    # Rounded, so that equal confidences stay equal whatever the order of adding them.
    sums = [F.round(F.sum(f"conf_{name}"), 9).alias(f"sum_conf_{name}") for name in labels] if confidences else []
    return df.groupBy(*keys).agg(*counts, *sums)


def dominant(df: DataFrame, labels: Sequence[str], ties: str = "first", out: str = "entity_label") -> DataFrame:
    """Label with the greatest count per row; tie rules as in :func:`periodlens.functions.labels.argmax_counts`."""
    confidences = [f"sum_conf_{name}" for name in labels] if ties == "confidence" else None
    return df.withColumn(out, fx.argmax_counts(labels, ties, confidences))


def label_distribution(df: DataFrame, label: str = "entity_label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("count")).orderBy(F.desc("count"), label)


def tie_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Replace each count by the entity's tie-aware weight."""
    others = [c for c in df.columns if c not in labels]
    return df.select(*others, *[fx.tie_weight(name, labels).alias(name) for name in labels])


def shares(
    counts: DataFrame, period: str, labels: Sequence[str], level: str = "entity", prefix: str = ""
) -> DataFrame:
    """Share of each label per period, one row per period.

    ``level="entity"`` gives every entity one vote, split among tied labels; ``"chunk"`` counts chunks.
    """
    if level not in ("entity", "chunk"):
        raise ValueError("level is 'entity' or 'chunk'")
    votes = tie_weights(counts, labels) if level == "entity" else counts
    summed = votes.groupBy(period).agg(*[F.sum(name).cast("double").alias(name) for name in labels])
    total = sum((F.col(name) for name in labels[1:]), F.col(labels[0]))
    return summed.select(period, *[F.try_divide(F.col(n), total).alias(f"{prefix}{n}") for n in labels])


def share_report(counts: DataFrame, period: str, labels: Sequence[str]) -> DataFrame:
    """Entity-level and chunk-level shares side by side.

    Both come from one aggregate over the period, so no join is needed to bring them together.
    """
    weights = [F.sum(fx.tie_weight(n, labels)).alias(f"song_{n}") for n in labels]
    chunks = [F.sum(n).cast("double").alias(f"chunk_{n}") for n in labels]
    summed = counts.groupBy(period).agg(*weights, *chunks)
    out = [F.col(period)]
    for level in ("song", "chunk"):
        total = sum((F.col(f"{level}_{n}") for n in labels[1:]), F.col(f"{level}_{labels[0]}"))
        out += [F.try_divide(F.col(f"{level}_{n}"), total).alias(f"{level}_{n}") for n in labels]
    return summed.select(*out)


def overall_share(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Tie-aware weight and percent per label over all entities."""
    summed = counts.agg(*[F.sum(fx.tie_weight(n, labels)).alias(n) for n in labels])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("weight")) for n in labels]))
    total = sum((F.col(n) for n in labels[1:]), F.col(labels[0]))
    return summed.select(rows.alias("r"), total.alias("_total")).select(
        "r.label", "r.weight", F.try_divide(F.col("r.weight") * 100.0, F.col("_total")).alias("pct")
    )


def tie_audit(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: entities, entities with a tie and their percent, and entities without any label."""
    k = fx.tie_size(labels)
    return counts.select(k.alias("k")).agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("k") > 1).alias("tied"),
        F.count_if(F.col("k") == 0).alias("unlabelled"),
    ).withColumn("tied_pct", F.try_divide(F.col("tied") * 100.0, F.col("entities").cast("double")))


def tie_multiplicity(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Number of entities per size of tie, for ties of two and more."""
    return counts.select(fx.tie_size(labels).alias("tied_labels")).filter("tied_labels > 1").groupBy(
        "tied_labels"
    ).agg(F.count("*").alias("entities"))
