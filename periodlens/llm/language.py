"""Language identification: multinomial naive Bayes over hashed character trigrams.

Learning counts trigrams per language in every task and adds the counts up; the log-probability matrix, languages by
buckets, goes to the tasks as a broadcast and scores a batch of texts at once from their sparse trigram counts.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if nothing could be learned; rows
with a null language are not learned from but are scored; ties go to the first language by code points; repeated rows
count as often as they occur; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.llm.common import narrow
from periodlens.sources.tables import settle

BUCKETS = 1 << 14
SPACE = np.array([32], np.uint32)
FACTORS = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x9E3779B1], np.uint32)
SMOOTHING = 0.5
# Proven bound of what is broadcast: languages * buckets * 8 bytes must not be above it.
MATRIX_BYTES = 1 << 28
TEXT_BLOCK = 1 << 20
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigram_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts by bucket of the trigrams of a whole text, None if it has no letter. A long text is read in blocks.

    All that is no letter counts as a space, and trigrams of spaces alone are left out. ``buckets`` is a power of two.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return None
    total, shift = np.zeros(buckets, np.int64), np.uint32(33 - buckets.bit_length())
    for at in range(0, len(codes), TEXT_BLOCK):
        # The text has a space at either end; each block begins with the two characters before it, that space included.
        low = max(0, at - 2)
        c = np.where(is_letter[low : at + TEXT_BLOCK], codes[low : at + TEXT_BLOCK], SPACE)
        if at < 2:
            c = np.concatenate((SPACE, c))
        if at + TEXT_BLOCK >= len(codes):
            c = np.concatenate((c, SPACE))
        if len(c) < 3:
            continue
        a, b, d = c[:-2], c[1:-1], c[2:]
        kept = (a + b + d) != 3 * SPACE[0]
        hashed = (a * FACTORS[0] + b * FACTORS[1] + d * FACTORS[2]) * FACTORS[3] >> shift
        total += np.bincount(hashed[kept].astype(np.int64), minlength=buckets)
    return total


class Model:
    """Languages with their log-probability matrix, small enough to be broadcast."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.log_p = np.log(smooth) - np.log(smooth.sum(1, keepdims=True))
        self.prior = np.log(documents) - np.log(documents.sum())


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS) -> Model | None:
    """Learn from the rows with a language and a letter. One row per language and bucket comes to the driver, where
    their number has been found to be within the bound of the matrix."""
    cut = narrow(docs, lang=lang_col, text=text_col).filter("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (counts := trigram_counts(text.as_py(), buckets)) is not None:
                    # The last place counts documents.
                    sums = seen.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    sums[:-1] += counts
                    sums[-1] += 1
        for lang, sums in seen.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(sums[at])], ["lang", "at", "n"])

    sums = cut.mapInArrow(run, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    sums = settle(sums, "trigrams")
    if (found := sums.select("lang").distinct().count()) * buckets * 8 > MATRIX_BYTES:
        raise ValueError(f"{found} languages with {buckets} buckets are too many to broadcast; take fewer buckets")
    sums = sums.toArrow()
    languages = sorted(set(sums.column("lang").to_pylist()))
    if not languages:
        return None
    row = {x: i for i, x in enumerate(languages)}
    table = np.zeros((len(languages), buckets + 1), np.int64)
    table[[row[x] for x in sums.column("lang").to_pylist()], sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return Model(languages, table[:, :-1], table[:, -1])


# Non-zero buckets of the texts that are scored together.
BATCH_BUCKETS = 1 << 18


def _score(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Languages and posteriors, a sparse batch of texts at a time: one product with the matrix, summed by text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows: list[int] = []
    at: list[np.ndarray] = []
    values: list[np.ndarray] = []

    def flush() -> None:
        if rows:
            starts = np.cumsum([0, *map(len, at[:-1])])
            log = np.add.reduceat(model.log_p[:, np.concatenate(at)] * np.concatenate(values), starts, axis=1) + np.reshape(model.prior, (-1, 1))
            best = log.argmax(axis=0)
            posterior = 1 / np.exp(np.minimum(log - log.max(axis=0), 0)).sum(axis=0)
            for i, k, p in zip(rows, best.tolist(), posterior.tolist()):
                langs[i], scores[i] = model.languages[k], p
        for column in (rows, at, values):
            column.clear()

    held = 0
    for i, text in enumerate(texts):
        counts = trigram_counts(text, model.log_p.shape[1]) if model else None
        if counts is not None:
            rows.append(i)
            at.append(np.flatnonzero(counts))
            values.append(counts[at[-1]])
            if (held := held + len(at[-1])) >= BATCH_BUCKETS:
                flush()
                held = 0
    flush()
    return langs, scores


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", columns: dict[str, str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` (the posterior probability) for every row, with the named columns kept beside them."""
    columns = columns or {}
    cut = narrow(docs, **columns, _text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _score(shared.value, batch.column(batch.num_columns - 1).to_pylist())
            kept = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], [*columns, "lang_pred", "score"])

    kept = "".join(f"`{alias}` {types[name]}, " for alias, name in columns.items())
    return cut.mapInArrow(run, f"{kept}lang_pred string, score double")


def accepted(
    docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.5, lang_col: str | None = None,
    wanted: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is known with a score of ``least`` or more.

    ``wanted`` names the languages that stay, all that were learned if it is None. A null in ``lang_col`` is filled with the
    predicted language; one that is given is not changed. The decision comes from one scan of the table itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, given = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col else None
    stay = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _score(shared.value, batch.column(place).to_pylist())
            if given is not None:
                filled = pa.array([a if a is not None else b for a, b in zip(batch.column(given).to_pylist(), langs)], batch.column(given).type)
                batch = batch.set_column(given, batch.schema.field(given), filled)
            keep = [a != UNKNOWN and b >= least and (stay is None or a in stay) for a, b in zip(langs, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
