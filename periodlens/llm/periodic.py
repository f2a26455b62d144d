"""Maximal periodic runs of words, found by uniting suffixes in order of falling common prefixes.

The suffixes of a batch of texts are ranked by prefix doubling, neighbours in that order with a common prefix long
enough for a run are edges, and Kruskal's walk over falling prefix lengths unites their classes. A class is an ordered
set of positions; when two classes meet at length l, positions i < j that have just become neighbours have a common
prefix of exactly l, and if j - i <= l they seed a run of period j - i that ends l words after j. No position between
i and j shares l words with i, so the period is the smallest; the run is reported from its first word only, which is
where the words before i and j differ. Every run is seeded that way by its first two periods.

Smaller classes join larger ones, so a text of n words makes O(n log n) pairs, whatever it repeats. Texts of a batch
have words of their own, hence never meet.

Defined results: a null or empty text has no runs and an empty collapsed text; repeated rows and null ids are rows like
any other; an empty table gives an empty result. Texts are read whole; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.llm.common import WORD, narrow

LEAST_LENGTH, LEAST_PERIODS = 6, 4
# Words that are ranked together; a longer text is a batch of its own.
BATCH_WORDS = 200_000


def least_prefix(length: int, periods: int) -> int:
    """The shortest common prefix of a run's first two periods, over all periods."""
    return min(max(length - p, (periods - 1) * p) for p in range(1, length + 1))


def neighbours(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(length, i, j)`` of suffixes next to each other in order whose common prefix has ``least`` words or more.

    ``codes`` holds small integers, and one that comes nowhere else ends each text.
    """
    n = len(codes)
    starts = np.cumsum(np.bincount(codes)) - np.bincount(codes)
    rank = starts[codes]
    order = np.argsort(codes, kind="stable")
    levels, k = [rank], 1
    # Groups of equal k-grams are sorted by the k-gram that follows; a group of one keeps its place.
    same = np.zeros(n + 1, bool)
    same[1:n] = rank[order[1:]] == rank[order[:-1]]
    while True:
        at = np.flatnonzero(same[:-1] | same[1:])
        if not len(at):
            break
        members = order[at]
        key = rank[members] * n + rank[members + k]
        by = np.argsort(key)
        members, key = members[by], key[by]
        order[at] = members
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[members] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        same[at] = ~first
        levels.append(rank)
        k *= 2
    # All words may be different, else the longest level that a long enough prefix must share says which pairs to measure.
    deep = min(least.bit_length() - 1, len(levels) - 1)
    at = np.flatnonzero(levels[deep][order[1:]] == levels[deep][order[:-1]])
    i, j = order[at], order[at + 1]
    length, a, b = np.zeros(len(at), np.int64), i.copy(), j.copy()
    for level in range(len(levels) - 1, -1, -1):
        step = (levels[level][a] == levels[level][b]) << level
        length += step
        a += step
        b += step
    keep = length >= least
    return length[keep], i[keep], j[keep]


def found(codes: np.ndarray, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs. Texts in ``codes`` begin and end at codes that come nowhere else."""
    length, left, right = neighbours(codes, least_prefix(least_length, least_periods))
    falling = np.argsort(-length, kind="stable")
    classes: dict[int, list[int]] = {}
    runs = []

    def meet(i: int, j: int, shared: int) -> None:
        p = j - i
        if p <= shared and p + shared >= max(least_length, least_periods * p) and codes[i - 1] != codes[j - 1]:
            runs.append((i, p + shared, p))

    for shared, a, b in zip(length[falling].tolist(), left[falling].tolist(), right[falling].tolist()):
        large, small = classes.get(a) or [a], classes.get(b) or [b]
        if len(large) < len(small):
            large, small = small, large
        last = len(small) - 1
        for t, x in enumerate(small):
            k = bisect_left(large, x)
            if k and (t == 0 or small[t - 1] < large[k - 1]):
                meet(large[k - 1], x, shared)
            if k < len(large) and (t == last or small[t + 1] > large[k]):
                meet(x, large[k], shared)
        if len(small) * 16 < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        for x in small:
            classes[x] = large
        classes[large[0]] = classes[a] = classes[b] = large
    return runs


def _batch_runs(texts: list[list], least_length: int, least_periods: int) -> list[tuple[list, str]]:
    """Runs and collapsed text of each list of words."""
    codes, base, offsets = [0], 1, []
    for words in texts:
        index = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
        offsets.append(len(codes))
        codes += map(index.__getitem__, words)
        codes.append(base + len(index))
        base += len(index) + 1
    per_text: list[list] = [[] for _ in texts]
    runs = found(np.array(codes, np.int64), least_length, least_periods)
    owner = np.searchsorted(offsets, [r[0] for r in runs], "right") - 1 if runs else []
    for t, (start, length, period) in zip(owner, runs):
        per_text[t].append((start - offsets[t], length, period))
    return [(sorted(mine, key=lambda r: (r[0], r[2])), collapsed(words, mine)) for words, mine in zip(texts, per_text)]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without what a run repeats after its first period."""
    if runs:
        steps = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            steps[start + period] += 1
            steps[start + length] -= 1
        dropped = np.cumsum(steps[:-1]).tolist()
        words = [w for w, d in zip(words, dropped) if not d]
    return b" ".join(words).decode()


def runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """``(id, runs, collapsed)`` for every row; runs are ``(start, length, period)`` in words, by start, then period.

    A run has ``least_length`` words and ``least_periods`` periods (2 or more) at least. One scan, no shuffle.
    """
    if least_periods < 2 or least_length < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = dict(docs.dtypes)[id_col]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, waiting, at = batch.column(1), [], 0
            size = 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size >= BATCH_WORDS:
                    made = _batch_runs(waiting, least_length, least_periods)
                    spans_ = [[{"start": a, "length": b, "period": p} for a, b, p in r] for r, _ in made]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(made)), pa.array(spans_, spans), pa.array([c for _, c in made], pa.string())],
                        ["id", "runs", "collapsed"],
                    )
                    waiting, at, size = [], i, 0
                if i < batch.num_rows:
                    # Fixed value: bytes.split() splits at the six separators of WORD.
                    waiting.append((texts[i].as_py() or "").encode().split())
                    size += len(waiting[-1])

    return narrow(docs, id=id_col, text=text_col).mapInArrow(
        run, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` where one text in ten repeats itself from some word on: test material that grows with the table.

    With h the CRC-32 of the decimal id and g = h div 10, texts with h mod 10 = 0 become periodic from word g mod n on,
    with period 1 + (n - a) div (3 + g mod 8). A null id leaves its text as it is, and a null text stays null.
    """
    rows = narrow(docs, id=id_col, text=text_col).withColumn("h", F.crc32(F.col("id").cast("string").cast("binary")))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int")
    rows = rows.withColumn("p", period).withColumn("rest", F.col("n") - F.col("a"))
    tail = F.slice(
        F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(F.col("rest") / F.col("p")).cast("int"))), 1, F.col("rest")
    )
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))
