"""Near copies by the Jaccard similarity of their word shingles: candidates by SimHash and MinHash bands, all measured.

Texts that :mod:`periodlens.llm.simhash` groups are candidates of each other. Two bits of 64 are too strict to find most
pairs of similarity 0.8, so each different set of shingles has ``BANDS`` band values of ``PER_BAND`` MinHashes as well.
Sets that share a SimHash group or a band are measured against each other; those of similarity ``LEAST`` or more are
linked, and links are joined to groups. A pair of similarity 0.8 shares no band with probability (1 - 0.8⁴)¹⁶ = 0.0002;
no pair below ``LEAST`` is linked. A bucket of more
than ``BLOCK`` sets is measured block against block, each set being sent once for every block of its bucket; within a task
only sets with a rare shingle in common are measured. A bucket of many sets that are not alike thus costs little time.

Defined results: words are split and lowered as for fingerprints; a text of fewer than ``WORDS`` words is one shingle,
and texts without words are one group; rows may repeat and ids may be null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.llm import simhash
from periodlens.llm.common import arrow_map, narrow
from periodlens.llm.components import roots
from periodlens.llm.simhash import one_of_each, row_key
from periodlens.sources.tables import settle

WORDS, LEAST = 5, 0.8
BANDS, PER_BAND = 16, 4
SEED = 42
SHINGLE_BLOCK = 1 << 12
# Sets of a bucket in a block; a task measures two blocks of a crowded bucket against each other.
BLOCK = 4096

_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, BANDS * PER_BAND, np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * PER_BAND, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    words = min(words, len(w))
    joined = b" ".join(w)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    spans = zip(start[: len(w) - words + 1].tolist(), end[words - 1 :].tolist())
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))


def name(one: np.ndarray) -> int:
    """A set's name: the hash of its elements. Sets are equal if their names are."""
    return xxhash.xxh64_intdigest(one.tobytes(), SEED)


def bands(one: np.ndarray) -> np.ndarray:
    """The band values of a set; none for the empty one."""
    if not len(one):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(one), SHINGLE_BLOCK):
        mixed = (one[at : at + SHINGLE_BLOCK, None] ^ _XOR) * _TIMES
        # The upper half again into the lower one, so that not only the lower bits decide on the upper ones.
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * _TIMES[::-1]).min(0))
    least = least.reshape(BANDS, PER_BAND)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least)], np.uint64)


def _similar(one: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the sets laid end to end in ``values`` are similar to ``one``."""
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    both = np.add.reduceat(one[at] == values, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
    return both >= LEAST * (len(one) + sizes - both) - 1e-9


def _prefixes(sets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Groups of sets that share one of their rarest shingles, as many of each as a similar set must share one of.

    Two sets of similarity ``LEAST`` share that part of either's shingles. In any common order of shingles the first
    ones beyond the rest, and one more, therefore have one in common; the rarest first keeps the groups small.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, shingle, times = np.unique(sets, return_inverse=True, return_counts=True)
    order = np.lexsort((shingle, times[shingle], owner))
    place = np.arange(len(sets)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ahead = sizes - np.ceil(LEAST * sizes - 1e-9).astype(np.int64) + 1
    kept = order[place < ahead[owner]]
    tokens, members = shingle[kept], owner[kept]
    by = np.argsort(tokens, kind="stable")
    return [g for g in np.split(members[by], np.flatnonzero(np.diff(tokens[by])) + 1) if len(g) > 1]


def _stars(names: np.ndarray, sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups connected by similar pairs among some sets, as pairs from each group's first member to the others.

    Only sets that share a rare shingle are measured, and none against a set it is connected with already: neither many
    near copies nor many sets that merely share a bucket are measured pair by pair.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    group = np.arange(len(names))
    for members in _prefixes(sets, sizes):
        left = members
        while len(left):
            own = group[left] == group[left[0]]
            edge, left = left[own].tolist(), left[~own]
            while edge and len(left):
                one = sets[starts[(now := edge.pop())] : ends[now]]
                # Sets of too different sizes cannot be similar.
                fit = np.flatnonzero((sizes[left] >= LEAST * len(one) - 1e-9) & (LEAST * sizes[left] - 1e-9 <= len(one)))
                hit = np.zeros(len(left), bool)
                for at in range(0, len(fit), 256):
                    some = left[fit[at : at + 256]]
                    hit[fit[at : at + 256]] = _similar(one, np.concatenate([sets[starts[i] : ends[i]] for i in some]), sizes[some])
                for other in np.unique(group[left[hit]]):
                    group[group == other] = group[now]
                joined = group[left] == group[now]
                edge += left[joined].tolist()
                left = left[~joined]
    first = np.full(len(names), len(names))
    np.minimum.at(first, group, np.arange(len(names)))
    head = first[group]
    linked = np.flatnonzero(head != np.arange(len(names)))
    return names[head[linked]], names[linked]


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(bucket, one, other, node, shingles)``, those of a bucket's pair of blocks together → links."""
    key, names, parts = None, [], []

    def close() -> pa.RecordBatch | None:
        if len(names) < 2:
            return None
        sizes = np.array([len(x) // 8 for x in parts], np.int64)
        a, b = _stars(np.array(names, np.int64), np.frombuffer(b"".join(parts), np.uint64), sizes)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if len(a) else None

    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
        for now, node, one in zip(keys, batch.column(3).to_pylist(), batch.column(4)):
            if now != key:
                if (out := close()) is not None:
                    yield out
                key, names, parts = now, [], []
            names.append(node)
            parts.append(one.as_py())
    if (out := close()) is not None:
        yield out


def _in_blocks(found: DataFrame) -> DataFrame:
    """``(bucket, node)`` dealt to pairs of blocks: two sets of a bucket meet in some task, which holds two blocks at most."""
    sizes = found.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = found.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    paired = own.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return paired.select("bucket", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"), "node")


def _candidates(nodes: DataFrame, alike: DataFrame) -> DataFrame:
    """``(bucket, node)`` of sets that share a band value or, by ``alike``, a bucket. Of buckets with the same members one is kept."""
    every = nodes.select(F.explode("bands").alias("bucket"), "node").union(alike.select("bucket", "node").distinct())
    members = every.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"))
    first = members.filter("n > 1").groupBy("n", "members").agg(F.min("bucket").alias("bucket"))
    return every.join(first, "bucket", "left_semi")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, root)`` for every row; rows of one group of near copies have one root."""
    kind = dict(docs.dtypes)[id_col]
    cut = narrow(docs, id=id_col, text=text_col).select("id", row_key("id", "text").alias("key"), "text")

    def named(columns: list[list]) -> dict:
        ids, keys, texts = columns
        sets = [shingles(t) for t in texts]
        return {
            "id": ids, "key": keys, "node": np.array([name(x) for x in sets], np.uint64).view(np.int64),
            "bands": [bands(x).view(np.int64) for x in sets],
        }

    rows = settle(arrow_map(cut, f"id {kind}, key bigint, node bigint, bands array<bigint>", named), "bands")
    nodes = rows.groupBy("node").agg(F.min(F.struct("key", "bands")).alias("x")).select("node", "x.*")
    # Where SimHash groups have sets in common; the set without shingles is alone.
    fingerprinted = simhash.groups(docs, id_col, text_col).select("key", F.xxhash64(F.lit("simhash"), "root").alias("bucket")).distinct()
    alike = rows.filter(F.size("bands") > 0).select("key", "node").distinct().join(fingerprinted, "key").select("bucket", "node")
    found = settle(_candidates(nodes, alike), "candidates")

    def measured(columns: list[list]) -> dict:
        sets = [shingles(t) for t in columns[0]]
        return {"node": np.array([name(x) for x in sets], np.uint64).view(np.int64), "shingles": [x.tobytes() for x in sets]}

    # Texts are read again for the candidates alone.
    keys = nodes.select("node", "key").join(found.select("node").distinct(), "node", "left_semi").select("key")
    texts = cut.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("text")
    sets = settle(arrow_map(texts, "node bigint, shingles binary", measured), "shingles")
    keys = ["bucket", "one", "other"]
    met = _in_blocks(found).join(sets, "node").select(*keys, "node", "shingles")
    links = met.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_link_runs, "a bigint, b bigint")
    root = roots(links).withColumnRenamed("root", "to")
    return rows.join(root, "node", "left").select("id", "key", F.coalesce("to", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) with one document of each group of near copies, chosen as by ``simhash``."""
    return one_of_each(docs, groups(docs, id_col, text_col), id_col, text_col)
