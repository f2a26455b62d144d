"""Scoring texts by a subword lattice that sums over all segmentations.

A text is its words and one end. A word is spelt by arcs: the pieces of an existing subword vocabulary, any single
byte, and, if it was seen in training, the word as one arc. The probability of a word is the sum over all paths, by a
forward recursion in log space; a text's is the product over its words and the end, so no segmentation is chosen
anywhere. The weights of the arcs are learned: whole words by their counts, each reduced by one discount, and pieces
by how often the vocabulary's own segmentation uses them in the different training words; what the discounts free is
what pieces share. All arcs together sum to one.

How it runs: each task turns blocks of documents into one row per block and word, with the documents of its
occurrences packed in bytes. The counts of a word come from those rows by a plain aggregate. They are joined by word
(a frequent word has one row per block, not per occurrence), scored once per row, packed again by block, and summed.

Defined results: a null or empty text is the end alone; with nothing learned all words are unknown and pieces are
equally likely; rows may repeat, in any order, with null or equal ids; an empty table gives an empty result. Other
columns are not looked at. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodlens.sources.tables import settle

# Words, bytes of text and documents of a block, which bound what a task holds. Documents are numbered in 16 bits.
BLOCK_WORDS = 1_500_000
BLOCK_BYTES = 1 << 23
BLOCK_DOCUMENTS = 1 << 16
# Scored rows that are packed together by block before they are shuffled.
PACKED_ROWS = 300_000
END = b""


def pieces(vocabulary: str | None = None) -> dict[bytes, int]:
    """The pieces of the vocabulary in lower case, as bytes with a space for the start of a word → numbers from 0 on.

    Every byte is a piece, so every word has a path.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    texts = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    out = {bytes([b]): b for b in range(256)}
    for text in texts:
        piece = text.replace("▁", " ").encode().lower()
        # A space can only begin a word.
        if piece.strip() and b" " not in piece[1:]:
            out.setdefault(piece, len(out))
    return out


class Spelling:
    """Log probabilities of words by pieces alone."""

    def __init__(self, number: dict[bytes, int], counts: np.ndarray):
        weights = counts + 1.0
        logs = np.log(weights / weights.sum())
        self.end = float(logs[-1])
        self.log = {piece: float(logs[i]) for piece, i in number.items()}
        self.longest = max(map(len, number))
        # A tree of bytes; the place -1 holds the log probability of the piece that ends there.
        self.tree: dict = {}
        for piece, p in self.log.items():
            node = self.tree
            for byte in piece:
                node = node.setdefault(byte, {})
            node[-1] = p

    def word(self, word: bytes) -> float:
        """The forward recursion: the log of the summed probabilities of all segmentations of a word."""
        text = b" " + word
        n, longest, exp, log = len(text), self.longest, math.exp, math.log
        # For each place, the logs of all paths that end there by their last arc.
        arriving: list[list[float]] = [[] for _ in range(n + 1)]
        arriving[0].append(0.0)
        for i, terms in enumerate(arriving):
            top = terms[0] if len(terms) == 1 else max(terms)
            here = top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms]))
            if i == n:
                return here
            node, j = self.tree, i
            for byte in text[i : i + longest]:
                node = node.get(byte)
                if node is None:
                    break
                j += 1
                p = node.get(-1)
                if p is not None:
                    arriving[j].append(here + p)


def _segment(word: bytes, number: dict[bytes, int], longest: int) -> list[int]:
    """The word as few long pieces: the longest piece that fits, again and again."""
    text, at, out = b" " + word, 0, []
    while at < len(text):
        for end in range(min(len(text), at + longest), at, -1):
            got = number.get(text[at:end])
            if got is not None:
                out.append(got)
                at = end
                break
    return out


def _postings(docs: DataFrame) -> DataFrame:
    """``(block, word, docs, training, ids, sizes)``: a row per block and word, and one per block with its documents.

    ``docs`` lists the word's occurrences, each by the 16-bit number of its document; ``training`` counts those in
    training documents. The row of documents has no word; there ``ids`` lists the document ids, ``sizes`` their numbers
    of tokens, as 32-bit integers, and ``docs`` one for those held out.
    """
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        words: list[list[bytes]] = []
        ids, held, words_held, bytes_held, id_type = [], [], 0, 0, None

        def close() -> Iterator[pa.RecordBatch]:
            sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
            number: dict[bytes, int] = {END: 0}
            token = np.fromiter(
                (number.setdefault(w, len(number)) for doc in words for w in (*doc, END)), np.int32, int(sizes.sum())
            )
            doc = np.repeat(np.arange(len(words), dtype=np.uint16), sizes)
            learnt = np.bincount(token[~np.array(held)[doc]], minlength=len(number))
            packed = doc[np.argsort(token, kind="stable")].tobytes()
            ends = (2 * np.cumsum(np.bincount(token, minlength=len(number)))).tolist()
            key = (part << 24) + block
            nothing = pa.nulls(len(number), pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(number), key)), pa.array(list(number), pa.binary()),
                pa.array(map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends)), pa.binary()), pa.array(learnt),
                pa.nulls(len(number), pa.list_(id_type)), nothing,
            ], names)
            yield pa.RecordBatch.from_arrays([
                pa.array([key]), pa.array([None], pa.binary()), pa.array([np.array(held, np.uint8).tobytes()], pa.binary()),
                pa.array([0]), pa.array([ids], pa.list_(id_type)), pa.array([sizes.astype(np.uint32).tobytes()], pa.binary()),
            ], names)

        for batch in batches:
            id_type = batch.column(0).type
            for key, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = (text.as_py() or "").encode().lower()
                split = raw.split()
                ids.append(key)
                held.append(bool(out))
                words.append(split)
                words_held, bytes_held = words_held + len(split) + 1, bytes_held + len(raw) + 64
                if words_held >= BLOCK_WORDS or bytes_held >= BLOCK_BYTES or len(ids) == BLOCK_DOCUMENTS:
                    yield from close()
                    words, ids, held, words_held, bytes_held, block = [], [], [], 0, 0, block + 1
        if ids:
            yield from close()

    names = ["block", "word", "docs", "training", "ids", "sizes"]
    return docs.mapInArrow(run, f"block bigint, word binary, docs binary, training bigint, ids array<{kind}>, sizes binary")


def _piece_counts(words: DataFrame, number: dict[bytes, int]) -> np.ndarray:
    """How often each piece is used to spell the different words; the last place counts the end. At most one row per piece comes to the driver."""
    longest, size = max(map(len, number)), len(number) + 1
    shared = words.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if word == END:
                    sums[-1] += 1
                else:
                    for i in _segment(word, shared.value, longest):
                        sums[i] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["piece", "n"])

    got = words.select("word").mapInArrow(run, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("piece").to_numpy()] = got.column("n").to_numpy()
    return out


def score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Every row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``, learning from rows not held out.

    Both scores are sums of base-10 logarithms over the tokens, ``base_score`` by counts of words plus one.
    """
    kind = dict(docs.dtypes)[id_col]
    cut = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("out"))
    postings = settle(_postings(cut), "postings")
    counts = settle(
        postings.filter("word is not null").groupBy("word").agg(F.sum("training").alias("c")).filter("c > 0"), "words"
    )
    # One row of totals: tokens, types, and the words seen once and twice for the discount.
    tokens, types, once, twice = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    ).first()
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    number = pieces(vocabulary)
    spelling = Spelling(number, _piece_counts(counts, number))
    shared = docs.sparkSession.sparkContext.broadcast(spelling)
    base_log, free = math.log10(tokens + types + 1), (discount * types / tokens if tokens else 1.0)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of words, packed by block: numbers of occurrences, their documents, the words' counts and scores."""
        by_pieces = shared.value
        blocks, docs_of, seen_of, spelt_of = [], [], [], []
        last: tuple = (None, 0.0)

        def packed() -> pa.RecordBatch:
            block, seen, spelt = np.concatenate(blocks), np.concatenate(seen_of), np.concatenate(spelt_of)
            order = np.argsort(block, kind="stable")
            borders = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
            rows = [order[a:b] for a, b in zip(borders, borders[1:])]
            lists = [[docs_of[i] for i in r.tolist()] for r in rows]
            return pa.RecordBatch.from_arrays([
                pa.array(block[order[borders[:-1]]]),
                pa.array([(np.fromiter(map(len, x), np.uint32, len(x)) // 2).tobytes() for x in lists], pa.binary()),
                pa.array([b"".join(x) for x in lists], pa.binary()),
                pa.array([seen[r].tobytes() for r in rows], pa.binary()), pa.array([spelt[r].tobytes() for r in rows], pa.binary()),
            ], ["block", "each", "docs", "seen", "spelt"])

        for batch in batches:
            words, seen = batch.column(1).to_pylist(), np.array([c or 0 for c in batch.column(3).to_pylist()], np.int64)
            spelt = np.empty(len(words))
            for i, word in enumerate(words):
                # Rows come sorted by word, so a word of many blocks is spelt once.
                if word != last[0]:
                    last = (word, by_pieces.end if word == END else by_pieces.word(word))
                spelt[i] = last[1]
            spelt += math.log(free)
            if tokens:
                # The word as one arc joins the paths by pieces.
                whole = np.log(np.maximum(seen - discount, 1e-300)) - math.log(tokens)
                spelt = np.where(seen > 0, np.logaddexp(spelt, whole), spelt)
            blocks.append(batch.column(0).to_numpy())
            docs_of += batch.column(2).to_pylist()
            seen_of.append(seen)
            spelt_of.append(spelt / math.log(10))
            if len(docs_of) >= PACKED_ROWS:
                yield packed()
                blocks, docs_of, seen_of, spelt_of = [], [], [], []
        if docs_of:
            yield packed()

    found = postings.filter("word is not null").select("block", "word", "docs").join(counts, "word", "left")
    valued = found.select("block", "word", "docs", "c").mapInArrow(
        values, "block bigint, each binary, docs binary, seen binary, spelt binary"
    )
    documents = postings.filter("word is null").select("block", "docs", "ids", "sizes")
    every = valued.unionByName(documents, allowMissingColumns=True)
    ordered = every.repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block follow its list of documents; a word's values are added to the documents that have it."""
        block = ids = held = sizes = known = base = lattice = None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                ids, pa.array(held), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), tokens)), pa.array(base), pa.array(lattice),
            ], names)

        for batch in batches:
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key != block:
                    if block is not None:
                        yield close()
                    block, ids = key, batch.column(5)[i].values
                    held = np.frombuffer(batch.column(2)[i].as_py(), np.uint8) > 0
                    sizes = np.frombuffer(batch.column(6)[i].as_py(), np.uint32).astype(np.int64)
                    known, base, lattice = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
                    continue
                each, doc, seen, spelt = (
                    np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((1, np.uint32), (2, np.uint16), (3, np.int64), (4, np.float64))
                )
                known += np.bincount(doc, np.repeat(seen > 0, each), len(sizes)).astype(np.int64)
                base += np.bincount(doc, np.repeat(np.log10(seen + 1) - base_log, each), len(sizes))
                lattice += np.bincount(doc, np.repeat(spelt, each), len(sizes))
        if block is not None:
            yield close()

    return ordered.mapInArrow(
        sums, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
