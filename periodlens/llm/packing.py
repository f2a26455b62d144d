"""Packing token sequences into equal windows by multiway Karmarkar-Karp differencing.

Every task tokenizes its own documents and packs them as it reads, so there is no shuffle and no group to skew: a
task holds one block of ``windows * (capacity - slack)`` ids at a time. Stretches of ``capacity`` ids fill a window of their own; what
is left of a document is cut into pieces, and differencing spreads a block's pieces over windows of nearly equal
length. If a window comes out above the capacity, the block is spread again over one window more.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each for itself; a null id
stays null; an empty table gives no rows. Other columns are not looked at. Reading the same partitions again gives
the same windows, so a lost task can be repeated.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from periodlens.llm.common import narrow

CAPACITY = 1024
WINDOWS = 32
# Ids left free in a window on average, which is what differencing may miss the mean by.
SLACK = 8
PIECE = 128
CLOSING = 0
# Characters encoded at once.
STRETCH = 1 << 20


def bpe_encoder(vocabulary: str | None = None, pattern: str | None = None) -> Callable[[str], np.ndarray]:
    """Byte-level BPE ids of a text as unsigned 32-bit integers.

    The vocabulary is read as ranks, which the faster of the two libraries takes; the ids are those of the JSON file.
    A long text is encoded by stretches. They end before a lone space between two other characters, where a piece of
    the pre-tokenizer always begins, so the ids are those of the whole text.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding(
        "bytes", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary
    border = re.compile(r"(?<=\S) (?=\S)")

    def ids(text: str) -> np.ndarray:
        out, at = array("I"), 0
        while len(text) - at > STRETCH and (m := border.search(text, at + STRETCH)):
            out.extend(encode(text[at : m.start()]))
            at = m.start()
        out.extend(encode(text[at:] if at else text))
        return np.frombuffer(out, np.uint32)

    return ids


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Spread items over windows of nearly equal sums: per window the positions of its items.

    A partial partition is a row of window sums with their items. The two whose sums differ most within themselves
    are merged, the large sums of one with the small sums of the other, until one is left.
    """
    heap = [(-s, i, [0] * (windows - 1) + [s], [()] * (windows - 1) + [(i,)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        held = [(x, y) if x and y else x or y for x, y in zip(held_a, reversed(held_b))]
        order = sorted(range(windows), key=sums.__getitem__)
        low = sums[order[0]]
        # The smallest sum is common to all windows and does not count towards a difference.
        count += 1
        heapq.heappush(heap, (low - sums[order[-1]], count, [sums[i] for i in order], [held[i] for i in order]))
    out = []
    for held in heap[0][3] if heap else []:
        items, left = [], [held]
        while left:
            x = left.pop()
            if isinstance(x, tuple):
                left += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def spread(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as hold everything; one more whenever one of them comes out above the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        out = difference(sizes, windows)
        if max((sum(sizes[i] for i in w) for w in out), default=0) <= capacity:
            return [w for w in out if w]
        windows += 1


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, windows: int = WINDOWS,
    encoder: Callable[[], Callable[[str], np.ndarray]] = bpe_encoder,
) -> DataFrame:
    """One row per piece: ``id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers; ``start`` counts the ids of its document
    before it, ``offset`` those of its sequence. Sequence numbers are unique, not gapless.
    """
    kind = dict(docs.dtypes)[id_col]
    cut = narrow(docs, id=id_col, text=text_col)
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    target = windows * (capacity - min(SLACK, capacity // 2))
    piece = max(1, min(PIECE, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(), TaskContext.get().partitionId() << 40
        block: list[tuple] = []
        held, id_type = 0, None
        out: list[list] = [[] for _ in names]
        written = 0

        def put(key, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
            nonlocal written
            for column, value in zip(out, (key, start, len(ids), ids.tobytes(), total, sequence, offset)):
                column.append(value)
            written += len(ids)

        def close() -> None:
            nonlocal number, held
            for window in spread([len(x[2]) for x in block], capacity):
                offset = 0
                for i in window:
                    put(*block[i], number, offset)
                    offset += len(block[i][2])
                number += 1
            block.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            nonlocal written
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
            for c in out:
                c.clear()
            written = 0
            return batch

        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(CLOSING))
                total, whole = len(ids), len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    put(key, at, ids[at : at + capacity], total, number, 0)
                    number += 1
                    if written >= 1 << 20:
                        yield flush()
                at = whole
                while at < total:
                    # The last piece of a block takes just what the block still wants.
                    n = min(piece, total - at, target - held)
                    block.append((key, at, ids[at : at + n], total))
                    at, held = at + n, held + n
                    if held >= target:
                        close()
                if written >= 1 << 20:
                    yield flush()
        if block:
            close()
        if written:
            yield flush()

    return cut.mapInArrow(
        run, f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
