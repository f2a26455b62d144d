"""Chat formatting by assembling tokens.

A turn becomes ``<s>[INST]`` role ``[/INST]`` text ``</s>``. Role and text are encoded separately by byte-level BPE;
the four control strings are reserved ids beyond the vocabulary that no text can encode to. In the written form a
control string inside a role or text is escaped by a backslash after its first character, so the written form can be
parsed back as well. The loss mask marks the text of assistant turns: steps up and down at segment borders, summed.

A conversation is the concatenation of its turns by (turn, role, text), nulls first. Defined results: a null text or
role is an empty one; turns may repeat; a null conversation id is a conversation of its own; an empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.llm.common import narrow

CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
# Also escaped, though not used by the template: the end of text of the tokenizer's vocabulary.
FOREIGN = ("<|endoftext|>",)
LEARNS = "assistant"

_TAILS = "|".join(re.escape(x[1:]) for x in (*CONTROL, *FOREIGN))
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


class Codec:
    """Encodes and decodes segments; the reserved ids follow the vocabulary and its end of text."""

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 2
        self.bos, self.open, self.close, self.eos = range(first, first + len(CONTROL))

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a turn."""
        who, what = self.bpe.encode_ordinary(escape(role)), self.bpe.encode_ordinary(escape(text))
        ids = np.array([self.bos, self.open, *who, self.close, *what, self.eos], np.int32)
        steps = np.zeros(len(ids), np.int8)
        if role == LEARNS:
            steps[3 + len(who)] += 1
            steps[len(ids) - 1] -= 1
        return ids, np.cumsum(steps, dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        return self.bpe.decode_bytes(ids.tolist()).decode()

    def written(self, ids: np.ndarray) -> str:
        """The written form of ids, control strings included."""
        at = np.flatnonzero(ids >= self.bos)
        texts = [self.text(ids[a:b]) for a, b in zip([0, *(at + 1)], [*at, len(ids)])]
        marks = [CONTROL[i - self.bos] for i in ids[at].tolist()]
        return "".join(x for pair in zip(texts, [*marks, ""]) for x in pair)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str]:
        """Role, text and text under the mask of one turn."""
        close = int(np.flatnonzero(ids == self.close)[0])
        return tuple(unescape(self.text(x)) for x in (ids[2:close], ids[close + 1 : -1], ids[mask > 0]))


def format_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """``(conv, turn, ids, loss_mask, written)`` per turn, in the tasks that read the table. No turn needs another one."""
    cut = narrow(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    types = dict(turns.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in _slices(batches):
            made = [codec.turn(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x for x, _ in made], pa.list_(pa.int32())),
                pa.array([x for _, x in made], pa.list_(pa.int8())), pa.array([codec.written(x) for x, _ in made], pa.string()),
            ], ["conv", "turn", "ids", "loss_mask", "written"])

    return cut.mapInArrow(
        run, f"conv {types[conv_col]}, turn {types[turn_col]}, ids array<int>, loss_mask array<tinyint>, written string"
    )


def read_turns(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(conv, turn, role, text, loss_text, chars)`` per formatted turn; all but ``chars`` from ids and mask alone."""
    types = dict(formatted.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in _slices(batches):
            read = [codec.read(i.values.to_numpy(), m.values.to_numpy()) for i, m in zip(batch.column(2), batch.column(3))]
            texts = [pa.array([x[k] for x in read], pa.string()) for k in range(3)]
            chars = pa.array(list(map(len, batch.column(4).to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *texts, chars], ["conv", "turn", "role", "text", "loss_text", "chars"]
            )

    return formatted.select("conv", "turn", "ids", "loss_mask", "written").mapInArrow(
        run, f"conv {types['conv']}, turn {types['turn']}, role string, text string, loss_text string, chars bigint"
    )


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation: number of turns and SHA-256 of its turns and of its loss text, in order.

    A hash of a sequence has to see it in order, so the rows of a conversation pass through one task. They are sorted
    by Spark and streamed; the task holds two hash states, never a conversation.
    """
    kind = dict(read.dtypes)["conv"]
    ordered = read.repartition("conv").sortWithinPartitions(
        F.col("conv").isNull(), "conv", F.col("turn").asc_nulls_first(), "role", "text"
    )
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        open_, key, turns, loss = False, None, None, None
        n = chars = loss_chars = 0
        conv_type = None

        def close() -> None:
            if open_:
                for c, v in zip(out, (key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)):
                    c.append(v)

        def flush() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            conv_type = batch.column(0).type
            conv, _, roles, texts, losses, sizes = (c.to_pylist() for c in batch.columns)
            for c, role, text, learnt, size in zip(conv, roles, texts, losses, sizes):
                if not open_ or c != key:
                    close()
                    open_, key, n, chars, loss_chars = True, c, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learnt.encode())
                n, chars, loss_chars = n + 1, chars + size, loss_chars + len(learnt)
            if len(out[0]) >= 10_000:
                yield flush()
        close()
        if out[0]:
            yield flush()

    return ordered.mapInArrow(
        run, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
