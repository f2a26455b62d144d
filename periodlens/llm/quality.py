"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated without labels.

Each rule looks at one property of a text and votes good, bad or not at all. Texts with the same votes are counted
over the whole table; expectation-maximisation on these counts estimates, for good and for bad texts, how often each
rule casts each vote, and with it the probability that a text with given votes is good. There are at most three to
the power of the rules different votes, so the driver and a broadcast hold a bounded table whatever the input.

Defined results: a null or empty text has all counts 0 and fails the base rules; repeated rows count as often as they
occur; an empty table gives an empty result. Texts are read whole; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.llm.common import SEPARATORS, arrow_map, narrow
from periodlens.sources.tables import settle

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
WINDOW = 3
# Different words are counted within stretches of this many words: a longer text has fewer new ones to add.
STRETCH = 200
BLOCK = 1 << 20

# A rule: the property it looks at, from where on it votes bad, and up to where good. Most kinds of junk show in more
# than one property, which is what lets the estimate tell a rule that is right from one that is not.
RULES = (
    ("symbols_per_word", 0.10, 0.02),
    ("odd_word_ends", 0.10, 0.02),
    ("other_characters", 0.12, 0.06),
    ("repeated_share", 0.30, 0.10),
    ("duplicate_lines", 0.30, 0.05),
    ("few_different_words", 0.75, 0.60),
    ("capital_share", 0.30, 0.10),
    ("loud_word_ends", 0.15, 0.05),
    ("digit_share", 0.20, 0.05),
)
# Before the first estimate: a text with a bad vote is taken to be bad with this probability, any other to be good.
TRUST = 0.9
# Votes added to each rule's counts, as a share of all texts, at these rates for (bad, no, good) votes on bad and on
# good texts: rules are expected to be better than chance.
PRIOR = 0.01
EXPECTED = ((0.5, 0.2, 0.3), (0.01, 0.09, 0.9))
STEPS = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Classes of characters by code point.
LETTER, CAPITAL, DIGIT, MARK, LOUD, BLANK = 1, 2, 4, 8, 16, 32
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASSES:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            table[i] = LETTER * c.isalpha() | CAPITAL * c.isupper() | DIGIT * c.isdigit()
        for c in ".,;:?!'\"()-":
            table[ord(c)] |= MARK
        table[ord("!")] |= LOUD
        for c in SEPARATORS:
            table[ord(c)] |= BLANK
        _CLASSES.append(table)
    return _CLASSES[0]


def numbered(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Equal words as equal numbers from 0, and how many different ones there are."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), len(number)


def repeated_words(ids: np.ndarray, different: int) -> int:
    """Words that lie in a window of three found twice or more."""
    if ids.size < WINDOW + 1:
        return 0
    # Pairs of ids are numbered anew, so that windows of any vocabulary fit into 64 bits.
    _, pair = np.unique(ids[:-1] * different + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * different + ids[2:], return_inverse=True, return_counts=True)
    covered = np.zeros(ids.size, bool)
    again = np.flatnonzero(times[window] > 1)
    for k in range(WINDOW):
        covered[again + k] = True
    return int(covered.sum())


def share_not_new(ids: np.ndarray) -> float:
    """Share of words that came before in their stretch, over the whole text cut into stretches of about equal length.

    A text of up to ``STRETCH`` words is one stretch; of a longer one none has more, so the share means the same at any
    length.
    """
    n = ids.size
    cuts = -(-n // STRETCH)
    stretch = np.arange(n) * cuts // n
    return 1 - np.unique(stretch * (int(ids.max()) + 1) + ids).size / n


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The counts named in ``COUNTS`` and the properties the rules look at."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    if not n:
        return [0, 0, sum(map(text.count, SYMBOLS)), 0, 0], [0.0] * len(RULES)
    symbols = sum(map(text.count, SYMBOLS))
    seen, repeats, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.encode().strip():
            lines += 1
            repeats += line in seen
            seen.add(line)
    ids, different = numbered(words)
    again = repeated_words(ids, different)
    # Characters by class, and those that end a word, block by block.
    sums = dict.fromkeys(("letters", "capitals", "digits", "blank", "other", "odd", "loud"), 0)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _classes()[codes]
        if at + BLOCK >= len(text):
            kind = np.append(kind, np.uint8(BLANK))
        kind, following = kind[:-1], kind[1:]
        blank = (kind & BLANK) > 0
        ends = ~blank & ((following & BLANK) > 0)
        plain = (kind & (LETTER | DIGIT | MARK)) > 0
        for name, mask in (
            ("letters", (kind & LETTER) > 0), ("capitals", (kind & CAPITAL) > 0), ("digits", (kind & DIGIT) > 0), ("blank", blank),
            ("other", ~plain & ~blank), ("odd", ends & ~plain), ("loud", ends & ((kind & LOUD) > 0)),
        ):
            sums[name] += int(np.count_nonzero(mask))
    chars = len(text) - sums["blank"]
    values = [
        symbols / n, sums["odd"] / n, sums["other"] / chars, again / n, repeats / lines,
        share_not_new(ids), sums["capitals"] / max(1, sums["letters"]), sums["loud"] / n, sums["digits"] / chars,
    ]
    return [n, chars, symbols, repeats, again], values


def votes(values: list[float]) -> str:
    """One character per rule: ``-`` bad, ``+`` good, ``0`` no vote."""
    return "".join("-" if v > bad else "+" if v <= good else "0" for v, (_, bad, good) in zip(values, RULES))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the counts and ``votes`` for every row."""
    kind = dict(docs.dtypes)[id_col]

    def rows(columns: list[list]) -> dict:
        made = [measure(t) for t in columns[1]]
        out = {name: [m[0][i] for m in made] for i, name in enumerate(COUNTS)}
        return {"id": columns[0], **out, "votes": [votes(m[1]) for m in made]}

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return arrow_map(narrow(docs, id=id_col, text=text_col), f"id {kind}, {counts}, votes string", rows)


class Estimate:
    """Prior of a good text, and probabilities of votes by rule, class (bad, good) and vote (bad, none, good)."""

    def __init__(self, patterns: list[str], counts: list[int]):
        self.patterns = patterns
        cast = np.array([["-0+".index(v) for v in p] for p in patterns]).reshape(len(patterns), -1)
        weight = np.array(counts, float)
        total = weight.sum()
        bad = (cast == 0).any(1)
        good = np.where(bad, 1 - TRUST, TRUST)
        onehot = cast[:, :, None] == np.arange(3)
        for _ in range(STEPS):
            each = np.stack([1 - good, good]) * weight
            sums = np.einsum("cp,prv->crv", each, onehot) + PRIOR * total * np.array(EXPECTED)[:, None, :]
            self.rules = sums / sums.sum(2, keepdims=True)
            self.prior = (each.sum(1) + 1) / (total + 2)
            log = np.log(self.prior)[:, None] + np.einsum("crv,prv->cp", np.log(self.rules), onehot)
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
            moved, good = np.abs(new - good).max(), new
            if moved < 1e-9:
                break
        self.good = good

    def accuracies(self) -> dict[str, float]:
        """How often each rule is right when it votes."""
        right = self.prior[0] * self.rules[0, :, 0] + self.prior[1] * self.rules[1, :, 2]
        wrong = self.prior[0] * self.rules[0, :, 2] + self.prior[1] * self.rules[1, :, 0]
        return {name: float(r / (r + w)) for (name, _, _), r, w in zip(RULES, right, wrong)}


def estimate(rows: DataFrame) -> Estimate | None:
    counts = rows.groupBy("votes").count().orderBy("votes").collect()
    return Estimate([r["votes"] for r in counts], [r["count"] for r in counts]) if counts else None


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``id``, the counts, ``base_failed``, ``p_good`` and ``kept`` for every row. Texts are read once."""
    rows = settle(measured(docs, id_col, text_col), "measured")
    model = estimate(rows)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    table = list(zip(model.patterns, map(float, model.good))) if model else []
    good = F.broadcast(docs.sparkSession.createDataFrame(table, "votes string, p_good double"))
    return rows.join(good, "votes").select(
        "id", *COUNTS, failed.alias("base_failed"), "p_good", (~failed & (F.col("p_good") >= least)).alias("kept")
    )
