"""Multi-line text: flatten, chunk, split into lines, count words of a lexicon.

All of it is built from native expressions. An expression that is used more than once is bound to a
lambda variable first (:func:`let`), because the optimiser would otherwise paste it into every use.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything up to and including the space counts as blank at the ends of a line.
BLANKS = "".join(map(chr, range(0x21)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def line_array(text: Column | str, escaped: bool = True) -> Column:
    """Trimmed, non-empty lines. ``escaped`` also breaks at a written-out ``\\n``."""
    raw = _text(text)
    if escaped:
        raw = F.replace(raw, F.lit("\\n"), F.lit("\n"))
    trimmed = F.transform(F.split(raw, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.filter(trimmed, lambda line: line != "")


def flatten(text: Column | str) -> Column:
    """One paragraph: lines joined by a single space; NULL or blank text becomes ``''``."""
    return F.coalesce(F.array_join(line_array(text), " "), F.lit(""))


def chunk(text: Column | str, lines: int = 8) -> Column:
    """Array of chunks, each ``lines`` consecutive lines joined by a space; blank text gives an empty array."""
    if lines < 1:
        raise ValueError("lines must be at least 1")

    def group(all_lines: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_lines), F.lit(lines))
        return F.when(
            F.size(all_lines) > 0,
            F.transform(starts, lambda s: F.array_join(F.slice(all_lines, s, F.lit(lines)), " ")),
        ).otherwise(F.array().cast("array<string>"))

    return F.coalesce(let(line_array(text), group), F.array().cast("array<string>"))


def lexicon_pattern(lexicon: Sequence[str]) -> str:
    """Whole-word alternation over lower-case text. Word edges follow Unicode letters on every Java version."""
    return r"(?U)\b(?:" + "|".join(re.escape(w.lower()) for w in dict.fromkeys(lexicon)) + r")\b"


def lexicon_counts(text: Column | str, lexicons: Sequence[Sequence[str]]) -> Column:
    """Array with the number of whole-word, case-insensitive matches of each lexicon; NULL for NULL text.

    One pass over the text finds the words of all lexicons, and only those are told apart afterwards. A
    lexicon with an entry that is not a single word could overlap with another one, and is matched alone.
    """
    lowered = F.lower(_text(text))
    for lexicon in lexicons:
        if not lexicon:
            raise ValueError("a lexicon needs at least one word")
    simple = [lexicon for lexicon in lexicons if all(re.fullmatch(r"\w+", w) for w in lexicon)]

    def count(found: Column | None, lexicon: Sequence[str]) -> Column:
        if lexicon not in simple:
            return F.regexp_count(lowered, F.lit(lexicon_pattern(lexicon)))
        if len(simple) == 1:
            return F.size(found)
        return F.size(F.filter(found, lambda w: w.isin(sorted({w.lower() for w in lexicon}))))

    if not simple:
        counted = F.array(*[count(None, lexicon) for lexicon in lexicons])
    else:
        pattern = lexicon_pattern([w for lexicon in simple for w in lexicon])
        found = F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))
        counted = let(found, lambda words: F.array(*[count(words, lexicon) for lexicon in lexicons]))
    return F.when(_text(text).isNotNull(), counted)


def lexicon_count(text: Column | str, lexicon: Sequence[str]) -> Column:
    """Number of matches of one lexicon in the whole text."""
    return F.get(lexicon_counts(text, [lexicon]), F.lit(0))
