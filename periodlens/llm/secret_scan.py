"""Finding secrets: three fixed patterns, and assignments read from source and configuration text.

Assignments are lexed into name-literal pairs: ``name = "literal"``, ``name: literal``, ``"name": "literal"``,
``export NAME=literal`` and the like. A name assigned to a name takes over its literal, however many steps away and
wherever in the text. A literal counts as a secret if the name it ends up under is sensitive and the literal looks
random enough for it: the more telling the name, the less is asked of the literal. Only a placeholder as a whole
(``${NAME}``, ``<...>``, ``{{...}}``, ``%s``) is none; blanks and signs within a literal do not matter. Literals joined
by ``+`` are judged as what they make together, and all of their pieces are spans; beside pieces that are secrets by
themselves, the others have the kind ``joined``. The value of a PEM block goes from its header to its last line.

Defined results: a null or empty text has no spans; spans are counted in code points, end exclusive; a literal
within a span that a fixed pattern has found is not added again; repeated rows are scanned each for itself; an empty
table gives an empty result. Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from periodlens.llm.common import arrow_map, narrow

# The patterns of the base scan and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

KINDS = ("assign", "access", "hex", "named", "joined")

# Words in a name that say what its value is, with the randomness asked of the value in bits.
SENSITIVE = {
    "password": 10, "passwd": 10, "passphrase": 10, "pwd": 12, "secret": 14, "token": 18, "apikey": 18, "credential": 14,
    "privatekey": 18, "accesskey": 18, "secretkey": 14, "authkey": 18, "encryptionkey": 18, "signingkey": 18, "bearer": 18,
}
_SENSITIVE_NAME = re.compile("|".join(SENSITIVE))
# What hints that a text needs its assignments read at all, and what the first pattern needs, in lower case.
_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "credential", "bearer", "key")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_PAIR = re.compile(
    r"""
    (?<![\w.-])(?P<quote>["']?)(?P<name>[A-Za-z_][\w.-]{0,127})(?P=quote)   # a name, quoted as in JSON or bare
    [ \t]{0,64}(?::[ \t]{0,8}[A-Za-z_]\w{0,63}[ \t]{0,8}(?==))?             # a type annotation
    (?:=>|:=|=(?!=)|:(?!:))[ \t]{0,64}
    (?P<value>
        (?!(?:"{3}|'{3})\s{0,64}-----BEGIN[ ])
        (?:"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')                   # quoted literals of any length, perhaps joined
        (?:[ \t]*+\+[ \t]*+(?:"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'))*+
      | (?:"{3}|'{3}|["']|[|>][-+]?)?\s{0,64}(?P<pem>-----BEGIN[ ][^-\n]++-----       # a PEM block over several lines
          (?:[^-]++|-(?!----(?:BEGIN|END)[ ]))*+-----END[ ][^-\n]++-----)
      | [^\s"',;(){}\[\]<>|]++                                             # a bare literal or a name
    )
    """,
    re.VERBOSE,
)
_LITERAL = re.compile(r"""(["'])((?:[^"'\\\n]++|\\.|(?!\1)["'])*+)\1""")
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*\Z")
_PLACEHOLDER = re.compile(r"\$\{[^{}]*\}|\$\([^()]*\)|\$[A-Z_][A-Z0-9_]*|<[^<>]*>|\{\{(?:(?!\}\}).)*\}\}|\{[^{}]*\}|%(?:\(\w*\))?[a-z]|%\w+%|\*+", re.DOTALL)
# Without quotes a name after a sign is a variable or an alias, too.
_BARE_PLACEHOLDER = re.compile(r"[$*&]\w+")
_NO_SECRET = frozenset("true false null none undefined nil yes no string str int bytes example changeme".split())


def _base_name(name: str) -> str:
    return re.sub(r"[-_.]", "", name.rpartition(".")[2] if "." in name else name).lower()


def _asked(name: str) -> int | None:
    """The randomness asked of a literal under this name, None if the name is not sensitive."""
    found = _SENSITIVE_NAME.findall(re.sub(r"[-_.]", "", name).lower())
    return min(map(SENSITIVE.__getitem__, found), default=None)


def randomness(literal: str) -> float:
    """Bits: the entropy of the characters, times their number."""
    n = len(literal)
    return -sum(c * math.log2(c / n) for c in Counter(literal).values())


def _convincing(literal: str, asked: int) -> bool:
    if len(literal) < 6 or literal.lower() in _NO_SECRET or _PLACEHOLDER.fullmatch(literal.strip()):
        return False
    # One kind of letter alone is a word, not a value; long values may be.
    mixed = sum(bool(re.search(x, literal)) for x in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return (mixed >= 2 or len(literal) >= 20) and randomness(literal) >= asked


def named_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that end up under sensitive names, with their kind."""
    # A literal is the spans of its pieces, mostly one.
    literals: dict[str, list[tuple[tuple[int, int], ...]]] = {}
    names: dict[str, set[str]] = {}
    asked: dict[str, int] = {}
    for m in _PAIR.finditer(text):
        name, value, at = _base_name(m["name"]), m["value"], m.start("value")
        if (bits := _asked(m["name"])) is not None:
            asked[name] = min(bits, asked.get(name, bits))
        here = literals.setdefault(name, [])
        if m["pem"]:
            here.append((m.span("pem"),))
        elif value[0] in "\"'":
            here.append(tuple((at + x.start(2), at + x.end(2)) for x in _LITERAL.finditer(value) if x[2]))
        else:
            end = len(value.rstrip(".,!?"))
            if _IDENTIFIER.match(value[:end]):
                names.setdefault(name, set()).add(_base_name(value[:end]))
            if not _BARE_PLACEHOLDER.fullmatch(value[:end]):
                here.append(((at, at + end),))
    # The least that any sensitive name asks of the literals of a name it can be traced back to: names are entered once,
    # by the least asking first. A bare word is a literal only where no such name is known.
    least: dict[str, int] = {}
    for name, bits in sorted(asked.items(), key=lambda x: x[1]):
        left = [name]
        while left:
            if (at := left.pop()) not in least:
                least[at] = bits
                left += [x for x in names.get(at, ()) if x in literals and x not in least]
    spans: dict[tuple[int, int], str] = {}
    for name, bits in least.items():
        for pieces in literals.get(name, ()):
            whole = "".join(text[a:b] for a, b in pieces)
            alone = {x for x in pieces if _base_name(text[slice(*x)]) not in literals and _convincing(text[slice(*x)], bits)}
            if alone or len(pieces) > 1 and _convincing(whole, bits):
                for x in pieces:
                    if x in alone or not alone:
                        spans[x] = "named"
                    else:
                        spans.setdefault(x, "joined")
    return sorted((a, b, kind) for (a, b), kind in spans.items())


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` of a whole text, by start and then by kind as listed in ``KINDS``."""
    if not text:
        return []
    low, out = text.lower(), []
    if any(x in low for x in _ASSIGN_HINTS):
        out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if any(x in low for x in _HINTS):
        # Of the base spans that begin by a, the one that reaches farthest.
        base = sorted(out)
        starts, reach = [x for x, *_ in base], list(accumulate((y for _, y, _ in base), max))
        for a, b, kind in named_spans(text):
            before = bisect_right(starts, a)
            if not before or reach[before - 1] < b:
                out.append((a, b, kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` for every row, ``spans`` an array of ``(start, end, kind)``."""
    kind = dict(docs.dtypes)[id_col]

    def rows(columns: list[list]) -> dict:
        found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)] for t in columns[1]]
        return {"id": columns[0], "spans": found}

    return arrow_map(
        narrow(docs, id=id_col, text=text_col), f"id {kind}, spans array<struct<start: bigint, end: bigint, kind: string>>", rows
    )


def masked(text: str, mark: str = "[secret]") -> str:
    """The text with every span, and spans that overlap as one, replaced by a mark."""
    out, at = [], 0
    for start, end, _ in scan(text):
        if start >= at:
            out += (text[at:start], mark)
        at = max(at, end)
    return "".join((*out, text[at:]))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs`` with secrets replaced in the text, and its length set anew if it has a column."""
    place, length = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else None
    if not isinstance(docs.schema[place].dataType, StringType):
        raise TypeError(f"{text_col} is no text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [t if t is None else masked(t, mark) for t in columns[place].to_pylist()]
            if length is not None:
                old, before = columns[length].to_pylist(), columns[place].to_pylist()
                new = [n if t == b else len(t) for n, t, b in zip(old, texts, before)]
                columns[length] = pa.array(new, columns[length].type)
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
