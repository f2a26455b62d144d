"""Registered queries over the supplied tables, each with an equivalent SQL statement where SQL can express it."""

from __future__ import annotations

from periodlens.queries import changes, eras, labelled, means, near, storage, texts, trends, votes

_MODULES = (means, texts, trends, changes, labelled, eras, near, votes, storage)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
