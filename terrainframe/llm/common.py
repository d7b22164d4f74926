"""What the operators share: written intermediate tables, input reading, small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrainframe.tables import discard, materialise, shared_dir, table

__all__ = ["LONG", "discard", "forget_long", "let", "materialise", "shared_dir", "table"]

#: Characters of the longest word that a memo keeps: with a bound on entries, a bound on bytes. A paragraph without blanks is one word, and hardly comes again.
LONG = 64


def forget_long(memo: dict, words) -> None:
    for w in words:
        if len(w) > LONG:
            memo.pop(w, None)


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it many times and it is computed once a row."""
    return F.transform(F.array(value), body)[0]
