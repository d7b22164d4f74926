"""Queries by name, each with the SQL that must give the same rows (or none)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Decimal literals, which SQL engines type as exact decimals; with an exponent they are doubles, as in Spark expressions here.
_DECIMAL = re.compile(r"(?<![\w.])\d+\.\d+(?![\w.])")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = _DECIMAL.sub(lambda m: f"{m[0]}e0", " ".join(oracle.split()))
        return f

    return register
