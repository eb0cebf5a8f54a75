"""Registered queries: one Spark callable per operator of the inventory and,
where SQL can state it, an independent DuckDB oracle string.

Every query reads the given parquet tables (through the fixtures) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _no_negative_zero(sql: str) -> str:
    """Wrap every ``round(...)`` of an oracle as ``(round(...) + 0.0)``:
    DuckDB can round a tiny negative value to -0.0, Spark gives 0.0."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 0, j + len(key) - 1
        while k < len(sql):
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        inner = _no_negative_zero(sql[j + len(key):k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = _no_negative_zero(oracle)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from evalspark.plans import (  # noqa: F401
        q_compare,
        q_errors,
        q_explain,
        q_generate,
        q_io,
        q_metrics,
        q_models,
        q_prep,
        q_sample,
        q_text,
    )
