"""Registry of the core's queries: name -> (builder, oracle SQL or None)."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.numbers import OFFSET

Builder = Callable[[SparkSession, str], DataFrame]
_ENTRIES: dict[str, tuple[Builder, str | None]] = {}
#: Modules of this package that register queries.
MODULES = ("retrieval_queries", "array_queries", "stats_queries", "text_queries", "item_queries", "audit_queries", "source_queries", "file_queries")


def nudge(sql: str) -> str:
    """The SQL with the offset of ``rounded`` added wherever it rounds to 4, 5, 6 or 8 digits."""
    out, i = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < i:
            continue
        depth, comma, k = 1, None, m.end()
        while depth:
            c = sql[k]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = k
            k += 1
        out.append(sql[i : m.start()])
        if comma and sql[comma + 1 : k - 1].strip() in ("4", "5", "6", "8"):
            out.append(f"round(({nudge(sql[m.end() : comma])}) + {OFFSET!r}::DOUBLE, {sql[comma + 1 : k - 1].strip()})")
        else:
            out.append(f"round({nudge(sql[m.end() : k - 1])})")
        i = k
    return "".join(out) + sql[i:]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its own name, with the SQL that must give the same rows."""

    def add(build: Builder) -> Builder:
        key = name or build.__name__
        if key in _ENTRIES:
            raise ValueError(f"two queries named {key}")
        _ENTRIES[key] = (build, nudge(sql) if sql else None)
        return build

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"quillon.plans.{module}")


def queries() -> dict[str, Builder]:
    _load()
    return {k: b for k, (b, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _ENTRIES.items() if s is not None}
