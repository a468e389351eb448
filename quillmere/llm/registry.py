"""The queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import alignment, language, leaks, mixing, neighbours, pages, splitting, subjects, tokens

MODULES = (language, neighbours, pages, tokens, alignment, splitting, leaks, mixing, subjects)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
