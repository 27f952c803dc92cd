"""All queries of the evaluation engine, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import suite_arrays, suite_checks, suite_comparison, suite_conflicts, suite_evidence, suite_records, suite_scoring, suite_sequences, suite_streaming, suite_text, suite_wording

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (suite_scoring, suite_comparison, suite_sequences, suite_text, suite_streaming, suite_evidence, suite_checks, suite_conflicts, suite_wording, suite_arrays, suite_records)


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
