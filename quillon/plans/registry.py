"""Names every ledger query with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import activity_queries, event_queries, import_queries, ledger_queries, statement_queries, stream_queries

_ADDED = (activity_queries, import_queries, event_queries, statement_queries, stream_queries)  # modules that add their queries to the same table


def queries() -> dict[str, ledger_queries.Query]:
    return dict(ledger_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ledger_queries.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's summary."""
    return ledger_queries.QUERIES["agg_summary"](spark, sf_dir)
