"""All queries of the core with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veyra.plans import additional, dealt, further, geo, joins, linking, listing, nested, registry, relational, rules, shaping, streams, texts, windows  # noqa: F401  (modules register their queries)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return registry.QUERIES["two_level_average"](spark, d)


def queries() -> dict:
    return {**dealt.QUERIES, **registry.QUERIES}


def oracle_sql() -> dict:
    return {**dealt.ORACLE, **registry.ORACLE}
