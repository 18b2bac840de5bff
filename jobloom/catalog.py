"""The registry of queries: name -> builder, and name -> SQL where a query has an equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.operators import timestamps, units
from jobloom.plans import reference
from jobloom.session import shared_dir
from jobloom.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.unify_pay(table(spark, d, "jobs"), table(spark, d, "pay_units"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_instants(table(spark, d, "jobs"), table(spark, d, "feed_sources"), store=f"{shared_dir(spark)}/timestamp-dictionary")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p6_found": p6_found} | reference.queries()


def oracle_sql() -> dict[str, str]:
    return reference.oracle_sql()
