"""Checks as queries: rows that break a rule, as (rule, key). No rows: the table passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """All rules in one pass. A rule holds where its column is true or null."""
    broken = F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items()))
    return df.select(F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"), F.col(key).cast("long").alias("key"))
