"""Invariants as data: violations, comparisons of two plans, and the verdict on a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows that do not satisfy the check; an unknown answer is a violation."""
    return df.filter(~F.coalesce(check, F.lit(False)))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either plan alone, with the side they are on."""
    a = left.subtract(right.select(*left.columns)).withColumn("side", F.lit("left"))
    b = right.select(*left.columns).subtract(left).withColumn("side", F.lit("right"))
    return a.unionByName(b)


def promotable(incumbent: DataFrame, candidate: DataFrame, check: Column, most_different: int = 0) -> bool:
    """Whether the candidate breaks the check no more often and differs in no more rows than allowed."""
    old, new = violations(incumbent, check).count(), violations(candidate, check).count()
    return new <= old and difference(incumbent, candidate).count() <= most_different


def schema_mismatch(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns whose name or type differ."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return sorted(c for c in a.keys() | b.keys() if a.get(c) != b.get(c))
