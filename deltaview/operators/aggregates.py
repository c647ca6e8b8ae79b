"""Grouped aggregates over sets: rows are made distinct first, then values are projected.

A group without rows does not exist, the global group included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregator:
    """A named aggregate: its batch expression, whether it can be undone by weights, and that form.

    ``weighted`` maps a weight column (+1, -1) to the expression over a changelog.
    """

    name: str
    batch: Column
    weighted: Callable[[Column], Column] | None = None

    @property
    def invertible(self) -> bool:
        return self.weighted is not None


def count(name: str = "count") -> Aggregator:
    return Aggregator(name, F.count(F.lit(1)), lambda w: F.sum(w))


def sum_of(value: Column, name: str = "sum") -> Aggregator:
    """Sum of whole numbers; an overflow is an error."""
    return Aggregator(name, F.sum(value), lambda w: F.sum(w * value))


def avg_of(value: Column, name: str = "avg") -> Aggregator:
    return Aggregator(name, F.sum(value).cast("double") / F.count(F.lit(1)), lambda w: F.sum(w * value).cast("double") / F.sum(w))


def min_of(value: Column, name: str = "min") -> Aggregator:
    return Aggregator(name, F.min(value))


def max_of(value: Column, name: str = "max") -> Aggregator:
    return Aggregator(name, F.max(value))


def collect_to_set(columns: Sequence[str], name: str = "members") -> Aggregator:
    return Aggregator(name, F.array_sort(F.collect_set(F.struct(*columns))))


def wilson(positive: Column, name: str = "score", z: float = 1.96) -> Aggregator:
    """Lower bound of the rate of ``positive`` rows."""

    def bound(wins: Column, n: Column) -> Column:
        p = wins / n
        z2 = z * z
        return (p + z2 / (2 * n) - z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)

    one = F.when(positive, F.lit(1)).otherwise(F.lit(0))
    return Aggregator(name, bound(F.sum(one).cast("double"), F.count(F.lit(1)).cast("double")), lambda w: bound(F.sum(w * one).cast("double"), F.sum(w).cast("double")))


def group_by(df: DataFrame, key: Sequence[Column | str], *aggregators: Aggregator, unique: bool = False) -> DataFrame:
    rows = df if unique else df.distinct()
    return rows.groupBy(*key).agg(*[a.batch.alias(a.name) for a in aggregators])


def group_global(df: DataFrame, *aggregators: Aggregator, unique: bool = False) -> DataFrame:
    """One group named "global"; no row where there is no element."""
    return group_by(df, [F.lit("global").alias("key")], *aggregators, unique=unique)


def top_rows(df: DataFrame, key: Sequence[str], value: str, k: int, unique: bool = False) -> DataFrame:
    """key, rank, value: the k largest values of each group with their repeats.

    Ranks are limited before the shuffle, so that a large group sends k rows a task.
    """
    rows = (df if unique else df.distinct()).select(*key, value)
    order = W.partitionBy(*key).orderBy(F.desc_nulls_last(value))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, key: Sequence[str], value: str, k: int, name: str = "top", unique: bool = False) -> DataFrame:
    """The k largest values of each group, descending, as an array."""
    best = top_rows(df, key, value, k, unique).groupBy(*key).agg(F.sort_array(F.collect_list(value), False).alias(name))
    return best


def mergeable_group_by(parts: Sequence[DataFrame], key: Sequence[str], partial: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """Partial accumulators of each part, merged by key. ``merge`` reads the partial columns."""
    done = [p.distinct().groupBy(*key).agg(*[c.alias(n) for n, c in partial.items()]) for p in parts]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy(*key).agg(*[c.alias(n) for n, c in merge.items()])


def partitioned_group_by(df: DataFrame, key: Sequence[str], n: int, *aggregators: Aggregator) -> DataFrame:
    """Dealt to n partitions by key; the aggregate then needs no exchange of its own."""
    rows = df.distinct().repartition(n, *key)
    return rows.groupBy(*key).agg(*[a.batch.alias(a.name) for a in aggregators])
