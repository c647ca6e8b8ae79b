"""Operators over sets: every result is duplicate-free."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_set(df: DataFrame, unique: bool = False) -> DataFrame:
    """Distinct rows; ``unique`` states that a key already makes them so, which saves the shuffle."""
    return df if unique else df.distinct()


def filter_set(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def map_set(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Colliding results are one element."""
    return df.select(*columns).distinct()


def flat_map_set(df: DataFrame, items: Column, name: str) -> DataFrame:
    """items: array of results of each element."""
    return df.select(F.explode(items).alias(name)).distinct()


def map_stream(df: DataFrame, *columns: Column | str) -> DataFrame:
    """A plain stream is no set: nothing is merged."""
    return df.select(*columns)


def key_by(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.withColumn(name, key)


def count_set(df: DataFrame, name: str = "n") -> DataFrame:
    """One row, 0 for the empty set."""
    return df.distinct().agg(F.count(F.lit(1)).alias(name))


def union_set(*inputs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, inputs).distinct()


def intersect_set(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right.select(*left.columns))


def difference_set(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right.select(*left.columns))


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag difference, an extra beside the sets."""
    return left.exceptAll(right.select(*left.columns))


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersectAll(right.select(*left.columns))


def presence_count(inputs: Sequence[DataFrame], name: str = "presence") -> DataFrame:
    """Element and the number of inputs that hold it; elements that none holds are absent."""
    tagged = [df.distinct() for df in inputs]
    return reduce(DataFrame.unionByName, tagged).groupBy(*inputs[0].columns).agg(F.count(F.lit(1)).cast("int").alias(name))


def quorum(inputs: Sequence[DataFrame], threshold: Callable[[int], int]) -> DataFrame:
    """Elements that at least threshold(n) of the n inputs hold. n counts empty inputs too."""
    need = threshold(len(inputs))
    return presence_count(inputs, "_presence").filter(F.col("_presence") >= need).drop("_presence")


def any_of(n: int) -> int:
    return 1


def all_of(n: int) -> int:
    return n


def majority(n: int) -> int:
    return n // 2 + 1


def near_miss(n: int) -> int:
    return n - 1


def k_of_n(k: int) -> Callable[[int], int]:
    return lambda n: k
