"""Joins over sets and maps. Keys compare null-safely; results of set joins are duplicate-free.

No side is broadcast by hint: Spark does so below its own size limit and splits skewed keys at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _on(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str]) -> Column:
    on = None
    for a, b in zip(left_key, right_key, strict=True):
        one = left[a].eqNullSafe(right[b])
        on = one if on is None else on & one
    return on


def join_set(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], combine: Sequence[Column | str] | None = None, unique: bool = False) -> DataFrame:
    """Inner equi-join; ``combine`` projects the pairs. ``unique`` states that results cannot collide."""
    out = left.join(right, _on(left, right, left_key, right_key), "inner")
    out = out.select(*combine) if combine else out
    return out if unique else out.distinct()


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """The join on the unit key: meant for sides whose product is the wanted result."""
    return left.crossJoin(right).distinct()


def semi_join(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str]) -> DataFrame:
    return left.join(right, _on(left, right, left_key, right_key), "left_semi").distinct()


def anti_join(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str]) -> DataFrame:
    return left.join(right, _on(left, right, left_key, right_key), "left_anti").distinct()


def left_join(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], combine: Sequence[Column | str]) -> DataFrame:
    return left.join(right, _on(left, right, left_key, right_key), "left").select(*combine).distinct()


def right_join(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], combine: Sequence[Column | str]) -> DataFrame:
    return left.join(right, _on(left, right, left_key, right_key), "right").select(*combine).distinct()


def full_join(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], combine: Sequence[Column | str]) -> DataFrame:
    return left.join(right, _on(left, right, left_key, right_key), "full").select(*combine).distinct()


def map_join(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Inner join of two maps (key, value)."""
    lv, rv = (next(c for c in df.columns if c != key) for df in (left, right))
    return left.join(right, left[key].eqNullSafe(right[key]), "inner").select(left[key].alias(key), left[lv].alias(names[0]), right[rv].alias(names[1]))


def combine_latest(left: DataFrame, right: DataFrame, key: str, combine: dict[str, Column], required: str | None = None, names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Full outer combination of two maps. ``combine`` reads columns ``l`` and ``r``; a null in ``required`` drops the key."""
    lv, rv = (next(c for c in df.columns if c != key) for df in (left, right))
    a = left.select(F.col(key).alias("_lk"), F.col(lv).alias(names[0]), F.lit(True).alias("_has_l"))
    b = right.select(F.col(key).alias("_rk"), F.col(rv).alias(names[1]), F.lit(True).alias("_has_r"))
    both = a.join(b, F.col("_lk").eqNullSafe(F.col("_rk")), "full")
    out = both.select(F.coalesce("_lk", "_rk").alias(key), *[c.alias(n) for n, c in combine.items()])
    return out.filter(F.col(required).isNotNull()) if required else out


def lookup_join(fact: DataFrame, dimension: DataFrame, fk: Sequence[str], key: Sequence[str], combine: dict[str, Column], required: str | None = None, inner: bool = False) -> DataFrame:
    """Each fact with its dimension row or nulls; a null in ``required`` drops the fact."""
    out = fact.join(dimension, _on(fact, dimension, fk, key), "inner" if inner else "left").select(*[c.alias(n) for n, c in combine.items()])
    return out.filter(F.col(required).isNotNull()) if required else out


def coalescing_sum(counters: Sequence[DataFrame], value: str, name: str = "total") -> DataFrame:
    """Sum over a fan-in of counters (one amount a row); one value for the whole batch."""
    parts = [c.agg(F.coalesce(F.sum(value), F.lit(0)).alias("v")) for c in counters]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.sum("v").cast("long").alias(name))
