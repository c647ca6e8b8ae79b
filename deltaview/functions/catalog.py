"""The scalar functions of the neutral catalog as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity(c: Column) -> Column:
    return c


def eq(c: Column, value) -> Column:
    """Equality that null answers too."""
    return c.eqNullSafe(F.lit(value))


def gt(c: Column, n) -> Column:
    """False for what is not a number."""
    return F.coalesce(c > F.lit(n), F.lit(False))


def lt(c: Column, n) -> Column:
    return F.coalesce(c < F.lit(n), F.lit(False))


def mod_eq(c: Column, m: int, r: int) -> Column:
    """Floor modulus, so that negative numbers count from below."""
    return F.coalesce(F.pmod(c, F.lit(m)) == F.lit(r), F.lit(False))


def even(c: Column) -> Column:
    return mod_eq(c, 2, 0)


def odd(c: Column) -> Column:
    return mod_eq(c, 2, 1)


def concat(c: Column, suffix: str) -> Column:
    return F.concat(c.cast("string"), F.lit(suffix))


def add(c: Column, n: int) -> Column:
    return F.coalesce(c, F.lit(0)) + F.lit(n)


def key_of(items: Column) -> Column:
    """First item of an array."""
    return F.get(items, F.lit(0))


def value_of(items: Column) -> Column:
    """Second item of an array, else the first."""
    return F.coalesce(F.get(items, F.lit(1)), F.get(items, F.lit(0)))


def json_text(c: Column) -> Column:
    """Plain text of a JSON scalar: quotes of a string are undone, numbers and booleans stay."""
    return F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")


def truthy(c: Column) -> Column:
    """Null is false."""
    return F.coalesce(json_text(c).isin("1", "true"), F.lit(False))


def found_in(query: str, *columns: Column) -> Column:
    """Case-insensitive substring search over all columns."""
    needle = F.lower(F.lit(query))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c.cast("string")), needle), F.lit(False))
    return hit
