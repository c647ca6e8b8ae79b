"""Key scopes that become predicates, so that Catalyst can push them into scans."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Interest:
    """A set of keys. Combine with |, & and ~."""

    def holds(self, key: Column) -> Column:
        raise NotImplementedError

    def within(self, df: DataFrame, key: Column) -> DataFrame:
        return df.filter(self.holds(key))

    def __or__(self, other: Interest) -> Interest:
        return _Both(self, other, any_of=True)

    def __and__(self, other: Interest) -> Interest:
        return _Both(self, other, any_of=False)

    def __invert__(self) -> Interest:
        return _Not(self)


@dataclass(frozen=True)
class Everything(Interest):
    def holds(self, key: Column) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Nothing(Interest):
    def holds(self, key: Column) -> Column:
        return F.lit(False)


@dataclass(frozen=True)
class _Both(Interest):
    a: Interest
    b: Interest
    any_of: bool

    def holds(self, key: Column) -> Column:
        x, y = self.a.holds(key), self.b.holds(key)
        return x | y if self.any_of else x & y


@dataclass(frozen=True)
class _Not(Interest):
    a: Interest

    def holds(self, key: Column) -> Column:
        return ~self.a.holds(key)


class Ranges(Interest):
    """Half-open ranges [low, high); None is unbounded. A null key lies in none."""

    def __init__(self, spans: Iterable[tuple]):
        self.spans = list(spans)

    def holds(self, key: Column) -> Column:
        out = F.lit(False)
        for low, high in self.spans:
            hit = F.lit(True)
            if low is not None:
                hit = hit & (key >= F.lit(low))
            if high is not None:
                hit = hit & (key < F.lit(high))
            out = out | F.coalesce(hit & key.isNotNull(), F.lit(False))
        return out


class Slots(Interest):
    """Keys whose slot out of n is among those given; integer keys by floor modulus, others by hash."""

    def __init__(self, n: int, slots: Iterable[int], hashed: bool = False):
        self.n, self.slots, self.hashed = n, sorted(set(slots)), hashed

    def holds(self, key: Column) -> Column:
        slot = F.pmod(F.xxhash64(key) if self.hashed else key, F.lit(self.n))
        return F.coalesce(slot.isin(self.slots), F.lit(False)) if self.slots else F.lit(False)
