"""Event-time buckets over integer time. Buckets never close: late rows are ordinary rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tumbling_start(at: Column, size: int) -> Column:
    """Floor to a multiple of size; negative times floor downwards."""
    if size <= 0:
        raise ValueError("size must be positive")
    return at - F.pmod(at, F.lit(size))


def sliding_starts(at: Column, size: int, slide: int) -> Column:
    """Array of all multiples s of slide with s <= at < s + size, ascending."""
    if not 0 < slide <= size:
        raise ValueError("slide must lie in 1 .. size")
    last = at - F.pmod(at, F.lit(slide))
    back = F.floor((F.lit(size - 1) - F.pmod(at, F.lit(slide))) / F.lit(slide)) * F.lit(slide)
    return F.sequence(last - back.cast("long"), last, F.lit(slide).cast("long"))


def epoch_seconds(ts: Column) -> Column:
    """Floor seconds since the epoch of a timestamp without zone, read as UTC."""
    return F.unix_seconds(ts.cast("timestamp"))
