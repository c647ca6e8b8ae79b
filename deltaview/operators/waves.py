"""Waves: what may be shown once every arm, or every covering replica, has delivered it.

Rows carry the position (wave) that their source gave them. Progress is a table, so that a frontier
is one small aggregate and the rows are filtered by it; a micro-batch writes progress and reads views.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaview.operators.joins import semi_join

WAIT, DEGRADE = "wait", "degrade"
#: States of an arm or member: delivering, held back for now, gone for good.
LIVE, STALLED, ENDED = "live", "stalled", "ended"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _holds(state: Column, mode: str) -> Column:
    if mode not in (WAIT, DEGRADE):
        raise ValueError(f"mode {mode}: {WAIT} or {DEGRADE}")
    # an arm that ended never holds a wave; one that stalls does so only where readers wait for it
    return state != ENDED if mode == WAIT else state == LIVE


def settled(progress: DataFrame, mode: str = WAIT, by: Sequence[str] = ()) -> DataFrame:
    """progress: by.., through, state, one row an arm. The last wave (``frontier``) that all arms which hold have delivered.

    An arm that has delivered nothing (null) holds every wave; where no arm holds all waves are settled.
    """
    through = F.when(_holds(F.col("state"), mode), F.coalesce("through", F.lit(_LEAST)))
    return progress.groupBy(*by).agg(F.coalesce(F.min(through), F.lit(_MOST)).alias("frontier"))


def released(rows: DataFrame, wave: str, frontier: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows at or behind the frontier of their group; groups without arms release nothing."""
    names = {c: f"_by_{c}" for c in by}
    bound = frontier.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("frontier").alias("_frontier"))
    on = F.col(wave) <= F.col("_frontier")
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    return rows.join(bound, on, "left_semi")


def late(rows: DataFrame, wave: str, before: DataFrame, now: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows that the newer frontier releases and the older one did not: catch-up after a stall."""
    cols = rows.columns
    return released(rows, wave, now, by).join(released(rows, wave, before, by).select(*[F.col(c).alias(f"_old_{c}") for c in cols]), _same(cols), "left_anti")


def _same(cols: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return on


def semi_join_on_frontier(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], wave: str, frontier: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The semi-join as of the frontier: a wave shows all that it changes, or nothing yet."""
    return semi_join(released(left, wave, frontier, by), released(right, wave, frontier, by), left_key, right_key)


def quorum(members: DataFrame, reports: DataFrame, mode: str = WAIT, fence: bool = True) -> DataFrame:
    """slot, source, frontier: the last wave of a source that all members covering a slot have delivered.

    members: member, slots (array), state; reports: member, source, through. A covering member without a
    report of the source holds all its waves, as it may have joined just now; without ``fence`` it is
    passed over. Slots without a covering member are absent, so that they release nothing.
    """
    cover = members.filter(_holds(F.col("state"), mode)).select("member", F.explode("slots").alias("slot")).distinct()
    needed = cover.groupBy(F.col("slot").alias("_slot")).agg(F.count(F.lit(1)).alias("_members"))
    told = reports.groupBy(F.col("member").alias("_member"), "source").agg(F.max("through").alias("through"))
    # both tables have a row for each member and slot or source, not for each element
    met = cover.join(told, F.col("member") == F.col("_member")).groupBy("slot", "source").agg(F.min("through").alias("frontier"), F.count(F.lit(1)).alias("_told"))
    out = met.join(needed, F.col("slot") == F.col("_slot"))
    return (out.filter(F.col("_told") == F.col("_members")) if fence else out).select("slot", "source", "frontier")


def quorum_released(rows: DataFrame, slot: Column, source: str, wave: str, frontier: DataFrame) -> DataFrame:
    """Rows whose wave the quorum of their slot has delivered."""
    bound = frontier.select(F.col("slot").alias("_q_slot"), F.col("source").alias("_q_source"), F.col("frontier").alias("_q_frontier"))
    return rows.join(bound, (slot == F.col("_q_slot")) & (F.col(source) == F.col("_q_source")) & (F.col(wave) <= F.col("_q_frontier")), "left_semi")
