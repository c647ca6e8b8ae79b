"""Gradual argumentation (DF-QuAD) over claims and weighted edges that are claims themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaview.plans.iterate import fixpoint

#: Least base of a claim, and its distance from one.
BASE_FLOOR = 0.01


def base_scores(claims: DataFrame, stances: DataFrame) -> DataFrame:
    """claim, base: the mean stance, one half without any, kept off 0 and 1."""
    mean = stances.groupBy(F.col("claim").alias("c")).agg(F.avg("value").alias("m"))
    base = F.least(F.greatest(F.coalesce("m", F.lit(0.5)), F.lit(BASE_FLOOR)), F.lit(1 - BASE_FLOOR))
    return claims.join(mean, F.col("claim") == F.col("c"), "left").select("claim", base.alias("base"))


def probabilistic_sum(value: Column) -> Column:
    """1 - product of (1 - v); a full energy makes it 1, where the logarithm has no value."""
    v = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return F.when(F.max(v) >= 1.0, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.when(v < 1.0, F.log1p(-v)).otherwise(F.lit(0.0)))))


def combine(base: Column, attack: Column, support: Column) -> Column:
    return F.when(support >= attack, base + (1 - base) * (support - attack)).otherwise(base - base * (attack - support))


def credences(claims: DataFrame, stances: DataFrame, edges: DataFrame, eps: float = 1e-9, most_laps: int = 1000) -> DataFrame:
    """claim, credence. edges: edge (a claim of its own), source, target, support (boolean).

    An edge's influence is its own credence times that of its source.
    """
    base = base_scores(claims, stances)
    start = base.select("claim", F.col("base").alias("credence"))

    def lap(now: DataFrame) -> DataFrame:
        own = now.select(F.col("claim").alias("ec"), F.col("credence").alias("e"))
        src = now.select(F.col("claim").alias("sc"), F.col("credence").alias("s"))
        flow = edges.join(own, F.col("edge") == F.col("ec")).join(src, F.col("source") == F.col("sc")).select(F.col("target").alias("t"), "support", (F.col("e") * F.col("s")).alias("v"))
        sums = flow.groupBy("t").agg(
            probabilistic_sum(F.when(~F.col("support"), F.col("v"))).alias("attack"),
            probabilistic_sum(F.when(F.col("support"), F.col("v"))).alias("help"),
        )
        none = F.lit(0.0)
        return base.join(sums, F.col("claim") == F.col("t"), "left").select("claim", combine(F.col("base"), F.coalesce("attack", none), F.coalesce("help", none)).alias("credence"))

    return fixpoint(start, lap, "claim", "credence", eps, most_laps)
