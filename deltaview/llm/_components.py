"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaview.llm._store import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns node, component (the smallest node of its component) for every node of an edge.

    Each round is written to the shared folder; the largest state is the list of edges.
    """
    # u > v throughout
    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark = _mark(now)
    for turn in range(1, most_rounds + 1):
        if mark[0] == 0:
            break
        # large star: the larger neighbours of a node move to its smallest neighbour (or itself)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), f"{name}-a{turn}")
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.filter("u <> v").distinct(), f"{name}-b{turn}")
        # small star: the smaller neighbours of a node and itself move to the smallest
        least = scratch.save(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), f"{name}-c{turn}")
        moved = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = scratch.save(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-a{turn}", f"{name}-b{turn}", f"{name}-c{turn}")
        now, last, mark = small, mark, _mark(small)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
