"""Streaming aggregates over weighted rows: w is +1 for an added element and -1 for a retracted one.

Invertible aggregates are ordinary streaming sums of weights. Others (min, max, top k, collect) keep
their whole support as a multiset in the state store, because a bounded top k cannot take a
retraction. State is bounded by the live support of a group, as in the batch meaning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from deltaview.operators.aggregates import Aggregator
from deltaview.session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def weighted(changes: DataFrame, op: str = "op") -> DataFrame:
    """Changelog of effective changes (add, del) as weights."""
    return changes.withColumn("w", F.when(F.col(op) == "add", F.lit(1)).otherwise(F.lit(-1)).cast("long")).drop(op)


def weighted_aggregate(rows: DataFrame, key: Sequence[str], *aggregators: Aggregator) -> DataFrame:
    """Grouped aggregate of weighted rows, batch or stream; ``live`` is false for groups that died."""
    for a in aggregators:
        if not a.invertible:
            raise ValueError(f"{a.name} keeps its support: use support_aggregate")
    out = rows.groupBy(*key).agg(F.sum("w").alias("_n"), *[a.weighted(F.col("w")).alias(f"_{a.name}") for a in aggregators])
    # a dead group has no value; dividing by its zero weight is never evaluated
    alive = F.col("_n") > 0
    return out.select(*key, alive.alias("live"), *[F.when(alive, F.col(f"_{a.name}")).alias(a.name) for a in aggregators])


class _Support(StatefulProcessor):
    """Multiset of values in a map state; every batch yields the group's min, max, top k and size."""

    def __init__(self, key_schema: T.StructType, k: int):
        self.key_schema, self.k = key_schema, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("support", T.StructType([T.StructField("v", T.LongType())]), T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        for pdf in rows:
            for v, w in pdf.groupby("v")["w"].sum().items():
                old = self.counts.getValue((int(v),)) if self.counts.containsKey((int(v),)) else None
                n = (old[0] if old else 0) + int(w)
                if n == 0:
                    self.counts.removeKey((int(v),))
                else:
                    self.counts.updateValue((int(v),), (n,))
        held = sorted(((k[0], n[0]) for k, n in self.counts.iterator()), reverse=True)
        top: list[int] = []
        for v, n in held:
            top += [v] * min(n, self.k - len(top))
            if len(top) >= self.k:
                break
        size = sum(n for _, n in held)
        out = {f.name: [x] for f, x in zip(self.key_schema.fields, key, strict=True)}
        out |= {"live": [size > 0], "min": [held[-1][0] if held else None], "max": [held[0][0] if held else None], "top": [top], "count": [size]}
        yield pd.DataFrame(out).astype({"min": "Int64", "max": "Int64"})

    def close(self) -> None:
        pass


def support_aggregate(stream: DataFrame, key: Sequence[str], value: str, k: int = 3) -> DataFrame:
    """Streaming min, max, top k and count of a long value under retractions: key, live, min, max, top, count.

    Needs the RocksDB state store (ROCKSDB in spark.sql.streaming.stateStore.providerClass) and update mode.
    """
    ship(stream.sparkSession)
    rows = stream.select(*key, F.col(value).cast("long").alias("v"), "w")
    keys = T.StructType([f for f in rows.schema.fields if f.name in key])
    out = T.StructType([*keys.fields, T.StructField("live", T.BooleanType()), T.StructField("min", T.LongType()), T.StructField("max", T.LongType()), T.StructField("top", T.ArrayType(T.LongType())), T.StructField("count", T.LongType())])
    return rows.groupBy(*key).transformWithStateInPandas(_Support(keys, k), outputStructType=out, outputMode="Update", timeMode="None")
