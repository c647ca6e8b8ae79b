"""Gates and bounds at an intake: lights that hold rows back, saturation with hysteresis, taps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def traffic_light(rows: DataFrame, lights: DataFrame, port: str, seq: str) -> DataFrame:
    """rows with ``released``: the position at which they pass; null while the light stays red.

    lights: port, seq, green. A port starts red; while it is red rows wait in order and pass at the next
    green; a light acts before the rows of its own position.
    """
    cols = rows.columns
    marks = lights.select(F.col(port).alias("_port"), F.col(seq).alias("_seq"), F.lit(0).alias("_turn"), F.col("green").alias("_green"), F.lit(None).cast(rows.select(F.struct(*cols)).schema[0].dataType).alias("_row"))
    data = rows.select(F.col(port).alias("_port"), F.col(seq).alias("_seq"), F.lit(1).alias("_turn"), F.lit(None).cast("boolean").alias("_green"), F.struct(*cols).alias("_row"))
    # both frames grow from a port's one end, so that each row is read once; one that shrinks is summed anew for each row
    port_rows = W.partitionBy("_port")
    so_far = port_rows.orderBy(F.asc_nulls_last("_seq"), "_turn").rowsBetween(W.unboundedPreceding, 0)
    from_here = port_rows.orderBy(F.desc_nulls_first("_seq"), F.desc("_turn")).rowsBetween(W.unboundedPreceding, 0)
    now = F.coalesce(F.last("_green", ignorenulls=True).over(so_far), F.lit(False))
    following = F.min(F.when(F.col("_green"), F.col("_seq"))).over(from_here)
    both = marks.unionByName(data).withColumn("_open", now).withColumn("_next", following)
    return both.filter("_turn = 1").select("_row.*", F.when(F.col("_open"), F.col("_seq")).otherwise(F.col("_next")).alias("released"))


def saturation(depths: DataFrame, key: Sequence[str], seq: str, depth: Column, high: int, low: int) -> DataFrame:
    """depths with ``saturated``: set when the depth reaches ``high``, cleared when it falls to ``low``, kept between."""
    if not 0 <= low < high:
        raise ValueError("low lies in [0, high)")
    turn = F.when(depth >= high, F.lit(True)).when(depth <= low, F.lit(False))
    order = W.partitionBy(*key).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return depths.withColumn("saturated", F.coalesce(F.last(turn, ignorenulls=True).over(order), F.lit(False)))


def bounded_intake(reader, path: str, files: int, **options) -> DataFrame:
    """A file stream that takes so many files a batch at most; what is beyond waits in the folder."""
    return reader.options(**options).option("maxFilesPerTrigger", files).load(path)


def tap(df: DataFrame, name: str, *metrics: Column):
    """(df, its metrics): an observer that reads what passes and never holds it."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *metrics), seen


def stream_to(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Forward each batch of a stream to a sink."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
