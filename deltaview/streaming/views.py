"""Incremental views over changelogs: each micro-batch recomputes the keys it touches.

Inputs are changelogs with retractions. Their tags are kept in bucketed tables; a batch folds its
rows in, takes the live elements of the touched keys before and after, applies the operator to both
and publishes the difference. Any operator whose result for a key depends on that key's elements
alone fits: joins, semi- and antijoins, outer combinations, lookups by foreign key, group-bys, quorums.
A key is touched where any input has a row of it. No watermark is set, as late rows count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from deltaview.sources.changelog import live
from deltaview.streaming.observe import diff_sets
from deltaview.streaming.state import BucketTable


class Input:
    """A named changelog input: its element columns and the column that is the key."""

    def __init__(self, name: str, schema: T.StructType, key: str):
        if key not in schema.names:
            raise ValueError(f"{name}: no column {key}")
        self.name, self.schema, self.key = name, schema, key

    def log_schema(self) -> T.StructType:
        tag = [T.StructField("src", T.StringType()), T.StructField("ctr", T.LongType()), T.StructField("op", T.StringType()), T.StructField("_key", T.StringType())]
        return T.StructType([*self.schema.fields, *tag])


class IncrementalView:
    def __init__(self, spark: SparkSession, path: str, inputs: Sequence[Input], operator: Callable[..., DataFrame], buckets: int = 16):
        self.spark, self.path, self.inputs, self.operator, self.buckets = spark, path, list(inputs), operator, buckets
        self.logs = {i.name: BucketTable(spark, f"{path}/log/{i.name}", i.log_schema(), ("_key",), buckets) for i in self.inputs}
        empty = operator(*[spark.createDataFrame([], i.schema) for i in self.inputs])
        self.result_schema = empty.schema
        self.listeners: list[Callable[[int, DataFrame], None]] = []

    def _keyed(self, i: Input, rows: DataFrame) -> DataFrame:
        # a null key is a key like any other
        return rows.withColumn("_key", F.coalesce(F.col(i.key).cast("string"), F.lit("\0null")))

    def process(self, batch: int, rows: dict[str, DataFrame]) -> DataFrame:
        """Fold one batch of changelog rows (element columns, src, ctr, op) in; returns the difference it makes."""
        keyed = {i.name: self._keyed(i, rows[i.name]).select(*i.log_schema().names).persist() for i in self.inputs if i.name in rows}
        touched_keys = None
        for df in keyed.values():
            k = df.select("_key").distinct()
            touched_keys = k if touched_keys is None else touched_keys.unionByName(k)
        touched_keys = touched_keys.distinct().persist()
        one = next(iter(self.logs.values()))
        touched = {r[0] for r in touched_keys.select(one.bucket()).distinct().collect()}  # at most ``buckets`` rows
        before, after = [], []
        for i in self.inputs:
            table = self.logs[i.name]
            old = table.read(table.before(batch), touched) if table.before(batch) is not None else self.spark.createDataFrame([], i.log_schema())
            new = old.unionByName(keyed[i.name]).dropDuplicates() if i.name in keyed else old
            table.write(batch, new, touched)
            new = table.read(batch, touched)
            pick = lambda df, i=i: live(df.join(touched_keys, "_key", "left_semi"), i.schema.names)
            before.append(pick(old))
            after.append(pick(new))
        change = diff_sets(self.operator(*before), self.operator(*after))
        change.write.mode("overwrite").parquet(f"{self.path}/changes/{batch}")
        for df in (*keyed.values(), touched_keys):
            df.unpersist()
        out = self.changes(batch)
        for listener in self.listeners:
            listener(batch, out)
        return out

    def changes(self, batch: int) -> DataFrame:
        schema = T.StructType([*self.result_schema.fields, T.StructField("op", T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/changes/{batch}")

    def current(self) -> DataFrame:
        """The view as of the newest batch, from the live elements of all inputs."""
        return self.operator(*[live(self.logs[i.name].read(), i.schema.names) for i in self.inputs])

    def observe(self, listener: Callable[[int, DataFrame], None]) -> None:
        """First the state as additions to nothing, then each batch's difference."""
        found = next(iter(self.logs.values())).versions()
        if found:
            listener(found[-1], self.current().withColumn("op", F.lit("add")))
        self.listeners.append(listener)

    def start(self, stream: DataFrame, checkpoint: str, input_col: str = "input", **trigger) -> StreamingQuery:
        """stream: changelog rows of all inputs with the input's name; columns that an input lacks are null."""

        def each(df: DataFrame, batch: int) -> None:
            rows = {i.name: df.filter(F.col(input_col) == i.name).select(*i.schema.names, "src", "ctr", "op") for i in self.inputs}
            self.process(batch, rows)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
