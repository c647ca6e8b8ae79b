"""Reading views: effective differences, aligned publication, pages and effects that happen once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.streaming.state import BucketTable


def diff_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed rows with op add or del; equal rows are silent."""
    cols = new.columns
    adds = new.subtract(old.select(*cols)).withColumn("op", F.lit("add"))
    return adds.unionByName(old.select(*cols).subtract(new).withColumn("op", F.lit("del")))


def diff_maps(old: DataFrame, new: DataFrame, key: Sequence[str], value: str, eps: float | None = None) -> DataFrame:
    """key, old, new of keys that appear, disappear or change; by more than eps where it is given."""
    a = old.select(*[F.col(k).alias(f"_a_{k}") for k in key], F.col(value).alias("old"), F.lit(True).alias("_had"))
    b = new.select(*[F.col(k).alias(f"_b_{k}") for k in key], F.col(value).alias("new"), F.lit(True).alias("_has"))
    on = None
    for k in key:
        one = F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}"))
        on = one if on is None else on & one
    same = F.col("old").eqNullSafe(F.col("new"))
    if eps is not None:
        same = same | F.coalesce(F.abs(F.col("new") - F.col("old")) <= F.lit(eps), F.lit(False))
    changed = ~(F.col("_had").eqNullSafe(F.col("_has")) & same)
    keys = [F.when(F.col("_has"), F.col(f"_b_{k}")).otherwise(F.col(f"_a_{k}")).alias(k) for k in key]
    return a.join(b, on, "full").filter(changed).select(*keys, "old", "new", F.col("_has").isNull().alias("removed"))


def _at_or_after(df: DataFrame, order: Sequence[str], row: Sequence) -> Column:
    """Rows that do not come before ``row`` in the order, nulls first."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.struct(*[F.col(f"`{c}`") for c in order]) >= F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, row, strict=True)])


def page(df: DataFrame, key: str, after: tuple[Sequence, int] | None = None, limit: int = 200) -> list:
    """The next rows in the order of the key and then of all other columns, nulls first.

    after: the last row of the page before and how many rows equal to it were given up to there.
    """
    order = [key, *(c for c in df.columns if c != key)]
    skip = 0
    if after is not None:
        row, skip = after
        last = dict(zip(df.columns, row, strict=True))
        df = df.filter(_at_or_after(df, order, [last[c] for c in order]))
        if last[key] is not None:
            df = df.filter(F.col(f"`{key}`") >= F.lit(last[key]))  # scans can use this one
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).limit(limit + skip).collect()[skip:]


def pages(df: DataFrame, key: str, limit: int = 200, byte_budget: int = 50_000) -> Iterator[list]:
    """All rows page by page: the pages together are the table, repeated rows and null keys included.

    A page ends at the row limit or the byte budget, but holds one row at least.
    """
    after = None
    while True:
        rows = page(df, key, after, limit)
        if not rows:
            return
        size, keep = 0, 0
        for r in rows:
            size += len(str(r))
            if keep and size > byte_budget:
                break
            keep += 1
        last = rows[keep - 1]
        equal = sum(r == last for r in rows[:keep])
        if after is not None and tuple(after[0]) == tuple(last):
            equal += after[1]
        after = (tuple(last), equal)
        yield rows[:keep]


class AlignedViews:
    """Several views published together: a reader sees all of them as of one batch."""

    def __init__(self, spark: SparkSession, path: str, views: dict[str, Callable[[DataFrame], DataFrame]]):
        self.spark, self.path, self.views = spark, path, views
        self.listeners: list[Callable[[int, dict[str, DataFrame]], None]] = []

    def publish(self, batch: int, base: DataFrame) -> None:
        for name, f in self.views.items():
            f(base).write.mode("overwrite").parquet(f"{self.path}/{batch}/{name}")
        # the marker makes the batch visible, after all views are whole
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/published/{batch}")
        for listener in self.listeners:
            listener(batch, self.read(batch))

    def newest(self) -> int | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/published")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        done = [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()]
        return max(done, default=None)

    def read(self, batch: int | None = None) -> dict[str, DataFrame]:
        at = self.newest() if batch is None else batch
        return {} if at is None else {name: self.spark.read.parquet(f"{self.path}/{at}/{name}") for name in self.views}

    def observe(self, listener: Callable[[int, dict[str, DataFrame]], None]) -> None:
        """Calls the listener with what is published now, and with each later batch."""
        self.listeners.append(listener)
        if (now := self.newest()) is not None:
            listener(now, self.read(now))


class EffectOnce:
    """An effect that never happens twice for a batch, replays included.

    The batch is journaled before the effect and its end after it. A batch that was begun and not ended,
    because the driver died between the two, is not repeated: it may have acted. ``in_doubt`` names such
    batches, and ``settle`` ends them once the outside world was asked; the batch id given to the effect
    can serve it as a key to ask by.
    """

    def __init__(self, spark: SparkSession, path: str, effect: Callable[[int, DataFrame], None]):
        self.spark, self.effect = spark, effect
        schema = spark.createDataFrame([], "batch long").schema
        self.begun, self.ended = (BucketTable(spark, f"{path}/{name}", schema, ("batch",), 1) for name in ("begun", "ended"))

    def _note(self, table: BucketTable, batch: int) -> None:
        table.write(batch, self.spark.createDataFrame([(batch,)], "batch long"), {0})

    def in_doubt(self) -> list[int]:
        return sorted(set(self.begun.versions()) - set(self.ended.versions()))

    def settle(self, batch: int) -> None:
        self._note(self.ended, batch)

    def __call__(self, batch_df: DataFrame, batch: int) -> None:
        if batch in self.begun.versions():
            return
        self._note(self.begun, batch)
        self.effect(batch, batch_df)
        self._note(self.ended, batch)
