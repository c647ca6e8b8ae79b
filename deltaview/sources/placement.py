"""Who holds which keys: interest assignments, shard routing under epochs, and keyed families of cells.

Keys fall into slots; an assignment gives an instance an array of slots at an epoch. Data lies in
buckets by slot, so that moving a range is a change of the assignment and no rewrite of rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def assignments(reports: DataFrame) -> DataFrame:
    """reports: instance, epoch, slots. The newest epoch of each instance; reports of one epoch unite their slots.

    Order and repetition of reports do not matter, so replicas that gossip them agree.
    """
    united = reports.groupBy("instance", "epoch").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("slots")))).alias("slots"))
    return united.groupBy("instance").agg(F.max("epoch").alias("epoch"), F.max_by("slots", "epoch").alias("slots"))


def contested(table: DataFrame) -> DataFrame:
    """Slots that several instances hold, and how many; none where the assignment is disjoint."""
    held = table.select("instance", F.explode("slots").alias("slot")).distinct()
    return held.groupBy("slot").agg(F.count(F.lit(1)).alias("instances")).filter("instances > 1")


def route(rows: DataFrame, slot: Column, table: DataFrame) -> DataFrame:
    """rows with the instances that hold their slot and the epoch of that assignment; unheld slots go nowhere."""
    held = table.select(F.col("instance"), F.col("epoch"), F.explode("slots").alias("_slot"))
    return rows.join(held, slot == F.col("_slot")).drop("_slot")


def admitted(routed: DataFrame, slot: Column, table: DataFrame) -> DataFrame:
    """What instances keep of routed rows (instance, epoch, ..): only slots that they hold now, whatever epoch routed them.

    So rows routed before a repartition neither get lost (the new owner is sent the state) nor count twice.
    """
    held = table.select(F.col("instance").alias("_instance"), F.explode("slots").alias("_slot"))
    kept = routed.join(held, (F.col("instance") == F.col("_instance")) & (slot == F.col("_slot")), "left_semi")
    return kept.drop("epoch").distinct()


def moving(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slots whose instance changes: slot, old_instance, new_instance (null: nobody)."""
    a = old.select(F.explode("slots").alias("_a"), F.col("instance").alias("old_instance"))
    b = new.select(F.explode("slots").alias("_b"), F.col("instance").alias("new_instance"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    return both.filter(~F.col("old_instance").eqNullSafe(F.col("new_instance"))).select(F.coalesce("_a", "_b").alias("slot"), "old_instance", "new_instance")


class KeyedCells:
    """A family of changelogs by key. A key's folder is made on first touch and found again after a restart.

    The key is logged before its first row is written, so recovery knows every key whose rows it may meet;
    writing a batch again replaces it.
    """

    def __init__(self, spark: SparkSession, path: str, namespace: str, schema: str):
        self.spark, self.path, self.namespace, self.schema = spark, path, namespace, schema

    def ref(self, key: str) -> str:
        """The same for every session."""
        return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{self.namespace}:{key}"))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def get_or_spawn(self, key: str) -> str:
        """The folder of a key. Spawning twice, or in two sessions, gives one cell."""
        ref = self.ref(key)
        fs, p = self._fs(f"{self.path}/keys/{ref}.json")
        if not fs.exists(p):
            out = fs.create(p, True)
            out.write(bytearray(json.dumps({"key": key}).encode()))
            out.close()
        return f"{self.path}/cells/{ref}"

    def keys(self) -> set[str]:
        fs, p = self._fs(f"{self.path}/keys")
        if not fs.exists(p):
            return set()
        return {json.loads(r["value"])["key"] for r in self.spark.read.text(f"{self.path}/keys", wholetext=True).collect()}  # one short row a key

    def write(self, key: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.get_or_spawn(key)}/batch={batch}")

    def read(self, key: str) -> DataFrame:
        cell = self.get_or_spawn(key)
        fs, p = self._fs(cell)
        return self.spark.read.schema(self.schema).parquet(cell).drop("batch") if fs.exists(p) else self.spark.createDataFrame([], self.schema)
