"""Bucketed state tables with versions: a batch rewrites the buckets it touches and no other.

A version is a small manifest of (bucket, batch that wrote it); buckets are folders of Parquet
files. Writing a batch again gives the same version, so a retried micro-batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: tuple[str, ...], buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit() and self._exists(f"{self.path}/manifest/{n}/_SUCCESS"))

    def manifest(self, version: int) -> dict[int, int]:
        """At most ``buckets`` rows."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{version}").collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """Rows of a version (the newest by default), of some buckets or all."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else None
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{batch}/bucket={b}" for b, batch in self.manifest(version).items() if only is None or b in only]
        paths = [p for p in paths if self._exists(p)]  # a bucket may have become empty
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def before(self, batch: int) -> int | None:
        older = [v for v in self.versions() if v < batch]
        return older[-1] if older else None

    def write(self, batch: int, rows: DataFrame, touched: set[int]) -> None:
        """New rows of the touched buckets; the others keep their files."""
        rows.select(*self.schema.names).withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch}")
        last = self.before(batch)
        entries = (self.manifest(last) if last is not None else {}) | dict.fromkeys(touched, batch)
        self.spark.createDataFrame(sorted(entries.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")
