"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from deltaview.session import ship

#: Bytes of a batch of rows on its way to a Python worker (Spark's own limit is 64 MB or 10000 rows, often a whole task): executor and worker hold some of them at once.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_LOCAL: str | None = None
_ROOTS: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may do without: there all tasks share this machine."""
    global _LOCAL
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="deltaview-")
        atexit.register(shutil.rmtree, _LOCAL, ignore_errors=True)
    return "file://" + _LOCAL


@atexit.register
def _clean() -> None:
    """Results are read lazily, so tables of an application go when it ends."""
    for spark, root in _ROOTS:
        with contextlib.suppress(Exception):  # the JVM may be gone
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


_HELD: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks. A worker serves one operator at a time, so those of others go, and their memory before the owner takes its own."""
    if gone := [k for k in _HELD if k != owner]:
        for name in gone:
            _HELD.pop(name).clear()
        give_back()
    return _HELD.setdefault(owner, {})


def give_back() -> None:
    """Memory that the process holds and does not use goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable, owner: str = "") -> Callable:
    """A function for mapInArrow that starts without what operators but the owner left in the worker and gives memory back after each batch and at the end."""

    def between(batches):
        for batch in batches:
            yield batch
            del batch
            give_back()

    def wrapped(batches):
        worker_cache(owner)
        yield from run(between(batches))
        give_back()

    return wrapped


class Scratch:
    """Named Parquet tables of one run. A table survives the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        if spark.conf.get(BATCH_KEY, None) is None:
            spark.conf.set(BATCH_KEY, BATCH_BYTES)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
