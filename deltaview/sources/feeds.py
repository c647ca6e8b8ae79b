"""Feeds from outside: change-data rows, JSON lines, tables and text formats, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt}: one of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt}: one of {', '.join(FORMATS)}")
    df.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def read_export(spark: SparkSession, path: str, schema: T.StructType | str, required: str = "id") -> tuple[DataFrame, DataFrame]:
    """JSON lines with a fixed schema: (good rows, bad lines). A line that is no JSON or lacks the required field is bad, not lost."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | F.col(f"r.{required}").isNull()
    return parsed.filter(~bad).select(*[f"r.{f.name}" for f in kind.fields]), parsed.filter(bad & (F.trim("value") != "")).select("value")


def change_feed(rows: DataFrame) -> DataFrame:
    """Change rows (commit_height, ordinal, key, column, old, new, diff_type) as field commands in order.

    Result: key, field, value, seq, removed. A removed row removes each of its fields.
    """
    seq = F.struct(F.col("commit_height"), F.col("ordinal"))
    return rows.select("key", F.col("column").alias("field"), F.col("new").alias("value"), seq.alias("seq"), ((F.col("diff_type") == "removed") | F.col("new").isNull()).alias("removed"))


def mirror(commands: DataFrame) -> DataFrame:
    """Current fields of each key: key, field, value."""
    last = commands.groupBy("key", "field").agg(F.max_by(F.struct("value", "removed"), F.col("seq")).alias("l"))
    return last.filter(~F.col("l.removed")).select("key", "field", F.col("l.value").alias("value"))


def field_changes(commands: DataFrame) -> DataFrame:
    """Each command with the value it replaces; commands that change nothing are left out."""
    w = W.partitionBy("key", "field").orderBy("seq")
    old = F.lag(F.when(~F.col("removed"), F.col("value"))).over(w)
    new = F.when(~F.col("removed"), F.col("value"))
    return commands.withColumn("old", old).withColumn("new", new).filter(~F.col("old").eqNullSafe(F.col("new"))).select("key", "field", "old", "new", "seq")


def dead_letters(df: DataFrame, good) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy ``good``, the others): bad records are kept beside, not dropped."""
    ok = F.coalesce(good, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def disclosed(df: DataFrame, policy: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """What a boundary shows: full, project (the named columns) or deny (no rows)."""
    if policy == "full":
        return df
    if policy == "project":
        return df.select(*columns)
    if policy == "deny":
        return df.filter(F.lit(False))
    raise ValueError(f"policy {policy}")
