"""Decisions on rows, brought back to the rows without moving the texts of all others.

A row is known by its id (null is an id of its own) and the 64-bit hash of its text. What is asked
for or dropped is first tested against a bitmap of FILTER_BITS bits, whose size does not grow with
the data; only rows that hit it meet the exact join. The fuller the bitmap, the more rows do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MB; broadcast as 1024 rows of a bitmap each.
FILTER_BITS = 1 << 25
_WIDTH = 32768


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that clash with a column (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """Names a text; null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def marked(rows: DataFrame, key: list[Column], wanted: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """rows with ``flag``: false for certain where wanted (its columns in the order of key) lacks the key."""
    hash_of = lambda cols: F.pmod(F.xxhash64(F.lit(bits), *cols), F.lit(bits))
    place, bucket, bitmap = fresh(rows.columns + [flag], "bit_place", "bit_bucket", "bit_map")
    held = wanted.select(hash_of([F.col(f"`{c}`") for c in wanted.columns]).alias("h"))
    held = held.groupBy((F.col("h") / _WIDTH).cast("int").alias(bucket)).agg(F.expr(f"bitmap_construct_agg(h % {_WIDTH})").alias(bitmap))
    out = rows.withColumn(place, hash_of(key))
    # bits / _WIDTH rows of 4 KB at most
    out = out.join(F.broadcast(held), (F.col(place) / _WIDTH).cast("int") == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor((F.col(place) % _WIDTH) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1, F.lit(False))
    return out.withColumn(flag, hit).select(*[F.col(f"`{c}`") for c in rows.columns], flag)


def fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows: id, key, text. wanted: node, id, key. One text for each node, as node and text."""
    asked = wanted.select("node", F.col("id").alias("want_id"), F.col("key").alias("want_key"))
    near = marked(rows, [F.col("id"), F.col("key")], asked.select("want_id", "want_key"), "hit").filter("hit")
    # repeated rows: one of each leaves its task
    one = near.groupBy("id", "key").agg(F.first("text").alias("text"))
    return one.join(asked, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("key") == F.col("want_key"))).select("node", "text")


def without_texts(docs: DataFrame, drop: DataFrame, text_col: str) -> DataFrame:
    """docs without the rows whose text's key is in drop (key)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, hit, gone = fresh(docs.columns, "own_key", "hit", "gone_key")
    tested = marked(docs.withColumn(key, text_key(F.col(f"`{text_col}`"))), [F.col(key)], drop.select("key"), hit)
    left = tested.filter(F.col(hit)).join(drop.select(F.col("key").alias(gone)), F.col(key) == F.col(gone), "left_anti")
    return tested.filter(~F.col(hit)).select(*columns).unionByName(left.select(*columns))


def without(docs: DataFrame, drop: DataFrame, id_col: str, text_col: str, again: DataFrame | None = None) -> DataFrame:
    """docs without the rows in drop (id, key); of each repeated row in again (id, key) one stays."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, hit, gone_id, gone_key = fresh(docs.columns, "own_key", "hit", "gone_id", "gone_key")
    own = [F.col(f"`{id_col}`"), F.col(key)]
    same = own[0].eqNullSafe(F.col(gone_id)) & (own[1] == F.col(gone_key))
    names = lambda df: df.select(F.col("id").alias(gone_id), F.col("key").alias(gone_key))
    wanted = names(drop) if again is None else names(drop).unionByName(names(again))
    tested = marked(docs.withColumn(key, text_key(F.col(f"`{text_col}`"))), own, wanted, hit)
    out = tested.filter(~F.col(hit)).select(*columns)
    left = tested.filter(F.col(hit)).join(names(drop), same, "left_anti")
    if again is None:
        return out.unionByName(left.select(*columns))
    once = left.join(names(again), same, "left_anti").select(*columns)
    one = left.join(names(again), same, "left_semi").dropDuplicates([id_col, key]).select(*columns)
    return out.unionByName(once).unionByName(one)
