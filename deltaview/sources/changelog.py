"""Changelogs: rows of an element, its tag (src, ctr) and an operation, and the folds that give live state.

A tag names one write: ``src`` is the writer, ``ctr`` its own counter. Live is what was added and
whose tag was not deleted; merging changelogs is the union of their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAG = ["src", "ctr"]


def merge(*logs: DataFrame) -> DataFrame:
    """Merged changelog of replicas: equal rows count once, so an echo changes nothing."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.dropDuplicates()


def live(log: DataFrame, element: Sequence[str], op: str = "op") -> DataFrame:
    """Elements with a tag that was added and not deleted."""
    return live_tags(log, element, op).select(*element).distinct()


def live_tags(log: DataFrame, element: Sequence[str], op: str = "op") -> DataFrame:
    cols = [*element, *TAG]
    adds, dels = log.filter(F.col(op) == "add").select(*cols), log.filter(F.col(op) == "del").select(*cols)
    on = None
    for c in cols:
        one = F.col(f"a.{c}").eqNullSafe(F.col(f"d.{c}"))
        on = one if on is None else on & one
    return adds.alias("a").join(dels.alias("d"), on, "left_anti").select(*cols).distinct()


def set_commands_to_live(commands: DataFrame, element: Sequence[str], seq: str, src: str, removed: str) -> DataFrame:
    """Live elements of add and remove commands. A remove deletes what its own writer added before it.

    For each writer and element only the last remove matters, so this is one aggregate.
    """
    last = commands.groupBy(*element, src).agg(
        F.max(F.when(F.col(removed), F.col(seq))).alias("_gone"),
        F.max(F.when(~F.col(removed), F.col(seq))).alias("_added"),
    )
    return last.filter(F.col("_added").isNotNull() & (F.col("_gone").isNull() | (F.col("_added") > F.col("_gone")))).select(*element).distinct()


def remove_observed(log: DataFrame, element: Sequence[str], removed: DataFrame, op: str = "op") -> DataFrame:
    """The changelog with tombstones for every tag of the removed elements seen so far; later adds revive them."""
    on = None
    for c in element:
        one = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        on = one if on is None else on & one
    seen = log.filter(F.col(op) == "add").alias("l").join(removed.select(*element).distinct().alias("r"), on, "left_semi")
    return merge(log, seen.select(*element, *TAG).withColumn(op, F.lit("del")).select(*log.columns))


def latest(commands: DataFrame, key: Sequence[str], value: Sequence[str], seq: str, removed: str) -> DataFrame:
    """Last write of each key; keys whose last write is a removal are absent."""
    last = commands.groupBy(*key).agg(F.max_by(F.struct(*value, removed), F.col(seq)).alias("_last"))
    return last.filter(~F.col(f"_last.{removed}")).select(*key, *[F.col(f"_last.{v}").alias(v) for v in value])


def keyed_set(commands: DataFrame, key: Sequence[str], value: Sequence[str], seq: str, removed: str) -> DataFrame:
    """Elements of a set written by key: a later put replaces the key's element."""
    return latest(commands, key, value, seq, removed).select(*value).distinct()


def or_map(commands: DataFrame, key: Sequence[str], value: str, seq: str, src: str, removed: str) -> DataFrame:
    """Replicated map: a write or a removal supersedes the earlier dots of its own writer; of live dots the greatest (seq, src) is the value."""
    own = commands.groupBy(*key, src).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(removed).alias("r")), F.col(seq)).alias("_w"), F.max(seq).alias("_seq"))
    dots = own.filter(~F.col("_w.r"))
    return dots.groupBy(*key).agg(F.max_by(F.col("_w.v"), F.struct(F.col("_seq"), F.col(src))).alias(value))


def or_map_of_dots(puts: DataFrame, tombstones: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The general form: puts (key, value, src, ctr) without the tombstones (key, src, ctr)."""
    cols = [*key, *TAG]
    alive = puts.join(tombstones.select(*cols).distinct(), cols, "left_anti")
    return alive.groupBy(*key).agg(F.max_by(F.col(value), F.struct("ctr", "src")).alias(value))


def counter(amounts: DataFrame, amount: str, name: str = "total") -> DataFrame:
    return amounts.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias(name))


def pn_counter(totals: DataFrame, src: str, inc: str, dec: str, name: str = "total") -> DataFrame:
    """Replicated counter: cumulative totals of each writer, of which the greatest is current."""
    top = totals.groupBy(src).agg(F.max(inc).alias("_i"), F.max(dec).alias("_d"))
    return top.agg(F.coalesce(F.sum(F.col("_i") - F.col("_d")), F.lit(0)).cast("long").alias(name))


#: Positions of one writer that one window orders.
STRETCH = 1 << 16


def pn_totals(amounts: DataFrame, src: str, seq: str, amount: str) -> DataFrame:
    """Cumulative increments and decrements of each writer; a negative amount counts the other way.

    Sums run inside stretches of STRETCH positions and over the stretches' totals, so that a busy writer is spread.
    """
    rows = amounts.select(src, seq, F.floor(F.col(seq) / STRETCH).alias("_at"), F.greatest(F.col(amount), F.lit(0)).alias("_up"), F.greatest(-F.col(amount), F.lit(0)).alias("_down"))
    inside = W.partitionBy(src, "_at").orderBy(seq)
    before = W.partitionBy("_src").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(src).alias("_src"), F.col("_at").alias("_stretch")).agg(F.sum("_up").alias("_u"), F.sum("_down").alias("_d"))
    totals = totals.select("_src", "_stretch", F.coalesce(F.sum("_u").over(before), F.lit(0)).alias("_u"), F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d"))
    out = rows.withColumns({"_up": F.sum("_up").over(inside), "_down": F.sum("_down").over(inside)})
    out = out.join(totals, F.col(src).eqNullSafe(F.col("_src")) & (F.col("_at") == F.col("_stretch")))
    return out.select(src, seq, (F.col("_up") + F.col("_u")).alias("inc"), (F.col("_down") + F.col("_d")).alias("dec"))


def list_state(commands: DataFrame, list_id: str, seq: str, op: str, index: str, element: str) -> DataFrame:
    """Positional lists replayed in order: op is add, insert, set or remove; one row per place.

    Replay needs a list's whole history in order, so it runs group by group in pandas.
    """
    spark = commands.sparkSession
    from deltaview.session import ship

    ship(spark)
    kinds = dict(commands.dtypes)
    schema = f"{list_id} {kinds[list_id]}, position long, {element} {kinds[element]}"
    return commands.groupBy(list_id).applyInPandas(_replay(list_id, seq, op, index, element), schema)


def _replay(list_id: str, seq: str, op: str, index: str, element: str):
    def run(pdf):
        import pandas as pd

        items: list = []
        ordered = pdf.sort_values(seq)
        for what, at, value in zip(ordered[op].tolist(), ordered[index].tolist(), ordered[element].tolist(), strict=True):
            if what == "add":
                items.append(value)
            elif what == "insert":
                items.insert(int(at), value)
            elif what == "set":
                items[int(at)] = value
            elif what == "remove":
                items.pop(int(at))
            else:
                raise ValueError(f"unknown list operation {what}")
        return pd.DataFrame({list_id: [pdf[list_id].iloc[0]] * len(items), "position": range(len(items)), element: items})

    return run


def watermark(reports: DataFrame, keys: Sequence[str], through: str) -> DataFrame:
    """Furthest delivered position by replica and source."""
    return reports.groupBy(*keys).agg(F.max(through).alias(through))


def suspended(epochs: DataFrame, keys: Sequence[str], epoch: str) -> DataFrame:
    """Members whose greatest epoch is odd are suspended."""
    top = epochs.groupBy(*keys).agg(F.max(epoch).alias(epoch))
    return top.filter(F.pmod(F.col(epoch), F.lit(2)) == 1).select(*keys)


def delivered_prefix(tags: DataFrame, src: str = "src", ctr: str = "ctr") -> DataFrame:
    """Largest t of each writer with all of 1 .. t delivered; writers without counter 1 are absent.

    Whole stretches of STRETCH counters are only counted; the first one with a gap is looked into.
    """
    rows = tags.select(src, ctr).distinct().filter(F.col(ctr) >= 1).withColumn("_at", F.floor((F.col(ctr) - 1) / STRETCH))
    held = rows.groupBy(F.col(src).alias("_src"), F.col("_at").alias("_stretch")).agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(W.partitionBy("_src").orderBy("_stretch")) - 1
    # the stretches before the first one that is missing or not full
    lead = held.withColumn("_place", place).filter((F.col("_n") == STRETCH) & (F.col("_place") == F.col("_stretch"))).withColumn("_full", F.row_number().over(W.partitionBy("_src").orderBy("_stretch")) - 1)
    whole = lead.filter(F.col("_full") == F.col("_stretch")).groupBy("_src").agg((F.max("_stretch") + 1).alias("_whole"))
    left = rows.join(whole, F.col(src).eqNullSafe(F.col("_src")), "left").withColumn("_whole", F.coalesce("_whole", F.lit(0)))
    at = F.row_number().over(W.partitionBy(src, "_at").orderBy(ctr)) + F.col("_at") * STRETCH
    first = left.filter(F.col("_at") == F.col("_whole")).withColumn("_n", at).filter(F.col("_n") == F.col(ctr)).groupBy(src).agg(F.max(ctr).alias("through"))
    ended = whole.select(F.col("_src").alias(src), (F.col("_whole") * STRETCH).alias("through"))
    return first.unionByName(ended).groupBy(src).agg(F.max("through").alias("through"))


def frontier(tags: DataFrame) -> DataFrame:
    """Version vector: greatest counter of each writer, as a map."""
    top = tags.groupBy("src").agg(F.max("ctr").alias("ctr"))
    return top.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "ctr")))).alias("frontier"))


def since(log: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows beyond a frontier (src, ctr); writers that it lacks are wholly new."""
    known = seen.select(F.col("src").alias("_s"), F.col("ctr").alias("_c"))
    out = log.join(known, F.col("src") == F.col("_s"), "left")
    return out.filter(F.col("ctr") > F.coalesce("_c", F.lit(-1))).select(*log.columns)


def rebaseline(log: DataFrame, baseline: DataFrame, superseded: Sequence[str]) -> DataFrame:
    """After a restart: rows of superseded writers count only if the baseline asserts them again."""
    old = F.col("src").isin(list(superseded)) if superseded else F.lit(False)
    fresh = log.filter(~old)
    again = log.filter(old).join(baseline.select(*log.columns).distinct(), log.columns, "left_semi")
    return merge(fresh, again, baseline.select(*log.columns))


def newest_epoch(log: DataFrame, logical: str, epoch: str) -> DataFrame:
    """Single-writer replication: rows of the newest epoch of each logical id; older writers are fenced."""
    top = log.groupBy(logical).agg(F.max(epoch).alias("_top")).withColumnRenamed(logical, "_id")
    return log.join(top, (F.col(logical) == F.col("_id")) & (F.col(epoch) == F.col("_top")), "left_semi")


def merge_map_deltas(puts: DataFrame, removals: DataFrame, key: str, fold) -> DataFrame:
    """Aggregate map deltas: values of a key are folded, and a removal beats a put."""
    value = next(c for c in puts.columns if c != key)
    folded = puts.groupBy(key).agg(fold(F.col(value)).alias(value))
    gone = removals.select(F.col(key).alias("_gone")).distinct()
    return folded.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
