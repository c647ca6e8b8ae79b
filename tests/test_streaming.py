"""Random changelogs in random micro-batches: the incremental view equals the batch meaning."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.operators import aggregates as agg
from deltaview.operators import joins
from deltaview.sources.changelog import live
from deltaview.streaming import AlignedViews, BucketTable, EffectOnce, IncrementalView, Input, diff_maps, diff_sets, pages
from deltaview.streaming.aggregates import support_aggregate, weighted, weighted_aggregate
from tests.conftest import rows

ELEMENT = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
LOG = "input string, k string, v long, src string, ctr long, op string"


def random_log(seed, n=60):
    """Adds and observed removes on two inputs."""
    rng, out, alive, ctr = random.Random(seed), [], [], 0
    for _ in range(n):
        if alive and rng.random() < 0.35:
            e = alive.pop(rng.randrange(len(alive)))
            out.append((*e[:5], "del"))
        else:
            ctr += 1
            e = (rng.choice("ab"), rng.choice([None, "k1", "k2", "k3"]), rng.randrange(3), f"s{rng.randrange(2)}", ctr)
            alive.append(e)
            out.append((*e, "add"))
    return out


def operator(name):
    def join(left, right):
        return joins.join_set(left, right.select(F.col("k").alias("rk"), F.col("v").alias("w")), ["k"], ["rk"], ["k", "v", "w"])

    def anti(left, right):
        return joins.anti_join(left, right.select(F.col("k").alias("rk")), ["k"], ["rk"])

    def full(left, right):
        return joins.full_join(left, right.select(F.col("k").alias("rk"), F.col("v").alias("w")), ["k"], ["rk"], [F.coalesce("k", "rk").alias("k"), "v", "w"])

    return {"join": join, "anti": anti, "full": full}[name]


@pytest.mark.parametrize(("name", "seed"), [("join", 1), ("anti", 2), ("full", 3)])
def test_incremental_equals_batch(spark, tmp_path, name, seed):
    log = random_log(seed)
    view = IncrementalView(spark, str(tmp_path / "v"), [Input("a", ELEMENT, "k"), Input("b", ELEMENT, "k")], operator(name), buckets=4)
    rng, at, batch, state = random.Random(seed), 0, 0, set()
    while at < len(log):
        step = rng.randrange(10, 30)
        df = spark.createDataFrame(log[at : at + step], LOG)
        change = view.process(batch, {i: df.filter(F.col("input") == i).drop("input") for i in "ab"})
        for *row, op in change.collect():
            assert (tuple(row) in state) == (op == "del"), "only effective changes are told"
            (state.add if op == "add" else state.discard)(tuple(row))
        at, batch = at + step, batch + 1
    whole = spark.createDataFrame(log, LOG)
    want = rows(operator(name)(*[live(whole.filter(F.col("input") == i), ["k", "v"]) for i in "ab"]))
    assert state == want == rows(view.current())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    view = IncrementalView(spark, str(tmp_path / "v"), [Input("a", ELEMENT, "k"), Input("b", ELEMENT, "k")], operator("join"), buckets=2)
    df = spark.createDataFrame(random_log(5, 20), LOG)
    parts = {i: df.filter(F.col("input") == i).drop("input") for i in "ab"}
    first, again = rows(view.process(0, parts)), rows(view.process(0, parts))
    assert first == again
    told = []
    view.observe(lambda batch, change: told.append((batch, change.count())))
    assert told == [(0, view.current().count())]


def test_stream_of_files(spark, tmp_path):
    log = random_log(7, 40)
    for i in range(4):
        spark.createDataFrame(log[10 * i : 10 * i + 10], LOG).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    view = IncrementalView(spark, str(tmp_path / "v"), [Input("a", ELEMENT, "k"), Input("b", ELEMENT, "k")], operator("join"), buckets=2)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    view.start(stream, str(tmp_path / "cp")).awaitTermination()
    whole = spark.createDataFrame(log, LOG)
    assert rows(view.current()) == rows(operator("join")(*[live(whole.filter(F.col("input") == i), ["k", "v"]) for i in "ab"]))


def test_weighted_aggregates_take_retractions(spark):
    changes = spark.createDataFrame([("a", 3, "add"), ("a", 4, "add"), ("b", 5, "add"), ("a", 3, "del"), ("b", 5, "del")], "k string, v long, op string")
    got = rows(weighted_aggregate(weighted(changes), ["k"], agg.count(), agg.sum_of(F.col("v")), agg.avg_of(F.col("v"))))
    assert got == {("a", True, 1, 4, 4.0), ("b", False, None, None, None)}
    with pytest.raises(ValueError):
        weighted_aggregate(weighted(changes), ["k"], agg.max_of(F.col("v")))


def test_support_aggregate_stream(spark, tmp_path):
    batches = [[("a", 5, 1), ("a", 2, 1), ("b", 3, 1), ("b", 9, 1)], [("a", 5, -1), ("b", 9, 1)], [("a", 2, -1)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "k string, v long, w long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("k string, v long, w long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = {}

    def keep(df, batch):
        for r in df.collect():
            seen[r["k"]] = (r["live"], r["min"], r["max"], r["top"], r["count"])

    q = support_aggregate(stream, ["k"], "v", 2).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {"a": (False, None, None, [], 0), "b": (True, 3, 9, [9, 9], 3)}


def test_differences_pages_and_publication(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "k string, v double")
    new = spark.createDataFrame([("a", 1.0 + 1e-12), ("c", None), ("d", 4.0)], "k string, v double")
    assert rows(diff_maps(old, new, ["k"], "v", eps=1e-9)) == {("b", 2.0, None, True), ("d", None, 4.0, False)}
    assert diff_maps(old, old, ["k"], "v").count() == 0
    assert rows(diff_sets(old, new.filter("k <> 'a'"))) == {("a", 1.0, "del"), ("b", 2.0, "del"), ("d", 4.0, "add")}
    got = list(pages(spark.range(11), "id", limit=4))
    assert [[r[0] for r in p] for p in got] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]
    views = AlignedViews(spark, str(tmp_path / "av"), {"n": lambda d: d.groupBy().count(), "s": lambda d: d.agg(F.sum("id").alias("s"))})
    views.publish(0, spark.range(3))
    told = []
    views.observe(lambda b, v: told.append((b, v["n"].first()[0], v["s"].first()[0])))
    views.publish(1, spark.range(4))
    assert told == [(0, 3, 3), (1, 4, 6)]


def test_effects_happen_once_and_buckets_keep_versions(spark, tmp_path):
    calls = []
    e = EffectOnce(spark, str(tmp_path / "e"), lambda batch, df: calls.append(batch))
    for batch in (0, 0, 1):
        e(spark.range(1), batch)
    assert calls == [0, 1]
    t = BucketTable(spark, str(tmp_path / "t"), spark.range(1).schema, ("id",), 4)
    t.write(0, spark.range(10), {0, 1, 2, 3})
    touched = {r[0] for r in spark.range(1).select(t.bucket()).collect()}
    t.write(1, t.read(0, touched).filter("id <> 0"), touched)
    assert t.read().count() == 9 and t.read(0).count() == 10
