"""Waves, placement, intake gates, pages and effects."""

import pytest
from pyspark.sql import functions as F

from deltaview.operators import waves
from deltaview.plans.graph import GraphBuilder
from deltaview.sources import placement
from deltaview.streaming import EffectOnce, intake, pages
from tests.conftest import rows


def progress(spark, *arms):
    return spark.createDataFrame(list(arms), "arm string, through long, state string")


def test_wait_holds_for_stalled_arms_and_degrade_does_not(spark):
    p = progress(spark, ("a", 7, "live"), ("b", 3, "stalled"), ("c", 1, "ended"))
    assert waves.settled(p).first()[0] == 3 and waves.settled(p, waves.DEGRADE).first()[0] == 7
    data = spark.createDataFrame([(i,) for i in range(1, 9)], "w long")
    assert waves.released(data, "w", waves.settled(p)).count() == 3
    # after the stall the held waves come late, and only they
    assert rows(waves.late(data, "w", waves.settled(p), waves.settled(p, waves.DEGRADE))) == {(4,), (5,), (6,), (7,)}
    assert waves.settled(progress(spark, ("a", None, "live"), ("b", 3, "live"))).first()[0] < 0, "an arm without a delivery holds all"
    assert waves.settled(progress(spark, ("a", 1, "ended"))).first()[0] > 1 << 60, "terminal stalls hold nothing"
    with pytest.raises(ValueError):
        waves.settled(p, "soon")


def test_semi_join_shows_whole_waves(spark):
    left = spark.createDataFrame([("x", 1), ("y", 1), ("x", 5)], "k string, w long")
    right = spark.createDataFrame([("x", 2), ("y", 4)], "k2 string, w long")
    at = lambda n: waves.semi_join_on_frontier(left, right, ["k"], ["k2"], "w", progress(spark, ("a", n, "live")).select(F.col("through").alias("frontier")))
    assert rows(at(1)) == set() and rows(at(2)) == {("x", 1)} and rows(at(4)) == {("x", 1), ("y", 1)} and rows(at(5)) == {("x", 1), ("y", 1), ("x", 5)}


def test_quorum_of_covering_members(spark):
    members = spark.createDataFrame([("a", [0, 1], "live"), ("b", [0], "live"), ("c", [0], "ended"), ("d", [2], "live")], "member string, slots array<long>, state string")
    reports = spark.createDataFrame([("a", "s", 9), ("a", "s", 4), ("b", "s", 6), ("a", "t", 2)], "member string, source string, through long")
    assert rows(waves.quorum(members, reports)) == {(0, "s", 6), (1, "s", 9), (1, "t", 2)}, "b never reported t: slot 0 waits; d nothing at all"
    assert rows(waves.quorum(members, reports, fence=False)) == {(0, "s", 6), (0, "t", 2), (1, "s", 9), (1, "t", 2)}
    data = spark.createDataFrame([(0, "s", 6), (0, "s", 7), (0, "t", 1), (1, "t", 2), (2, "s", 1)], "slot long, source string, w long")
    assert rows(waves.quorum_released(data, F.col("slot"), "source", "w", waves.quorum(members, reports))) == {(0, "s", 6), (1, "t", 2)}


TABLE = "instance string, epoch long, slots array<long>"


def test_assignments_agree_in_any_order(spark):
    told = [("a", 1, [0, 1]), ("b", 1, [2]), ("a", 2, [1]), ("a", 2, [3]), ("b", 0, [0])]
    want = {("a", 2, (1, 3)), ("b", 1, (2,))}
    for order in (told, told[::-1], told + told):
        got = placement.assignments(spark.createDataFrame(order, TABLE))
        assert {(r[0], r[1], tuple(r[2])) for r in got.collect()} == want
    assert placement.contested(got).count() == 0
    assert rows(placement.contested(spark.createDataFrame([("a", 1, [0, 1]), ("b", 1, [1])], TABLE))) == {(1, 2)}


def test_repartition_loses_and_doubles_nothing(spark):
    old = spark.createDataFrame([("a", 1, [0, 1]), ("b", 1, [2, 3])], TABLE)
    new = spark.createDataFrame([("a", 2, [0]), ("b", 2, [1, 2, 3])], TABLE)
    data = spark.range(40)
    slot = F.pmod("id", F.lit(4))
    in_flight = placement.route(data.filter("id < 20"), slot, old)
    replay = placement.route(data, slot, new)
    kept = placement.admitted(in_flight.unionByName(replay), slot, new)
    assert kept.count() == 40 and kept.select("id").distinct().count() == 40
    assert rows(placement.moving(old, new)) == {(1, "a", "b")}


def test_keyed_cells_are_found_again(spark, tmp_path):
    family = placement.KeyedCells(spark, str(tmp_path), "users", "v long")
    assert family.keys() == set() and family.read("x").count() == 0
    assert family.get_or_spawn("x") == family.get_or_spawn("x")
    family.write("x", 0, spark.createDataFrame([(1,)], "v long"))
    family.write("y/é", 0, spark.createDataFrame([(2,)], "v long"))
    again = placement.KeyedCells(spark, str(tmp_path), "users", "v long")
    again.write("x", 0, spark.createDataFrame([(1,)], "v long"))  # a replay
    again.write("x", 1, spark.createDataFrame([(3,)], "v long"))
    assert again.keys() == {"x", "y/é"} and rows(again.read("x")) == {(1,), (3,)} and rows(again.read("y/é")) == {(2,)}


def test_traffic_light_parks_in_order(spark):
    data = spark.createDataFrame([("p", i) for i in range(1, 9)] + [("q", 1)], "port string, seq long")
    lights = spark.createDataFrame([("p", 3, True), ("p", 5, False), ("p", 7, True)], "port string, seq long, green boolean")
    got = {(r["port"], r["seq"]): r["released"] for r in intake.traffic_light(data, lights, "port", "seq").collect()}
    assert got == {("p", 1): 3, ("p", 2): 3, ("p", 3): 3, ("p", 4): 4, ("p", 5): 7, ("p", 6): 7, ("p", 7): 7, ("p", 8): 8, ("q", 1): None}


def test_traffic_light_reads_rows_once(spark):
    """No frame that ends with its port: each row would cost what follows it."""
    data = spark.range(60000).select(F.lit("p").alias("port"), F.col("id").alias("seq"))
    lights = spark.createDataFrame([("p", 59999, True), ("p", None, True)], "port string, seq long, green boolean")
    out = intake.traffic_light(data, lights, "port", "seq")
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert out.groupBy("released").count().collect() == [(59999, 60000)], "a light without a place acts after all others"


def test_saturation_has_hysteresis(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate([1, 5, 9, 6, 4, 2, 6, 9])], "seq long, depth long")
    got = [r["saturated"] for r in intake.saturation(d, [], "seq", F.col("depth"), 9, 2).orderBy("seq").collect()]
    assert got == [False, False, True, True, True, False, False, True]
    with pytest.raises(ValueError):
        intake.saturation(d, [], "seq", F.col("depth"), 2, 2)


def test_tap_and_stream_to(spark, tmp_path):
    df, seen = intake.tap(spark.range(5), "t", F.count(F.lit(1)).alias("n"))
    assert df.count() == 5 and seen.get == {"n": 5}
    for i in range(3):
        spark.range(i, i + 1).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    batches = []
    stream = intake.bounded_intake(spark.readStream.format("parquet").schema("id long"), str(tmp_path / "in"), 1, recursiveFileLookup="true")
    intake.stream_to(stream, lambda df, b: batches.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(batches) == 3 and max(batches) == 1, "one file a batch"


def test_pages_are_the_whole_table(spark):
    data = [(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "d"), (2, "d"), (None, "e"), (None, None), (3, None)]
    d = spark.createDataFrame(data, "k long, v string")
    for limit in (1, 2, 4, 100):
        got = [tuple(r) for p in pages(d, "k", limit=limit) for r in p]
        assert sorted(got, key=str) == sorted(data, key=str), limit
    assert [len(p) for p in pages(d, "k", limit=2)] == [2, 2, 2, 2, 1]
    assert all(len(p) == 1 for p in pages(d, "k", byte_budget=1))


def test_effects_do_not_repeat_after_a_crash(spark, tmp_path):
    calls = []

    def dies(batch, df):
        calls.append(batch)
        if batch == 1:
            raise RuntimeError("the driver died after the effect")

    e = EffectOnce(spark, str(tmp_path), dies)
    e(spark.range(1), 0)
    with pytest.raises(RuntimeError):
        e(spark.range(1), 1)
    again = EffectOnce(spark, str(tmp_path), dies)
    for batch in (0, 1):
        again(spark.range(1), batch)
    assert calls == [0, 1] and again.in_doubt() == [1]
    again.settle(1)
    assert again.in_doubt() == []


def test_inspector_shows_nodes(spark):
    g = GraphBuilder()
    a = g.source("a")
    g.node("b", lambda d: d.select((F.col("id") + 1).alias("n")), [a])
    g.node("c", lambda d: d.select("missing"), ["b"])
    got = {n["node"]: n for n in g.spec().inspect(a=spark.range(2))}
    assert got["b"]["columns"] == [("n", "bigint")] and got["a"]["readers"] == ["b"] and got["c"]["error"] and got["c"]["columns"] is None


def test_running_totals_and_prefixes_over_stretches(spark, monkeypatch):
    from deltaview.sources import changelog as log

    monkeypatch.setattr(log, "STRETCH", 4)
    data = [("a", i, (-1) ** i * i) for i in range(1, 15)] + [("b", 3, 5), (None, 9, 1)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in log.pn_totals(spark.createDataFrame(data, "src string, seq long, n long"), "src", "seq", "n").collect()}
    for w in ("a", "b", None):
        up = down = 0
        for src, seq, n in data:
            if src == w:
                up, down = up + max(n, 0), down + max(-n, 0)
                assert got[src, seq] == (up, down)
    tags = [("a", i) for i in range(1, 11)] + [("b", i) for i in range(1, 9)] + [("c", i) for i in (1, 2, 3, 4, 9, 10, 11, 12)] + [("d", 2), ("e", 1), ("e", 3), ("f", 5), ("f", 6), ("f", 7), ("f", 8)]
    assert rows(log.delivered_prefix(spark.createDataFrame(tags, "src string, ctr long"))) == {("a", 10), ("b", 8), ("c", 4), ("e", 1)}
