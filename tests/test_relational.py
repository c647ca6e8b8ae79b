"""Goldens of the operators and sources, and one test for each semantic trap."""

import pytest
from pyspark.sql import functions as F

from deltaview.functions import catalog
from deltaview.functions.interest import Everything, Nothing, Ranges, Slots
from deltaview.functions.windows import sliding_starts, tumbling_start
from deltaview.operators import aggregates as agg
from deltaview.operators import invariants, joins, sets
from deltaview.plans import ranking
from deltaview.plans.argumentation import credences
from deltaview.plans.composites import fused, ready_set, skill_graph, slot_graph, tier, tiering
from deltaview.plans.graph import GraphBuilder, GraphError
from deltaview.plans.iterate import damped_cycle, fixpoint
from deltaview.sources import changelog as log
from deltaview.sources import feeds
from tests.conftest import rows


def col(spark, values, schema="x long"):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def commands(spark, entries, schema="x string"):
    """Entries (+/-, element): one writer, counters in order."""
    out = [("a", i, op == "-", *(e if isinstance(e, tuple) else (e,))) for i, (op, e) in enumerate(entries)]
    return spark.createDataFrame(out, f"src string, seq long, gone boolean, {schema}")


def test_set_source(spark):
    c = commands(spark, [("+", "apple"), ("+", "pear"), ("-", "apple"), ("-", "plum")])
    assert rows(log.set_commands_to_live(c, ["x"], "seq", "src", "gone")) == {("pear",)}


def test_concurrent_add_survives_a_remove(spark):
    c = spark.createDataFrame([("a", 0, False, "e"), ("b", 1, False, "e"), ("a", 2, True, "e")], "src string, seq long, gone boolean, x string")
    assert rows(log.set_commands_to_live(c, ["x"], "seq", "src", "gone")) == {("e",)}


def test_keyed_set_and_map(spark):
    c = spark.createDataFrame([("k1", "x", 0, False), ("k1", "y", 1, False), ("k2", "z", 2, False), ("k1", None, 3, True)], "k string, v string, seq long, gone boolean")
    assert rows(log.keyed_set(c, ["k"], ["v"], "seq", "gone")) == {("z",)}
    m = spark.createDataFrame([("k1", 1, 0, False), ("k1", 2, 1, False), ("k2", 9, 2, False), ("k2", None, 3, True)], "k string, v long, seq long, gone boolean")
    assert rows(log.latest(m, ["k"], ["v"], "seq", "gone")) == {("k1", 2)}


def test_map_tells_a_null_value_from_an_absent_key(spark):
    m = spark.createDataFrame([("k", None, 0, False)], "k string, v long, seq long, gone boolean")
    assert rows(log.latest(m, ["k"], ["v"], "seq", "gone")) == {("k", None)}


def test_or_map_takes_the_greatest_live_dot(spark):
    c = spark.createDataFrame([("k", "old", 1, "a", False), ("k", "new", 5, "b", False), ("k", None, 7, "b", True)], "k string, v string, seq long, src string, gone boolean")
    assert rows(log.or_map(c, ["k"], "v", "seq", "src", "gone")) == {("k", "old")}
    puts = spark.createDataFrame([("k", "x", "a", 3), ("k", "y", "b", 3)], "k string, v string, src string, ctr long")
    dead = spark.createDataFrame([("k", "b", 3)], "k string, src string, ctr long")
    assert rows(log.or_map_of_dots(puts, dead.limit(0), ["k"], "v")) == {("k", "y")}
    assert rows(log.or_map_of_dots(puts, dead, ["k"], "v")) == {("k", "x")}


def test_counters(spark):
    a = spark.createDataFrame([("s", i, v) for i, v in enumerate([5, 37, -6, 1, 1, 1, 1, 1])], "src string, seq long, n long")
    assert log.counter(a, "n").first()[0] == 41
    assert log.pn_counter(log.pn_totals(a, "src", "seq", "n"), "src", "inc", "dec").first()[0] == 41
    assert log.counter(a.limit(0), "n").first()[0] == 0
    twice = spark.createDataFrame([("s", 64, 22), ("s", 64, 22), ("s", 10, 0)], "src string, inc long, dec long")
    assert log.pn_counter(twice, "src", "inc", "dec").first()[0] == 42


def test_list_replay(spark):
    ops = [("add", None, "a"), ("add", None, "b"), ("add", None, "c"), ("insert", 1, "z"), ("remove", 0, None)]
    c = spark.createDataFrame([("l", i, *o) for i, o in enumerate(ops)], "id string, seq long, op string, at int, e string")
    out = log.list_state(c, "id", "seq", "op", "at", "e").orderBy("position").collect()
    assert [r["e"] for r in out] == ["z", "b", "c"]


def test_frontiers(spark):
    tags = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2)], "src string, ctr long")
    assert rows(log.delivered_prefix(tags)) == {("a", 2)}
    assert log.frontier(tags).first()[0] == {"a": 4, "b": 2}
    seen = spark.createDataFrame([("a", 2)], "src string, ctr long")
    assert rows(log.since(tags, seen)) == {("a", 4), ("b", 2)}
    epochs = spark.createDataFrame([("r", 1), ("r", 2), ("q", 3)], "m string, e long")
    assert rows(log.suspended(epochs, ["m"], "e")) == {("q",)}


def test_removed_from_a_merged_view_until_added_again(spark):
    base = spark.createDataFrame([("e", "a", 1, "add"), ("f", "b", 1, "add")], "x string, src string, ctr long, op string")
    gone = log.remove_observed(base, ["x"], base.select("x").filter("x = 'e'"))
    assert rows(log.live(gone, ["x"])) == {("f",)}
    again = spark.createDataFrame([("e", "a", 2, "add")], base.schema)
    assert rows(log.live(log.merge(gone, again), ["x"])) == {("e",), ("f",)}
    assert rows(log.live(log.merge(gone, gone), ["x"])) == {("f",)}, "an echo changes nothing"


def test_rebaseline_and_epochs(spark):
    base = spark.createDataFrame([("e", "a", 1, "add"), ("f", "a", 2, "add"), ("g", "b", 1, "add")], "x string, src string, ctr long, op string")
    assert rows(log.live(log.rebaseline(base, base.filter("x = 'f'"), ["a"]), ["x"])) == {("f",), ("g",)}
    e = spark.createDataFrame([("i", 1, "old"), ("i", 2, "new")], "id string, epoch long, v string")
    assert rows(log.newest_epoch(e, "id", "epoch")) == {("i", 2, "new")}


def test_unary_sets(spark):
    assert rows(sets.filter_set(col(spark, range(1, 6)), catalog.even(F.col("x")))) == {(2,), (4,)}
    assert rows(sets.map_set(col(spark, [1, 2, 3]), catalog.add(F.col("x"), 10).alias("x"))) == {(11,), (12,), (13,)}
    lists = spark.createDataFrame([([1, 2],), ([2, 3],)], "x array<long>")
    assert rows(sets.flat_map_set(lists, F.col("x"), "y")) == {(1,), (2,), (3,)}
    assert sets.count_set(col(spark, [7, 7, 8])).first()[0] == 2
    assert sets.count_set(col(spark, [])).first()[0] == 0


def test_projection_that_collapses_rows_is_a_set(spark):
    assert sets.map_set(col(spark, [(1, 1), (1, 2)], "x long, y long"), "x").count() == 1
    assert sets.map_stream(col(spark, [(1, 1), (1, 2)], "x long, y long"), "x").count() == 2


def test_set_algebra(spark):
    a, b = col(spark, ["x", "z", None], "x string"), col(spark, ["y", "z", "w", None], "x string")
    assert rows(sets.union_set(a, b)) == {("x",), ("y",), ("z",), ("w",), (None,)}
    assert rows(sets.intersect_set(a, b)) == {("z",), (None,)}
    assert rows(sets.difference_set(a, b)) == {("x",)}


def test_quorum(spark):
    a, b, c = col(spark, [1, 2]), col(spark, [2, 3]), col(spark, [2])
    assert rows(sets.quorum([a, b, c], sets.k_of_n(2))) == {(2,)}
    assert rows(sets.quorum([a, b, c.limit(0)], sets.all_of)) == set(), "empty inputs count"
    assert rows(sets.quorum([a, b], lambda n: 0)) == {(1,), (2,), (3,)}, "nobody's element is never admitted"
    assert [sets.majority(n) for n in (1, 2, 3, 4)] == [1, 2, 2, 3] and sets.near_miss(5) == 4
    assert rows(sets.presence_count([a.union(a), b])) == {(1, 1), (2, 2), (3, 1)}


def test_joins(spark):
    left = col(spark, [("k1", "L1"), ("k2", "L2"), (None, "L0")], "k string, l string")
    right = col(spark, [("k1", "R1"), ("k2", "R2b"), (None, "R0")], "rk string, r string")
    assert rows(joins.join_set(left, right, ["k"], ["rk"], ["k", "l", "r"])) == {("k1", "L1", "R1"), ("k2", "L2", "R2b"), (None, "L0", "R0")}, "null keys are equal"
    assert rows(joins.semi_join(left, right.filter("rk = 'k1'"), ["k"], ["rk"])) == {("k1", "L1")}
    assert rows(joins.anti_join(left, right.filter("rk = 'k1'"), ["k"], ["rk"])) == {("k2", "L2"), (None, "L0")}
    assert joins.cross_product(left.select("k"), right.select("r")).count() == 9
    only = right.filter("rk = 'k1'")
    assert rows(joins.left_join(left, only, ["k"], ["rk"], ["l", "r"])) == {("L1", "R1"), ("L2", None), ("L0", None)}
    assert rows(joins.right_join(left.filter("k = 'k2'"), only, ["k"], ["rk"], ["l", "r"])) == {(None, "R1")}
    assert rows(joins.full_join(left.filter("k = 'k2'"), only, ["k"], ["rk"], ["l", "r"])) == {(None, "R1"), ("L2", None)}


def test_many_to_one_combination_is_a_set(spark):
    left, right = col(spark, [("k", 1), ("k", 2)], "k string, l long"), col(spark, [("k", 3)], "rk string, r long")
    assert rows(joins.join_set(left, right, ["k"], ["rk"], ["k", "r"])) == {("k", 3)}


def test_map_joins(spark):
    a, b = col(spark, [("x", 1), ("y", 2)], "k string, v long"), col(spark, [("y", 5), ("z", 6)], "k string, w long")
    assert rows(joins.map_join(a, b, "k")) == {("y", 2, 5)}
    total = F.coalesce("l", F.lit(0)) + F.coalesce("r", F.lit(0))
    assert rows(joins.combine_latest(a, b, "k", {"t": total})) == {("x", 1), ("y", 7), ("z", 6)}
    assert rows(joins.combine_latest(a, b, "k", {"t": F.col("l") + F.col("r")}, required="t")) == {("y", 7)}, "a null result drops the key"
    fact, dim = col(spark, [("k1", "v1"), ("k2", "v2")], "k string, v string"), col(spark, [("k1", "d1")], "j string, d string")
    out = {c: F.col(c) for c in ("k", "v", "d")}
    assert rows(joins.lookup_join(fact, dim, ["k"], ["j"], out)) == {("k1", "v1", "d1"), ("k2", "v2", None)}
    assert rows(joins.lookup_join(fact, dim, ["k"], ["j"], out, inner=True)) == {("k1", "v1", "d1")}
    assert rows(joins.lookup_join(fact, dim, ["k"], ["j"], out, required="d")) == {("k1", "v1", "d1")}
    assert joins.coalescing_sum([col(spark, [30], "n long"), col(spark, [12], "n long"), col(spark, [], "n long")], "n").first()[0] == 42


def test_aggregates(spark):
    g = col(spark, [("a", 1), ("a", 2), ("b", 3), ("a", 2)], "k string, v long")
    assert rows(agg.group_by(g, ["k"], agg.count())) == {("a", 2), ("b", 1)}
    assert rows(agg.group_by(g, ["k"], agg.sum_of(F.col("v")), agg.avg_of(F.col("v")), agg.min_of(F.col("v")), agg.max_of(F.col("v")))) == {("a", 3, 1.5, 1, 2), ("b", 3, 3.0, 3, 3)}
    assert agg.group_global(g.limit(0), agg.count()).count() == 0, "no elements, no group"
    assert rows(agg.group_global(g, agg.count())) == {("global", 3)}


def test_elements_that_share_a_value_count_twice(spark):
    g = col(spark, [("a", 1, 5), ("a", 2, 5)], "k string, id long, v long")
    assert rows(agg.group_by(g, ["k"], agg.sum_of(F.col("v")))) == {("a", 10)}


def test_count_counts_null_fields_and_collect_keeps_elements_whole(spark):
    g = col(spark, [("a", None), ("a", 1)], "k string, v long")
    assert rows(agg.group_by(g, ["k"], agg.count())) == {("a", 2)}
    members = agg.group_by(g, ["k"], agg.collect_to_set(["v"])).first()["members"]
    assert [m["v"] for m in members] == [None, 1]


def test_top_k_keeps_repeats(spark):
    g = col(spark, [("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 4, 1)], "k string, id long, v long")
    assert {r["k"]: r["top"] for r in agg.top_k(g, ["k"], "v", 2).collect()} == {"a": [5, 5], "b": [1]}


def test_mergeable_and_partitioned(spark):
    a, b = col(spark, [("x", 1), ("y", 9)], "k string, v long"), col(spark, [("x", 4)], "k string, v long")
    assert rows(agg.mergeable_group_by([a, b], ["k"], {"m": F.max("v")}, {"m": F.max("m")})) == {("x", 4), ("y", 9)}
    assert rows(agg.partitioned_group_by(a.union(b), ["k"], 3, agg.sum_of(F.col("v")))) == {("x", 5), ("y", 9)}


def test_windows(spark):
    t = col(spark, [-1, 0, 9, 10], "t long")
    assert [r[0] for r in t.select(tumbling_start(F.col("t"), 10)).collect()] == [-10, 0, 0, 10]
    s = col(spark, [12, 3, -1], "t long").select(sliding_starts(F.col("t"), 10, 5)).collect()
    assert [r[0] for r in s] == [[5, 10], [-5, 0], [-10, -5]]
    late = col(spark, [(17, 7), (8, 2)], "t long, v long").withColumn("w", tumbling_start(F.col("t"), 10))
    assert rows(agg.group_by(late, ["w"], agg.sum_of(F.col("v")))) == {(0, 2), (10, 7)}
    slide = col(spark, [(3, 5), (22, 9)], "t long, v long").withColumn("w", F.explode(sliding_starts(F.col("t"), 10, 5)))
    assert rows(agg.group_by(slide, ["w"], agg.sum_of(F.col("v")))) == {(-5, 5), (0, 5), (15, 9), (20, 9)}
    with pytest.raises(ValueError):
        sliding_starts(F.col("t"), 5, 6)


def test_interest(spark):
    t = col(spark, [1, 5, 9, None])
    hold = lambda i: {r[0] for r in i.within(t, F.col("x")).collect()}
    assert hold(Ranges([(2, 9)])) == {5} and hold(~Ranges([(2, 9)])) == {1, 9, None}
    assert hold(Everything()) == {1, 5, 9, None} and hold(Nothing()) == set()
    assert hold(Slots(4, [1]) & Ranges([(None, 9)])) == {1, 5} and hold(Slots(4, [3]) | Ranges([(9, None)])) == {9}


def test_catalog(spark):
    d = spark.createDataFrame([(-7, None, '"open"', "1", ["k", "v"])], "n long, z long, j string, b string, l array<string>")
    c = catalog
    got = d.select(c.mod_eq(F.col("n"), 10, 3), c.odd(F.col("n")), c.gt(F.col("z"), 1), c.eq(F.col("z"), None), c.add(F.col("z"), 2), c.json_text(F.col("j")), c.truthy(F.col("b")), c.truthy(F.col("z").cast("string")), c.key_of(F.col("l")), c.value_of(F.col("l")), c.concat(F.col("n"), "!"), c.found_in("PEN", F.col("j"))).first()
    assert tuple(got) == (True, True, False, True, 2, "open", True, False, "k", "v", "-7!", True)


def test_feeds(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "n": 1}\nnot json\n{"n": 3}\n\n')
    good, bad = feeds.read_export(spark, str(p), "id string, n long")
    assert rows(good) == {("a", 1)} and bad.count() == 2
    for fmt in ("parquet", "orc", "json", "csv"):
        out = str(tmp_path / fmt)
        feeds.write_table(good, out, fmt)
        assert rows(feeds.read_table(spark, out, fmt, "id string, n long")) == {("a", 1)}
    with pytest.raises(ValueError):
        feeds.read_table(spark, "x", "avro")
    ok, dead = feeds.dead_letters(col(spark, [1, None]), F.col("x") > 0)
    assert ok.count() == 1 and dead.count() == 1
    assert feeds.disclosed(good, "deny").count() == 0 and feeds.disclosed(good, "project", ("id",)).columns == ["id"]


def test_change_feed(spark):
    raw = spark.createDataFrame([(1, 0, "i", "status", None, '"open"', "added"), (2, 0, "i", "status", '"open"', '"closed"', "modified"), (3, 0, "j", "status", None, '"open"', "added"), (4, 0, "j", "status", '"open"', None, "removed")], "commit_height long, ordinal int, key string, column string, old string, new string, diff_type string")
    c = feeds.change_feed(raw)
    assert rows(feeds.mirror(c)) == {("i", "status", '"closed"')}
    assert feeds.field_changes(c).count() == 4


def test_graph_replays_and_checks(spark):
    g = GraphBuilder()
    g.source("s")
    g.node("evens", lambda d: sets.filter_set(d, catalog.even(F.col("x"))), ["s"], col(spark, []).schema)
    g.node("n", sets.count_set, ["evens"])
    spec = g.spec()
    s = col(spark, range(6))
    assert [spec.apply(s=s)["n"].first()[0] for _ in range(2)] == [3, 3]
    with pytest.raises(GraphError):
        spec.apply()
    with pytest.raises(GraphError):
        g.node("n", sets.count_set, ["evens"])
    with pytest.raises(GraphError):
        g.node("m", sets.count_set, ["nowhere"])
    with pytest.raises(GraphError):
        spec.apply(s=col(spark, ["a"], "x string").withColumn("x", F.col("x").cast("int")))
    outer = GraphBuilder()
    outer.source("t")
    assert outer.composite("inner", spec, s="t")["n"] == "inner.n"
    g.node("broken", lambda d: d.select("nothing"), ["s"])
    made, failed = g.spec().try_apply(s=s)
    assert "n" in made and set(failed) == {"broken"}


def test_skill_graph(spark):
    cand = spark.createDataFrame([("ann", "sql"), ("ann", "go"), ("bob", "go")], "candidate string, skill string")
    jobs = spark.createDataFrame([("dev", "go"), ("dev", "sql"), ("ops", "go"), ("ops", "aws")], "job string, skill string")
    out = skill_graph().apply(candidate_skills=cand, job_skills=jobs)
    assert rows(out["qualification"]) == {("ann", "dev", 2, 2, True), ("bob", "dev", 1, 2, False), ("ann", "ops", 1, 2, False), ("bob", "ops", 1, 2, False)}
    assert rows(out["gap"]) == {("ops", "aws")}
    assert rows(out["market"]) == {("sql", 1, 1, False), ("go", 2, 2, False), ("aws", 0, 1, True)}


def test_qualification_of_all_pairs(spark, monkeypatch):
    """Bits of a number, skills beyond them, blocks that a task may not hold: equal pairs, and none moves."""
    cand = [(i if i else None, k if k else None) for i in range(9) for k in range(7) if (i * k) % 3 != 1 and i != 7]
    need = [(f"j{i}", k if k else None) for i in range(8) for k in range(i, 9)]
    c, j = spark.createDataFrame(cand, "candidate int, skill int"), spark.createDataFrame(need, "job string, skill int")
    has = {a: {k for b, k in cand if a == b} for a, _ in cand}
    needs = {a: {k for b, k in need if a == b} for a, _ in need}
    want = {(a, b, len(x & y), len(y), x >= y) for a, x in has.items() for b, y in needs.items() if x & y}
    for bits, block, held in ((63, 2048, 100), (7, 2, 100), (63, 2, 0), (6, 2048, 100)):
        for name, v in (("MOST_BITS", bits), ("BLOCK", block), ("MOST_HELD", held)):
            monkeypatch.setattr(f"deltaview.plans.composites.{name}", v)
        out = skill_graph().only("qualification").apply(candidate_skills=c, job_skills=j)["qualification"]
        assert rows(out) == want
        if bits > 6:
            above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
            assert "Join" not in above and "Aggregate" not in above
    assert set(skill_graph().only("gap").apply(candidate_skills=c, job_skills=j)) == {"candidate_skills", "job_skills", "gap"}
    with pytest.raises(GraphError):
        skill_graph().only("nowhere")


def test_slots_and_tiers(spark):
    slot = "day string, hour int"
    p = [spark.createDataFrame(x, slot) for x in ([("Mon", 9), ("Mon", 20)], [("Mon", 9), ("Mon", 20)], [("Mon", 9), ("Mon", 20), ("Tue", 10)])]
    out = slot_graph(3).apply(person_0=p[0], person_1=p[1], person_2=p[2])
    assert rows(out["by_day"]) == {("Mon", 1)} and rows(out["near_miss"]) == {("Mon", 9), ("Mon", 20)}
    v = spark.createDataFrame([("a", "i", 6), ("b", "i", 4)], "agent string, item string, score long")
    prefs = spark.createDataFrame([("a", "i", "j")], "agent string, winner string, loser string")
    got = {r["item"]: (round(r["score"], 6), r["tier"]) for r in tiering(v, prefs).collect()}
    assert got == {"i": (round(0.7 * 5 / 6 + 0.3, 6), "S"), "j": (0.0, "F")}
    one = spark.createDataFrame([(None, None, None), (3.0, None, None)], "a double, b double, c double").select(fused(F.col("a"), F.col("b")).alias("s")).select("s", tier(F.col("s"))).collect()
    assert one[0]["s"] is None and tuple(one[1]) == (0.5, "C")


def test_ready_set(spark):
    f = []
    for key, status, kind, pinned in (("a", "open", "task", None), ("b", "open", "task", "1"), ("c", "open", "gate", None), ("d", "open", "task", None), ("e", "closed", "task", None), ("g", "open", "task", None), ("h", None, "task", None)):
        for name, v in (("status", status and f'"{status}"'), ("issue_type", f'"{kind}"'), ("pinned", pinned)):
            if v is not None:
                f.append((key, name, v))
    fields = spark.createDataFrame(f, "key string, field string, value string")
    edges = spark.createDataFrame([("d", "a", "blocks"), ("g", "e", "blocks"), ("a", "d", "related"), ("g", "nobody", "blocks")], "key string, depends_on string, type string")
    assert rows(ready_set(fields, edges)) == {("a",), ("g",)}


def test_fixpoints(spark):
    seed = spark.createDataFrame([(64,)], "v long")
    halves = damped_cycle(seed, "v", lambda v: F.floor(v / 2).cast("long"))
    assert halves.first()[0] == 127
    start = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert abs(fixpoint(start, lambda d: d.select("k", (F.col("v") / 2 + 1).alias("v")), "k", "v", 1e-6).first()["v"] - 2.0) < 1e-5
    with pytest.raises(RuntimeError):
        damped_cycle(seed, "v", lambda v: v, most_laps=3)


def test_argumentation(spark):
    claims = spark.createDataFrame([("a",), ("b",), ("e",)], "claim string")
    stances = spark.createDataFrame([("a", 1.0), ("b", 0.6), ("e", 1.0)], "claim string, value double")
    edges = spark.createDataFrame([("e", "a", "b", False)], "edge string, source string, target string, support boolean")
    got = {r[0]: r[1] for r in credences(claims, stances, edges).collect()}
    flow = 0.99 * 0.99
    assert abs(got["b"] - (0.6 - 0.6 * flow)) < 1e-9 and got["a"] == 0.99
    helped = {r[0]: r[1] for r in credences(claims, stances, edges.withColumn("support", F.lit(True))).collect()}
    assert abs(helped["b"] - (0.6 + 0.4 * flow)) < 1e-9


def test_rankings(spark):
    p = spark.createDataFrame([("u", "x", "y"), ("v", "x", "y"), ("u", "y", "z")], "agent string, winner string, loser string")
    assert {r[0]: round(r[1], 6) for r in ranking.mean_of_signs(p).collect()} == {"x": 1.0, "y": -0.333333, "z": -1.0}
    w = {r[0]: r[1] for r in ranking.wilson_rank(p).collect()}
    assert w["x"] > w["y"] > w["z"] == 0
    bt = {r[0]: r[1] for r in ranking.bradley_terry(p).collect()}
    assert bt["x"] > bt["y"] > bt["z"] and abs(bt["x"] * bt["y"] * bt["z"] - 1) < 1e-6
    for _item, s in bt.items():
        assert s > 0
    # the stationary condition of x: wins + prior = strength x expected games
    x, y = bt["x"], bt["y"]
    seq = p.withColumn("seq", F.monotonically_increasing_id())
    for engine in ranking.ENGINES:
        got = {r[0]: r[1] for r in ranking.ordered_rating(seq, engine, "seq").collect()}
        assert set(got) == {"x", "y", "z"} and got["x"] > got["z"]
    assert ranking.replay([("a", "b")], "elo") == {"a": 1016.0, "b": 984.0}
    assert abs(ranking.replay([("a", "b")], "trueskill")["a"] - (29.2052 - 3 * 7.1948)) < 1e-2
    assert x > y


def test_ordered_rating_holds_a_batch_of_games(spark):
    """Boards that are cut by batches, one without a name, equal places and games without one."""
    games = [(b, i // 2 if i < 38 else None, (i * 7) % 5, 5 + (i * 3) % 4) for b in (1, 2, None, 3) for i in range(40)]
    data = spark.createDataFrame(games, "board int, seq long, winner long, loser long").orderBy(F.xxhash64("seq", "winner"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = ranking.ordered_rating(data, "glicko", "seq", "board")
        assert "FlatMapGroups" not in out._jdf.queryExecution().analyzed().toString(), "a board's games as one table"
        got = {(r["board"], r["item"]): r["score"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = sorted(games, key=lambda g: (g[1] is None, g[1] or 0, g[2], g[3]))
    want = {(b, item): v for b in (1, 2, None, 3) for item, v in ranking.replay([g[2:] for g in order if g[0] == b], "glicko").items()}
    assert got == want


def test_borda_ties_and_absent_items(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0), ("z", 1.0)], "item string, score double")
    b = spark.createDataFrame([("x", 5.0)], "item string, score double")
    assert {r[0]: r[1] for r in ranking.borda([a, b]).collect()} == {"x": 1.0, "y": 0.25, "z": 0.25}


def test_invariants(spark):
    t = col(spark, [1, 2, None])
    assert {r[0] for r in invariants.violations(t, F.col("x") < 2).collect()} == {2, None}
    assert invariants.promotable(t, t, F.col("x") < 2) and not invariants.promotable(t.filter("x = 1"), t, F.col("x") < 2)
    assert invariants.schema_mismatch(t, col(spark, ["a"], "x string")) == ["x"]
