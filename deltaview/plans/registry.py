"""Every query of the relational part, with its SQL where SQL can say it.

Elements come from the star schema and the event stream. Command logs are derived from ``events``:
the key is user and day, the sequence and tag counter is event_id, the writer is event_id % 3, an
error event is a removal and any other event writes its type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaview.functions import catalog
from deltaview.functions.interest import Ranges, Slots
from deltaview.functions.windows import epoch_seconds, sliding_starts, tumbling_start
from deltaview.operators import aggregates as agg
from deltaview.operators import invariants, joins, sets
from deltaview.plans import composites, ranking
from deltaview.plans.argumentation import credences
from deltaview.sources import changelog as log
from deltaview.sources import feeds

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT n_name, count(DISTINCT l_partkey) AS parts
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name
""")
def parts_per_nation(spark, sf_dir):
    li, su, na = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    pairs = li.select("l_partkey", "l_suppkey").distinct()
    nations = su.select("s_suppkey", "s_nationkey").join(na, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    live = pairs.join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    return agg.group_by(live.select("n_name", "l_partkey"), ["n_name"], agg.count("parts"))


# --- sources: folds of command logs ---

COMMANDS = "e AS (SELECT concat_ws('-', user_id, CAST(day(ts) AS VARCHAR)) AS k, event_type AS v, event_id AS seq, event_id % 3 AS src, event_type = 'error' AS gone FROM events)"


def commands(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("-", "user_id", F.dayofmonth("ts")).alias("k"),
        F.col("event_type").alias("v"),
        F.col("event_id").alias("seq"),
        F.pmod("event_id", F.lit(3)).alias("src"),
        (F.col("event_type") == "error").alias("gone"),
    )


@query(f"""WITH {COMMANDS} SELECT DISTINCT k FROM e a WHERE NOT gone AND NOT EXISTS
(SELECT 1 FROM e d WHERE d.k = a.k AND d.src = a.src AND d.gone AND d.seq > a.seq)""")
def set_cell_live(spark, sf_dir):
    return log.set_commands_to_live(commands(spark, sf_dir), ["k"], "seq", "src", "gone")


@query(f"""WITH {COMMANDS},
a AS (SELECT k, src, seq FROM e WHERE NOT gone),
d AS (SELECT a.k, a.src, a.seq FROM a JOIN e ON e.k = a.k AND e.src = a.src AND e.gone AND e.seq > a.seq)
SELECT DISTINCT k FROM (SELECT * FROM a EXCEPT SELECT * FROM d)""")
def set_cell_from_tags(spark, sf_dir):
    """The same set from an explicit changelog, with the echo of a replica merged in."""
    e = commands(spark, sf_dir)
    adds = e.filter("NOT gone").select("k", "src", F.col("seq").alias("ctr"), F.lit("add").alias("op"))
    last = e.filter("gone").groupBy("k", "src").agg(F.max("seq").alias("upto"))
    dels = adds.join(last, ["k", "src"]).filter("ctr < upto").select("k", "src", "ctr", F.lit("del").alias("op"))
    return log.live(log.merge(adds, dels, adds.filter("src = 0")), ["k"])


@query(f"WITH {COMMANDS} SELECT DISTINCT v FROM (SELECT k, arg_max(v, seq) AS v, arg_max(gone, seq) AS g FROM e GROUP BY k) WHERE NOT g")
def keyed_set(spark, sf_dir):
    return log.keyed_set(commands(spark, sf_dir), ["k"], ["v"], "seq", "gone")


@query(f"WITH {COMMANDS} SELECT k, v FROM (SELECT k, arg_max(v, seq) AS v, arg_max(gone, seq) AS g FROM e GROUP BY k) WHERE NOT g")
def map_cell(spark, sf_dir):
    return log.latest(commands(spark, sf_dir), ["k"], ["v"], "seq", "gone")


@query(f"""WITH {COMMANDS}, w AS (SELECT k, src, arg_max(v, seq) AS v, arg_max(gone, seq) AS g, max(seq) AS seq FROM e GROUP BY k, src)
SELECT k, arg_max(v, seq) AS v FROM w WHERE NOT g GROUP BY k""")
def or_map(spark, sf_dir):
    return log.or_map(commands(spark, sf_dir), ["k"], "v", "seq", "src", "gone")


AMOUNTS = "m AS (SELECT event_id, event_id % 3 AS src, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * (event_id % 7) AS amount FROM events)"


def amounts(spark, sf_dir):
    sign = F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(3)).alias("src"), (sign * F.pmod("event_id", F.lit(7))).alias("amount"))


@query(f"WITH {AMOUNTS} SELECT CAST(sum(amount) AS BIGINT) AS total FROM m")
def counter(spark, sf_dir):
    return log.counter(amounts(spark, sf_dir), "amount")


@query(f"WITH {AMOUNTS} SELECT CAST(sum(amount) AS BIGINT) AS total FROM m")
def pn_counter(spark, sf_dir):
    # cumulative totals of each writer by day, as replicas would report them
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    daily = amounts(spark, sf_dir).join(e, "event_id").groupBy("src", "day").agg(F.sum(F.greatest("amount", F.lit(0))).alias("up"), F.sum(F.greatest(-F.col("amount"), F.lit(0))).alias("down"))
    w = W.partitionBy("src").orderBy("day")
    return log.pn_counter(daily.select("src", F.sum("up").over(w).alias("inc"), F.sum("down").over(w).alias("dec")), "src", "inc", "dec")


@query("SELECT event_id % 3 AS replica, user_id % 16 AS source, max(event_id) AS through FROM events GROUP BY ALL")
def delivered_watermark(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.pmod("event_id", F.lit(3)).alias("replica"), F.pmod("user_id", F.lit(16)).alias("source"), F.col("event_id").alias("through"))
    return log.watermark(e, ["replica", "source"], "through")


@query("""WITH t AS (SELECT DISTINCT user_id % 16 AS src, event_id % 50 + 1 AS ctr FROM events WHERE event_type <> 'error'),
r AS (SELECT src, ctr, row_number() OVER (PARTITION BY src ORDER BY ctr) AS n FROM t) SELECT src, max(ctr) AS through FROM r WHERE n = ctr GROUP BY src""")
def delivered_prefix(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return log.delivered_prefix(e.select(F.pmod("user_id", F.lit(16)).alias("src"), (F.pmod("event_id", F.lit(50)) + 1).alias("ctr")))


@query("""WITH l AS (SELECT user_id AS k, event_id % 3 AS src, event_id AS ctr FROM events), s AS (SELECT src, max(ctr) // 2 AS seen FROM l WHERE src < 2 GROUP BY src)
SELECT k, l.src, ctr FROM l LEFT JOIN s ON l.src = s.src WHERE ctr > coalesce(seen, -1)""")
def catch_up_since(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.pmod("event_id", F.lit(3)).alias("src"), F.col("event_id").alias("ctr"))
    seen = e.filter("src < 2").groupBy("src").agg(F.expr("max(ctr) div 2").alias("ctr"))
    return log.since(e, seen)


@query("""WITH l AS (SELECT user_id AS k, event_id % 5 AS epoch, event_id FROM events), t AS (SELECT k, max(epoch) AS top FROM l GROUP BY k)
SELECT l.k, epoch, event_id FROM l JOIN t ON l.k = t.k AND epoch = top""")
def single_writer_epoch(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.pmod("event_id", F.lit(5)).alias("epoch"), "event_id")
    return log.newest_epoch(e, "k", "epoch")


@query("""WITH l AS (SELECT user_id AS k, event_id % 3 AS src, event_id AS ctr FROM events)
SELECT DISTINCT k FROM l WHERE src <> 2 OR ctr % 4 = 2""")
def rebaseline(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.pmod("event_id", F.lit(3)).alias("src"), F.col("event_id").alias("ctr"), F.lit("add").alias("op"))
    return log.live(log.rebaseline(e, e.filter("src = 2 AND ctr % 4 = 2"), [2]), ["k"])


@query("""WITH l AS (SELECT user_id AS k, event_id AS ctr FROM events), g AS (SELECT DISTINCT k FROM l WHERE k % 5 = 0)
SELECT DISTINCT k FROM l WHERE NOT (k IN (SELECT k FROM g) AND ctr < 5000) """)
def remove_observed(spark, sf_dir):
    """Removal from the merged view covers the tags seen by then; later adds revive the element."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.pmod("event_id", F.lit(3)).alias("src"), F.col("event_id").alias("ctr"), F.lit("add").alias("op"))
    early, late = e.filter("ctr < 5000"), e.filter("ctr >= 5000")
    return log.live(log.merge(log.remove_observed(early, ["k"], e.filter("k % 5 = 0").select("k")), late), ["k"])


@query("""WITH p AS (SELECT user_id AS k, sum(event_id % 9) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT k, CAST(n AS BIGINT) AS n FROM p WHERE k NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 11 = 0)""")
def map_delta_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    puts = e.filter("event_type <> 'error'").select(F.col("user_id").alias("k"), F.pmod("event_id", F.lit(9)).alias("n"))
    return log.merge_map_deltas(puts, e.filter("event_type = 'signup' AND event_id % 11 = 0").select(F.col("user_id").alias("k")), "k", F.sum)


@query()
def list_cell(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    op = F.when(F.col("n") % 4 == 0, "insert").when(F.col("n") % 5 == 0, "remove").when(F.col("n") % 7 == 0, "set").otherwise("add")
    return log.list_state(e.withColumn("n", n).select("user_id", "event_id", op.alias("op"), F.lit(0).alias("at"), "event_type"), "user_id", "event_id", "op", "at", "event_type")


# --- set operators ---


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def filter_even(spark, sf_dir):
    return sets.filter_set(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), catalog.even(F.col("o_orderkey")))


@query("SELECT DISTINCT l_partkey + 10 AS shifted FROM lineitem")
def map_set(spark, sf_dir):
    return sets.map_set(table(spark, sf_dir, "lineitem"), catalog.add(F.col("l_partkey"), 10).alias("shifted"))


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part)")
def flatmap_set(spark, sf_dir):
    return sets.flat_map_set(table(spark, sf_dir, "part"), F.split("p_type", " "), "word")


@query("SELECT l_orderkey, l_linenumber, concat(CAST(l_partkey AS VARCHAR), '-p') AS label FROM lineitem")
def map_stream(spark, sf_dir):
    return sets.map_stream(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", catalog.concat(F.col("l_partkey"), "-p").alias("label"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def count_distinct_elements(spark, sf_dir):
    return sets.count_set(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"))


def _returned(spark, sf_dir, flag):
    return table(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") == flag) & (F.col("l_quantity") >= 49)).select("l_partkey")


_R, _A = ("SELECT l_partkey FROM lineitem WHERE l_returnflag = '%s' AND l_quantity >= 49" % f for f in "RA")


@query(f"{_R} UNION {_A}")
def union_set(spark, sf_dir):
    return sets.union_set(_returned(spark, sf_dir, "R"), _returned(spark, sf_dir, "A"))


@query(f"{_R} INTERSECT {_A}")
def intersect_set(spark, sf_dir):
    return sets.intersect_set(_returned(spark, sf_dir, "R"), _returned(spark, sf_dir, "A"))


@query(f"{_R} EXCEPT {_A}")
def difference_set(spark, sf_dir):
    return sets.difference_set(_returned(spark, sf_dir, "R"), _returned(spark, sf_dir, "A"))


@query(f"{_R} EXCEPT ALL {_A}")
def except_all(spark, sf_dir):
    return sets.except_all(_returned(spark, sf_dir, "R"), _returned(spark, sf_dir, "A"))


@query(f"{_R} INTERSECT ALL {_A}")
def intersect_all(spark, sf_dir):
    return sets.intersect_all(_returned(spark, sf_dir, "R"), _returned(spark, sf_dir, "A"))


def _active(spark, sf_dir, days):
    e = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("d"))
    return [e.filter(F.col("d") == d).select("user_id") for d in days]


def _quorum_sql(days: int, need: int) -> str:
    return f"SELECT user_id FROM (SELECT DISTINCT user_id, day(ts) AS d FROM events WHERE day(ts) <= {days}) GROUP BY user_id HAVING count(*) >= {need}"


@query(_quorum_sql(3, 2))
def quorum_k2of3(spark, sf_dir):
    return sets.quorum(_active(spark, sf_dir, (1, 2, 3)), sets.k_of_n(2))


@query(_quorum_sql(3, 3))
def quorum_all(spark, sf_dir):
    return sets.quorum(_active(spark, sf_dir, (1, 2, 3)), sets.all_of)


@query(_quorum_sql(3, 1))
def quorum_any(spark, sf_dir):
    return sets.quorum(_active(spark, sf_dir, (1, 2, 3)), sets.any_of)


@query(_quorum_sql(4, 3))
def quorum_majority(spark, sf_dir):
    return sets.quorum(_active(spark, sf_dir, (1, 2, 3, 4)), sets.majority)


@query(_quorum_sql(5, 4))
def quorum_near_miss(spark, sf_dir):
    return sets.quorum(_active(spark, sf_dir, (1, 2, 3, 4, 5)), sets.near_miss)


@query("SELECT user_id, CAST(count(*) AS INTEGER) AS presence FROM (SELECT DISTINCT user_id, day(ts) AS d FROM events WHERE day(ts) <= 3) GROUP BY user_id")
def presence_count(spark, sf_dir):
    return sets.presence_count(_active(spark, sf_dir, (1, 2, 3)))


# --- joins ---


@query("SELECT DISTINCT c_mktsegment, o_orderpriority, o_orderkey FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def join_set(spark, sf_dir):
    return joins.join_set(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["o_custkey"], ["c_custkey"], ["c_mktsegment", "o_orderpriority", "o_orderkey"], unique=True)


@query("SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a CROSS JOIN region b")
def cross_product(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return joins.cross_product(r.select(F.col("r_name").alias("left_name")), r.select(F.col("r_name").alias("right_name")))


def _big_f(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)).select("o_custkey")


_EXISTS = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)"


@query(f"SELECT c_custkey, c_name FROM customer WHERE {_EXISTS}")
def semi_join(spark, sf_dir):
    return joins.semi_join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _big_f(spark, sf_dir), ["c_custkey"], ["o_custkey"])


@query(f"SELECT c_custkey, c_name FROM customer WHERE NOT {_EXISTS}")
def anti_join(spark, sf_dir):
    return joins.anti_join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _big_f(spark, sf_dir), ["c_custkey"], ["o_custkey"])


def _by_nation(spark, sf_dir):
    c = agg.group_by(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), ["nation"], agg.count("v"), unique=True)
    s = agg.group_by(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")), ["nation"], agg.count("w"), unique=True)
    return c, s


_NATIONS = "c AS (SELECT c_nationkey AS nation, count(*) AS v FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS w FROM supplier GROUP BY 1)"


@query(f"WITH {_NATIONS} SELECT c.nation, v AS customers, w AS suppliers FROM c JOIN s ON c.nation IS NOT DISTINCT FROM s.nation")
def map_join(spark, sf_dir):
    return joins.map_join(*_by_nation(spark, sf_dir), "nation", ("customers", "suppliers"))


@query(f"""WITH {_NATIONS} SELECT coalesce(c.nation, s.nation) AS nation, coalesce(w, 0) AS supply, coalesce(v, 0) AS demand, coalesce(v, 0) > coalesce(w, 0) AS scarce
FROM (SELECT * FROM c WHERE v > 50) c FULL OUTER JOIN s ON c.nation IS NOT DISTINCT FROM s.nation""")
def combine_latest(spark, sf_dir):
    c, s = _by_nation(spark, sf_dir)
    demand, supply = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    return joins.combine_latest(c.filter("v > 50"), s, "nation", {"supply": supply, "demand": demand, "scarce": demand > supply})


@query(f"""WITH {_NATIONS} SELECT c.nation, v + w AS both_sides FROM (SELECT * FROM c WHERE v > 50) c JOIN s ON c.nation IS NOT DISTINCT FROM s.nation""")
def combine_latest_required(spark, sf_dir):
    """A null result drops the key."""
    c, s = _by_nation(spark, sf_dir)
    return joins.combine_latest(c.filter("v > 50"), s, "nation", {"both_sides": F.col("l") + F.col("r")}, required="both_sides")


@query("""WITH f AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT * FROM part WHERE p_size > 10)
SELECT l_partkey, n, p_brand, p_brand IS NULL AS missing FROM f LEFT JOIN d ON l_partkey IS NOT DISTINCT FROM p_partkey""")
def lookup_join(spark, sf_dir):
    fact = agg.group_by(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], agg.count("n"), unique=True)
    dim = table(spark, sf_dir, "part").filter("p_size > 10").select("p_partkey", "p_brand")
    return joins.lookup_join(fact, dim, ["l_partkey"], ["p_partkey"], {"l_partkey": F.col("l_partkey"), "n": F.col("n"), "p_brand": F.col("p_brand"), "missing": F.col("p_brand").isNull()})


@query("""WITH f AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, n, p_brand FROM f JOIN part ON l_partkey IS NOT DISTINCT FROM p_partkey WHERE p_size > 10""")
def lookup_join_inner(spark, sf_dir):
    fact = agg.group_by(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], agg.count("n"), unique=True)
    dim = table(spark, sf_dir, "part").filter("p_size > 10").select("p_partkey", "p_brand")
    return joins.lookup_join(fact, dim, ["l_partkey"], ["p_partkey"], {c: F.col(c) for c in ("l_partkey", "n", "p_brand")}, inner=True)


_SIDES = "c AS (SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 12), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000)"


def _sides(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_nationkey < 12").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_orderkey", "o_custkey")


def _outer_sql(kind: str) -> str:
    return f"WITH {_SIDES} SELECT DISTINCT c_name, o_orderkey FROM c {kind} JOIN o ON c_custkey IS NOT DISTINCT FROM o_custkey"


@query(_outer_sql("LEFT"))
def left_join(spark, sf_dir):
    return joins.left_join(*_sides(spark, sf_dir), ["c_custkey"], ["o_custkey"], ["c_name", "o_orderkey"])


@query(_outer_sql("RIGHT"))
def right_join(spark, sf_dir):
    return joins.right_join(*_sides(spark, sf_dir), ["c_custkey"], ["o_custkey"], ["c_name", "o_orderkey"])


@query(_outer_sql("FULL OUTER"))
def full_join(spark, sf_dir):
    return joins.full_join(*_sides(spark, sf_dir), ["c_custkey"], ["o_custkey"], ["c_name", "o_orderkey"])


@query("SELECT CAST(sum(event_id % 7) + sum(user_id % 5) AS BIGINT) AS total FROM events")
def coalescing_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return joins.coalescing_sum([e.select(F.pmod("event_id", F.lit(7)).alias("v")), e.select(F.pmod("user_id", F.lit(5)).alias("v"))], "v")


# --- aggregates: order and line number repeat in lineitem, so elements have to be made distinct ---

_LI = "li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, CAST(round(l_quantity * 100) AS BIGINT) AS q, l_suppkey FROM lineitem)"


def _li(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.round(F.col("l_quantity") * 100).cast("long").alias("q"), "l_suppkey")


def _grouped(name: str, make, sql: str):
    """Register a group-by of one aggregator over return flags."""
    made = lambda spark, sf_dir: agg.group_by(_li(spark, sf_dir), ["l_returnflag"], make())
    made.__name__ = f"group_by_{name}"
    return query(f"WITH {_LI} SELECT l_returnflag, {sql} AS {name} FROM li GROUP BY 1")(made)


_grouped("count", agg.count, "count(*)")
_grouped("sum", lambda: agg.sum_of(F.col("q")), "CAST(sum(q) AS BIGINT)")
_grouped("avg", lambda: agg.avg_of(F.col("q")), "CAST(sum(q) AS DOUBLE) / count(*)")
_grouped("min", lambda: agg.min_of(F.col("q")), "min(q)")
_grouped("max", lambda: agg.max_of(F.col("q")), "max(q)")


@query(f"WITH {_LI}, r AS (SELECT l_suppkey, q, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC) AS rank FROM li) SELECT l_suppkey, q, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def group_by_topk(spark, sf_dir):
    return agg.top_rows(_li(spark, sf_dir), ["l_suppkey"], "q", 3)


@query("SELECT DISTINCT l_returnflag, l_linestatus AS member FROM lineitem")
def group_by_collect(spark, sf_dir):
    got = agg.group_by(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), ["l_returnflag"], agg.collect_to_set(["l_linestatus"]))
    return got.select("l_returnflag", F.explode("members").alias("m")).select("l_returnflag", F.col("m.l_linestatus").alias("member"))


@query(f"WITH {_LI} SELECT 'global' AS key, count(*) AS count, CAST(sum(q) AS BIGINT) AS sum FROM li")
def group_by_global(spark, sf_dir):
    return agg.group_global(_li(spark, sf_dir), agg.count(), agg.sum_of(F.col("q")))


@query("SELECT 'global' AS key, count(*) AS count FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
def group_by_global_empty(spark, sf_dir):
    """A group without elements does not exist."""
    return agg.group_global(table(spark, sf_dir, "orders").filter("o_totalprice < 0").select("o_orderkey"), agg.count())


@query("SELECT user_id, max(event_id) AS top FROM events GROUP BY user_id")
def mergeable_max(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return agg.mergeable_group_by([e.filter(F.pmod("event_id", F.lit(3)) == r) for r in range(3)], ["user_id"], {"top": F.max("event_id")}, {"top": F.max("top")})


@query(f"WITH {_LI} SELECT l_suppkey, CAST(sum(q) AS BIGINT) AS sum FROM li GROUP BY 1")
def partitioned_sum(spark, sf_dir):
    return agg.partitioned_group_by(_li(spark, sf_dir), ["l_suppkey"], int(spark.conf.get("spark.sql.shuffle.partitions")), agg.sum_of(F.col("q")))


# --- windows ---

_AT = "t AS (SELECT epoch_us(ts) // 1000000 AS at_s, event_id % 100 AS v FROM events)"


def _timed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", epoch_seconds(F.col("ts")).alias("at_s"), F.pmod("event_id", F.lit(100)).alias("v"))


@query(f"WITH {_AT} SELECT at_s - ((at_s % 3600) + 3600) % 3600 AS start, CAST(sum(v) AS BIGINT) AS sum FROM t GROUP BY 1")
def tumbling_window(spark, sf_dir):
    rows = _timed(spark, sf_dir).withColumn("start", tumbling_start(F.col("at_s"), 3600))
    return agg.group_by(rows, ["start"], agg.sum_of(F.col("v")), unique=True)


@query(f"""WITH {_AT}, w AS (SELECT unnest(range(at_s - at_s % 1800 - 1800, at_s + 1, 1800)) AS start, at_s, v FROM t)
SELECT start, CAST(sum(v) AS BIGINT) AS sum FROM w WHERE start <= at_s AND at_s < start + 3600 GROUP BY 1""")
def sliding_window(spark, sf_dir):
    rows = _timed(spark, sf_dir).withColumn("start", F.explode(sliding_starts(F.col("at_s"), 3600, 1800)))
    return agg.group_by(rows, ["start"], agg.sum_of(F.col("v")), unique=True)


# --- interest, functions, feeds ---


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey >= 100 AND o_orderkey < 900) OR o_orderkey >= 5000")
def interest_ranges(spark, sf_dir):
    return Ranges([(100, 900), (5000, None)]).within(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 8 IN (1, 5) AND NOT (o_orderkey < 1000)")
def interest_slots(spark, sf_dir):
    return (Slots(8, [1, 5]) & ~Ranges([(None, 1000)])).within(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"))


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS is_f, o_totalprice > 200000 AS big, o_totalprice < 50000 AS small, o_orderkey % 3 = 1 AS one_of_three,
o_orderkey % 2 = 1 AS is_odd, concat(CAST(o_orderkey AS VARCHAR), '!') AS called, o_custkey + 7 AS moved FROM orders""")
def catalog_functions(spark, sf_dir):
    c, key = catalog, F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        c.eq(F.col("o_orderstatus"), "F").alias("is_f"),
        c.gt(F.col("o_totalprice"), 200000).alias("big"),
        c.lt(F.col("o_totalprice"), 50000).alias("small"),
        c.mod_eq(key, 3, 1).alias("one_of_three"),
        c.odd(key).alias("is_odd"),
        c.concat(key, "!").alias("called"),
        c.add(F.col("o_custkey"), 7).alias("moved"),
    )


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def state_search(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(catalog.found_in("RING", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_property(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {COMMANDS} SELECT k AS key, field, value FROM (SELECT k, 'state' AS field, arg_max(v, seq) AS value, arg_max(gone, seq) AS g FROM e GROUP BY k) WHERE NOT g")
def change_feed_mirror(spark, sf_dir):
    e = commands(spark, sf_dir)
    rows = e.select(F.col("seq").alias("commit_height"), F.lit(0).alias("ordinal"), F.col("k").alias("key"), F.lit("state").alias("column"), F.lit(None).cast("string").alias("old"), F.when(~F.col("gone"), F.col("v")).alias("new"), F.when(F.col("gone"), "removed").otherwise("modified").alias("diff_type"))
    return feeds.mirror(feeds.change_feed(rows))


@query(f"""WITH {COMMANDS}, f AS (SELECT k, CASE WHEN NOT gone THEN v END AS new, seq FROM e), g AS (SELECT *, lag(new) OVER (PARTITION BY k ORDER BY seq) AS old FROM f)
SELECT k AS key, old, new, seq FROM g WHERE old IS DISTINCT FROM new""")
def effective_changes(spark, sf_dir):
    """Changes that change something: equal writes and removals of nothing are silent."""
    e = commands(spark, sf_dir).select(F.col("k").alias("key"), F.lit("state").alias("field"), F.col("v").alias("value"), "seq", F.col("gone").alias("removed"))
    return feeds.field_changes(e).drop("field")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount <= 0.05)")
def invariant_violations(spark, sf_dir):
    return invariants.violations(table(spark, sf_dir, "lineitem"), F.col("l_discount") <= 0.05).select("l_orderkey", "l_linenumber")


# --- composite programs ---

_SKILLS = """c AS (SELECT DISTINCT l_suppkey AS candidate, p_brand AS skill FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45),
j AS (SELECT DISTINCT o_custkey AS job, p_brand AS skill FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_totalprice > 400000)"""


#: The same sets from all line items and orders.
_ALL_SKILLS = """c AS (SELECT DISTINCT l_suppkey AS candidate, p_brand AS skill FROM lineitem JOIN part ON l_partkey = p_partkey),
j AS (SELECT DISTINCT o_custkey AS job, p_brand AS skill FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""


def _skills(spark, sf_dir, node: str, had: str = "true", wanted: str = "true"):
    """A node of the skill graph over the line items that ``had`` and the orders that ``wanted`` take."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("skill")), F.col("l_partkey") == F.col("p_partkey"))
    cand = li.filter(had).select(F.col("l_suppkey").alias("candidate"), "skill").distinct()
    jobs = table(spark, sf_dir, "orders").filter(wanted).join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("job"), "skill").distinct()
    return composites.skill_graph().only(node).apply(candidate_skills=cand, job_skills=jobs)[node]


@query(f"""WITH {_ALL_SKILLS}, m AS (SELECT candidate, job, count(*) AS matched FROM c JOIN j USING (skill) GROUP BY ALL), r AS (SELECT job, count(*) AS required FROM j GROUP BY job)
SELECT candidate, job, matched, coalesce(required, 0) AS required, matched = coalesce(required, 0) AND coalesce(required, 0) > 0 AS qualified FROM m LEFT JOIN r USING (job)""")
def qualification(spark, sf_dir):
    return _skills(spark, sf_dir, "qualification")


@query("""WITH p AS (SELECT p_partkey, concat_ws('/', p_brand, p_type, p_size) AS skill FROM part),
c AS (SELECT DISTINCT l_suppkey AS candidate, skill FROM lineitem JOIN p ON l_partkey = p_partkey WHERE l_quantity >= 50),
j AS (SELECT DISTINCT o_custkey AS job, skill FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN p ON l_partkey = p_partkey WHERE o_totalprice > 400000)
SELECT job, skill FROM j WHERE skill NOT IN (SELECT skill FROM c)""")
def skill_gap(spark, sf_dir):
    """Finer skills than above, so that some are wanted and not had."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("skill"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    cand = li.filter("l_quantity >= 50").select(F.col("l_suppkey").alias("candidate"), "skill").distinct()
    jobs = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("job"), "skill").distinct()
    return composites.skill_graph().only("gap").apply(candidate_skills=cand, job_skills=jobs)["gap"]


@query(f"""WITH {_SKILLS}, s AS (SELECT skill, count(*) AS v FROM c GROUP BY skill), d AS (SELECT skill, count(*) AS w FROM j GROUP BY skill)
SELECT coalesce(s.skill, d.skill) AS skill, coalesce(v, 0) AS supply, coalesce(w, 0) AS demand, coalesce(w, 0) > coalesce(v, 0) AS scarce FROM s FULL OUTER JOIN d ON s.skill IS NOT DISTINCT FROM d.skill""")
def market(spark, sf_dir):
    return _skills(spark, sf_dir, "market", "l_quantity >= 45", "o_totalprice > 400000")


def _slots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(3)).alias("p"), F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"))
    return composites.slot_graph(3).apply(**{f"person_{i}": e.filter(F.col("p") == i).select("day", "hour") for i in range(3)})


_COMMON = "s AS (SELECT DISTINCT user_id % 3 AS p, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour FROM events), q AS (SELECT day, hour, count(*) AS n FROM s GROUP BY day, hour)"


@query(f"WITH {_COMMON} SELECT day, count(*) AS slots FROM q WHERE n >= 3 AND hour BETWEEN 9 AND 17 GROUP BY day")
def slot_common_by_day(spark, sf_dir):
    return _slots(spark, sf_dir)["by_day"]


@query(f"WITH {_COMMON} SELECT day, hour FROM q WHERE n >= 2")
def slot_near_miss(spark, sf_dir):
    return _slots(spark, sf_dir)["near_miss"]


_PREFS = "p AS (SELECT DISTINCT o_custkey AS agent, o_orderkey % 40 AS winner, (o_orderkey * 7 + o_custkey) % 40 AS loser FROM orders WHERE o_orderkey % 40 <> (o_orderkey * 7 + o_custkey) % 40)"
_SIGNS = f"{_PREFS}, s AS (SELECT winner AS item, agent, loser AS opponent, 1 AS sign FROM p UNION ALL SELECT loser, agent, winner, -1 FROM p)"


def prefs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w, l = F.pmod("o_orderkey", F.lit(40)), F.pmod(F.col("o_orderkey") * 7 + F.col("o_custkey"), F.lit(40))
    return o.select(F.col("o_custkey").alias("agent"), w.alias("winner"), l.alias("loser"), F.col("o_orderkey").alias("seq")).filter("winner <> loser")


@query(f"WITH {_SIGNS} SELECT item, CAST(sum(sign) AS DOUBLE) / count(*) AS score FROM s GROUP BY item")
def mean_of_signs(spark, sf_dir):
    return ranking.mean_of_signs(prefs(spark, sf_dir).drop("seq"))


@query(f"""WITH {_SIGNS}, g AS (SELECT item, CAST(sum(CASE WHEN sign > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS w, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY item)
SELECT item, round((w / n + 3.8416 / (2 * n) - 1.96 * sqrt(w / n * (1 - w / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS score FROM g""")
def wilson_rank(spark, sf_dir):
    return ranking.wilson_rank(prefs(spark, sf_dir).drop("seq")).withColumn("score", F.round("score", 9))


@query(f"""WITH {_SIGNS}, a AS (SELECT item, sum(sign) AS x, count(*) AS n FROM s GROUP BY item), i AS (SELECT count(*) AS n FROM a),
m AS (SELECT item, CAST(x AS DOUBLE) / n AS score FROM a), v AS (SELECT item, CAST(n AS DOUBLE) AS score FROM a WHERE n % 2 = 0),
r AS (SELECT item, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM m
UNION ALL SELECT item, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 FROM (SELECT m.item, coalesce(v.score, CAST('-Infinity' AS DOUBLE)) AS score FROM m LEFT JOIN v USING (item)))
SELECT item, round(sum((i.n - r) / greatest(i.n - 1.0, 1.0)) / 2.0, 9) AS score FROM r, i GROUP BY item""")
def borda_rank(spark, sf_dir):
    """Mean signs and, for items with an even number of games, how many there are; the others come last there."""
    signs = ranking.contributions(prefs(spark, sf_dir).drop("seq"))
    games = signs.groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("score")).filter("score % 2 = 0")
    return ranking.borda([ranking.mean_of_signs(prefs(spark, sf_dir).drop("seq")), games]).withColumn("score", F.round("score", 9))


@query(f"""WITH {_SIGNS}, v AS (SELECT l_suppkey % 37 + 5 AS item, CAST(sum(l_linenumber % 7) AS DOUBLE) / count(*) AS a FROM lineitem GROUP BY 1),
b AS (SELECT item, CAST(sum(sign) AS DOUBLE) / count(*) AS p FROM s GROUP BY item),
f AS (SELECT coalesce(v.item, b.item) AS item, coalesce(0.7 * (a / 6.0) + 0.3 * ((p + 1.0) / 2.0), a / 6.0, (p + 1.0) / 2.0) AS x FROM v FULL OUTER JOIN b ON v.item = b.item)
SELECT item, round(x, 9) AS score, CASE WHEN x >= 0.85 THEN 'S' WHEN x >= 0.7 THEN 'A' WHEN x >= 0.55 THEN 'B' WHEN x >= 0.4 THEN 'C' WHEN x >= 0.25 THEN 'D' WHEN x >= 0.1 THEN 'E' ELSE 'F' END AS tier FROM f""")
def tier_fusion(spark, sf_dir):
    # items 0 to 4 have preferences alone, 40 and 41 valuations alone
    li = table(spark, sf_dir, "lineitem")
    valuations = li.select(F.col("l_orderkey").alias("agent"), F.col("l_linenumber").alias("line"), (F.pmod("l_suppkey", F.lit(37)) + 5).alias("item"), F.pmod("l_linenumber", F.lit(7)).cast("long").alias("score"))
    signs = ranking.contributions(prefs(spark, sf_dir).drop("seq"))
    means = agg.group_by(valuations, ["item"], agg.avg_of(F.col("score"), "v"), unique=True)
    pairs = agg.group_by(signs, ["item"], agg.avg_of(F.col("sign"), "p"), unique=True)
    both = joins.combine_latest(means, pairs, "item", {"score": composites.fused(F.col("l"), F.col("r"))}, required="score")
    return both.select("item", F.round("score", 9).alias("score"), composites.tier(F.col("score")).alias("tier"))


@query("""WITH i AS (SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status,
CASE WHEN o_orderkey % 9 = 0 THEN 'gate' ELSE 'task' END AS kind, o_orderkey % 13 = 0 AS pinned FROM orders),
d AS (SELECT o_orderkey AS key, o_orderkey * 3 % 1000 AS depends_on FROM orders WHERE o_orderkey % 4 <> 0)
SELECT key FROM i WHERE status IN ('open', 'in_progress') AND NOT pinned AND kind <> 'gate' AND NOT EXISTS
(SELECT 1 FROM d JOIN i b ON d.depends_on = b.key WHERE d.key = i.key AND b.status NOT IN ('closed', 'pinned'))""")
def ready_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", '"closed"').when(F.col("o_orderstatus") == "O", '"open"').otherwise('"in_progress"')
    kind = F.when(F.col("key") % 9 == 0, '"gate"').otherwise('"task"')
    pinned = F.when(F.col("key") % 13 == 0, "1").otherwise("0")
    fields = o.select("key", F.explode(F.create_map(F.lit("status"), status, F.lit("issue_type"), kind, F.lit("pinned"), pinned)).alias("field", "value"))
    edges = o.select("key", F.pmod(F.col("key") * 3, F.lit(1000)).alias("depends_on"), F.when(F.col("key") % 4 == 0, "related").otherwise("blocks").alias("type"))
    return composites.ready_set(fields, edges)


@query()
def bradley_terry(spark, sf_dir):
    return ranking.bradley_terry(prefs(spark, sf_dir).drop("seq"), tol=1e-6)


def _ordered(engine: str):
    made = lambda spark, sf_dir: ranking.ordered_rating(prefs(spark, sf_dir).withColumn("board", F.pmod("agent", F.lit(16))), engine, "seq", "board")
    made.__name__ = engine
    return query()(made)


for _engine in ranking.ENGINES:
    _ordered(_engine)


@query()
def dfquad(spark, sf_dir):
    """Claims are nations; edges between them are derived from suppliers and are claims too."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("claim"))
    s = table(spark, sf_dir, "supplier")
    edges = s.select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("edge"),
        F.concat(F.lit("n"), F.col("s_nationkey")).alias("source"),
        F.concat(F.lit("n"), F.pmod(F.col("s_suppkey") * 5, F.lit(25))).alias("target"),
        (F.col("s_acctbal") > 0).alias("support"),
    ).filter("source <> target")
    stances = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("claim"), (F.pmod("c_custkey", F.lit(101)) / 100.0).alias("value"))
    claims = n.unionByName(edges.select(F.col("edge").alias("claim")))
    return credences(claims, stances, edges, eps=1e-6)


from deltaview.plans import registry_waves  # noqa: E402, F401  its queries register themselves here
