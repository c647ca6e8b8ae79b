"""Queries of waves, placement and intake, with their SQL. Arms, members and shards are derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaview.functions import catalog
from deltaview.operators import sets, waves
from deltaview.plans.registry import query, table
from deltaview.sources import placement
from deltaview.streaming import intake

#: Three arms a day; what an arm delivered ends at its last view, arm 1 stalls and arm 2 has ended on even days.
_PROGRESS = """e AS (SELECT event_id, user_id, event_type, CAST(day(ts) AS INTEGER) AS day, event_id % 3 AS arm FROM events),
p AS (SELECT day, arm, max(CASE WHEN event_type = 'view' THEN event_id END) AS through,
CASE WHEN arm = 1 THEN 'stalled' WHEN arm = 2 AND day % 2 = 0 THEN 'ended' ELSE 'live' END AS state FROM e GROUP BY day, arm)"""


def _frontier(states: str) -> str:
    return f"f AS (SELECT day, coalesce(min(CASE WHEN state IN ({states}) THEN coalesce(through, -9223372036854775808) END), 9223372036854775807) AS frontier FROM p GROUP BY day)"


def _waves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.dayofmonth("ts").alias("day"), F.pmod("event_id", F.lit(3)).alias("arm"))
    state = F.when(F.col("arm") == 1, waves.STALLED).when((F.col("arm") == 2) & (F.col("day") % 2 == 0), waves.ENDED).otherwise(waves.LIVE)
    progress = e.groupBy("day", "arm").agg(F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).alias("through")).withColumn("state", state)
    return e, progress


@query(f"WITH {_PROGRESS}, {_frontier("'live', 'stalled'")} SELECT event_id, day FROM e JOIN f USING (day) WHERE event_id <= frontier")
def wave_wait(spark, sf_dir):
    e, progress = _waves(spark, sf_dir)
    return waves.released(e.select("event_id", "day"), "event_id", waves.settled(progress, waves.WAIT, ["day"]), ["day"])


@query(f"WITH {_PROGRESS}, {_frontier("'live'")} SELECT event_id, day FROM e JOIN f USING (day) WHERE event_id <= frontier")
def wave_degrade(spark, sf_dir):
    e, progress = _waves(spark, sf_dir)
    return waves.released(e.select("event_id", "day"), "event_id", waves.settled(progress, waves.DEGRADE, ["day"]), ["day"])


@query(f"""WITH {_PROGRESS}, {_frontier("'live', 'stalled'")}, r AS (SELECT e.* FROM e JOIN f USING (day) WHERE event_id <= frontier)
SELECT event_id, user_id, day FROM r l WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM r x WHERE x.event_type = 'purchase' AND x.user_id = l.user_id)""")
def semi_join_on_frontier(spark, sf_dir):
    e, progress = _waves(spark, sf_dir)
    frontier = waves.settled(progress, waves.WAIT, ["day"])
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "day")
    buys = e.filter("event_type = 'purchase'").select("event_id", "day", F.col("user_id").alias("buyer"))
    return waves.semi_join_on_frontier(clicks, buys, ["user_id"], ["buyer"], "event_id", frontier, ["day"])


#: Four members of eight slots: 0 and 1 share the even ones, 2 and 3 hold two odd ones each. Member 3 never reports signups.
_MEMBERS = [(0, [0, 2, 4, 6], waves.LIVE), (1, [0, 2, 4, 6], waves.STALLED), (2, [1, 3], waves.LIVE), (3, [5, 7], waves.LIVE)]
_QUORUM = """m(member, slot, state) AS (VALUES (0, 0, 'live'), (0, 2, 'live'), (0, 4, 'live'), (0, 6, 'live'), (1, 0, 'stalled'), (1, 2, 'stalled'), (1, 4, 'stalled'), (1, 6, 'stalled'), (2, 1, 'live'), (2, 3, 'live'), (3, 5, 'live'), (3, 7, 'live')),
t AS (SELECT event_id % 4 AS member, event_type AS source, max(event_id) AS through FROM events WHERE NOT (event_id % 4 = 3 AND event_type = 'signup') GROUP BY ALL)"""


@query(f"""WITH {_QUORUM}, q AS (SELECT slot, source, min(through) AS frontier FROM m JOIN t USING (member) GROUP BY slot, source
HAVING count(*) = (SELECT count(*) FROM m n WHERE n.slot = m.slot))
SELECT event_id FROM events JOIN q ON user_id % 8 = slot AND event_type = source WHERE event_id <= frontier""")
def replica_quorum(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    member = F.pmod("event_id", F.lit(4))
    reports = e.select(member.alias("member"), F.col("event_type").alias("source"), F.col("event_id").alias("through")).filter("NOT (member = 3 AND source = 'signup')")
    members = spark.createDataFrame(_MEMBERS, "member long, slots array<long>, state string")
    return waves.quorum_released(e, F.pmod("user_id", F.lit(8)), "event_type", "event_id", waves.quorum(members, reports)).select("event_id")


#: Two epochs of slots for three shards: the second moves slots 2 and 5.
_OLD = [("s0", 1, [0, 1, 2]), ("s1", 1, [3, 4, 5]), ("s2", 1, [6, 7])]
_NEW = [("s0", 2, [0, 1, 5]), ("s1", 2, [2, 3, 4]), ("s2", 2, [6, 7])]
_TABLE = "instance string, epoch long, slots array<long>"


@query("""WITH h(instance, slot) AS (VALUES ('s0', 0), ('s0', 1), ('s0', 5), ('s1', 2), ('s1', 3), ('s1', 4), ('s2', 6), ('s2', 7))
SELECT instance, user_id, count(*) AS events FROM events JOIN h ON user_id % 8 = slot GROUP BY ALL""")
def shard_set(spark, sf_dir):
    """Rows routed under the old table, the state replayed under the new one: each counts once, where its slot is now."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    slot = F.pmod("user_id", F.lit(8))
    old, new = (spark.createDataFrame(rows, _TABLE) for rows in (_OLD, _NEW))
    current = placement.assignments(old.unionByName(new).unionByName(old))
    routed = placement.route(e, slot, old).unionByName(placement.route(e, slot, current))
    return placement.admitted(routed, slot, current).groupBy("instance", "user_id").agg(F.count(F.lit(1)).alias("events"))


@query("""WITH r AS (SELECT user_id % 11 AS instance, CAST(day(ts) AS INTEGER) % 3 AS epoch, event_id % 8 AS slot FROM events),
t AS (SELECT instance, max(epoch) AS epoch FROM r GROUP BY instance)
SELECT slot, count(DISTINCT instance) AS instances FROM r JOIN t USING (instance, epoch) GROUP BY slot HAVING count(DISTINCT instance) > 1""")
def instance_set(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reports = e.select(F.pmod("user_id", F.lit(11)).alias("instance"), (F.dayofmonth("ts") % 3).alias("epoch"), F.array(F.pmod("event_id", F.lit(8))).alias("slots"))
    return placement.contested(placement.assignments(reports))


@query("""WITH e AS (SELECT event_id, user_id % 16 AS port, event_type FROM events),
s AS (SELECT event_id, port, event_type, last_value(CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY port ORDER BY event_id) AS green,
min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY port ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM e)
SELECT event_id, port, CASE WHEN coalesce(green, false) THEN event_id ELSE next END AS released FROM s WHERE event_type NOT IN ('signup', 'error')""")
def traffic_light(spark, sf_dir):
    """A signup turns its port green and an error turns it red."""
    e = table(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(16)).alias("port"), "event_type")
    lights = e.filter("event_type IN ('signup', 'error')").select("event_id", "port", (F.col("event_type") == "signup").alias("green"))
    return intake.traffic_light(e.filter("event_type NOT IN ('signup', 'error')").select("event_id", "port"), lights, "port", "event_id")


@query("""WITH d AS (SELECT event_id, user_id % 16 AS port, (event_id * 7) % 23 AS depth FROM events)
SELECT event_id, port, coalesce(last_value(CASE WHEN depth >= 18 THEN true WHEN depth <= 4 THEN false END IGNORE NULLS) OVER (PARTITION BY port ORDER BY event_id), false) AS saturated FROM d""")
def intake_saturation(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(16)).alias("port"), F.pmod(F.col("event_id") * 7, F.lit(23)).alias("depth"))
    return intake.saturation(d, ["port"], "event_id", F.col("depth"), 18, 4).drop("depth")


@query("SELECT DISTINCT o_custkey % 100 AS key, o_orderkey AS element FROM orders")
def key_by(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("element"))
    return sets.key_by(o, F.pmod("o_custkey", F.lit(100)), "key").select("key", "element")


@query("SELECT n_nationkey AS same, CAST(n_nationkey AS VARCHAR) AS k, n_name AS v, CAST(n_nationkey AS VARCHAR) AS alone FROM nation")
def identity_key_of_value_of(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    entry = F.array(key, F.col("n_name"))
    return n.select(catalog.identity(F.col("n_nationkey")).alias("same"), catalog.key_of(entry).alias("k"), catalog.value_of(entry).alias("v"), catalog.value_of(F.array(key)).alias("alone"))
