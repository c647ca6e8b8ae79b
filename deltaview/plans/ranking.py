"""Rankings from pairwise preferences (agent, winner, loser).

Mean of signs, Wilson and Borda are closed forms. Bradley-Terry is a damped fixpoint. Elo, TrueSkill,
Glicko and Weng-Lin depend on the order of games, which a sequence column fixes; they are replayed
for each board as they stream by, as no game of a board can be rated before those that precede it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.operators.aggregates import group_by, wilson
from deltaview.plans.iterate import written
from deltaview.session import ship


def contributions(prefs: DataFrame) -> DataFrame:
    """Each preference counts +1 for its winner and -1 for its loser: item, agent, opponent, sign."""
    sides = F.array(
        F.struct(F.col("winner").alias("item"), "agent", F.col("loser").alias("opponent"), F.lit(1).cast("long").alias("sign")),
        F.struct(F.col("loser").alias("item"), "agent", F.col("winner").alias("opponent"), F.lit(-1).cast("long").alias("sign")),
    )
    return prefs.distinct().select(F.explode(sides).alias("s")).select("s.*")


def mean_of_signs(prefs: DataFrame) -> DataFrame:
    return contributions(prefs).groupBy("item").agg((F.sum("sign").cast("double") / F.count(F.lit(1))).alias("score"))


def wilson_rank(prefs: DataFrame, z: float = 1.96) -> DataFrame:
    return group_by(contributions(prefs), ["item"], wilson(F.col("sign") > 0, "score", z))


def borda(ratings: Sequence[DataFrame]) -> DataFrame:
    """Mean over sources of (n - rank) / (n - 1); ties share the mean rank, items a source lacks come last together.

    Ranks come from counts by score in stretches of scores, so that no window holds all items.
    """
    items = ratings[0].select("item")
    for r in ratings[1:]:
        items = items.unionByName(r.select("item"))
    items = written(items.distinct())
    n = items.count()
    points = None
    for r in ratings:
        scored = items.join(r.select(F.col("item").alias("ri"), "score"), F.col("item") == F.col("ri"), "left").select("item", F.coalesce("score", F.lit(float("-inf"))).alias("score"))
        scored = written(scored)
        by_score = written(scored.groupBy("score").agg(F.count(F.lit(1)).alias("m")))
        ranks = _places(by_score)
        got = scored.join(ranks, F.col("score") == F.col("s")).select("item", ((F.lit(float(n)) - F.col("rank")) / F.lit(max(n - 1.0, 1.0))).alias("p"))
        points = got if points is None else points.unionByName(got)
    return points.groupBy("item").agg((F.sum("p") / F.lit(float(len(ratings)))).alias("score"))


#: Stretches of scores whose items are ranked apart.
STRETCHES = 64


def _places(by_score: DataFrame) -> DataFrame:
    """by_score: score, m (items of that score). s, rank: the mean place of a score's items, the best score first."""
    finite = by_score.filter(F.col("score") > F.lit(float("-inf")))
    bounds = sorted(set(finite.approxQuantile("score", [i / STRETCHES for i in range(1, STRETCHES)], 0.01)))  # fewer than STRETCHES
    stretch = F.lit(0)
    for b in bounds:
        stretch = stretch + (F.col("score") < F.lit(b)).cast("int")
    rows = by_score.withColumn("stretch", stretch)
    inside = W.partitionBy("stretch").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("stretch").alias("t")).agg(F.sum("m").alias("held"))  # a row for each stretch
    before = F.coalesce(F.sum("held").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("t", before.alias("before"))
    out = rows.withColumn("above", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(sums, F.col("stretch") == F.col("t"))
    return out.select(F.col("score").alias("s"), (F.col("before") + F.col("above") + (F.col("m") + 1) / 2.0).alias("rank"))


def bradley_terry(prefs: DataFrame, prior: float = 0.5, tol: float = 1e-9, most_laps: int = 1000) -> DataFrame:
    """item, score: strengths of geometric mean 1. ``prior`` is a virtual win and loss against a strength of 1.

    A lap is a join of the pairs with both strengths; the pairs are counted once and reused.
    """
    games = prefs.distinct().groupBy("winner", "loser").agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = games.select(F.col("winner").alias("i"), F.col("loser").alias("j"), "n", F.col("n").alias("won"))
    both = both.unionByName(games.select(F.col("loser").alias("i"), F.col("winner").alias("j"), "n", F.lit(0.0).alias("won")))
    pairs = written(both.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("won").alias("won")))
    now = written(pairs.groupBy("i").agg(F.sum("won").alias("wins")).select(F.col("i").alias("item"), "wins", F.lit(1.0).alias("s")))
    for _ in range(most_laps):
        a = now.select(F.col("item").alias("ai"), "wins", F.col("s").alias("si"))
        b = now.select(F.col("item").alias("bi"), F.col("s").alias("sj"))
        den = pairs.join(a, F.col("i") == F.col("ai")).join(b, F.col("j") == F.col("bi")).groupBy("ai", "wins", "si").agg(F.sum(F.col("n") / (F.col("si") + F.col("sj"))).alias("d"))
        new = den.select(F.col("ai").alias("item"), "wins", ((F.col("wins") + prior) / (F.col("d") + 2 * prior / (F.col("si") + 1.0))).alias("s"), "si")
        new = written(new)
        moved = new.agg(F.max(F.abs(F.col("s") - F.col("si")) / F.col("si"))).first()[0]
        now = new.select("item", "wins", "s")
        if moved is None or moved < tol:
            break
    scale = now.agg(F.exp(F.avg(F.log("s")))).first()[0]
    return now.select("item", (F.col("s") / F.lit(scale if scale else 1.0)).alias("score"))


# --- order-dependent ratings: each has a start state, a game and a score ---

Game = Callable[[tuple, tuple], tuple[tuple, tuple]]


def _elo(k: float = 32.0, base: float = 1000.0):
    def game(w, l):
        gain = k * (1.0 - 1.0 / (1.0 + 10.0 ** ((l[0] - w[0]) / 400.0)))
        return (w[0] + gain,), (l[0] - gain,)

    return (base,), game, lambda s: s[0]


def normal_cdf(x: float) -> float:
    """Fixed coefficients of Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7."""
    a = abs(x / math.sqrt(2.0))
    t = 1.0 / (1.0 + 0.3275911 * a)
    series = sum(c * t ** (i + 1) for i, c in enumerate((0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)))
    erf = math.copysign(1.0 - series * math.exp(-a * a), x)
    return 0.5 * (1.0 + erf)


def _trueskill(mu0: float = 25.0, sigma0: float = 25.0 / 3, beta: float = 25.0 / 6):
    def game(w, l):
        spread = 2 * beta**2 + w[1] + l[1]
        t = (w[0] - l[0]) / math.sqrt(spread)
        likely = normal_cdf(t)
        shift = -t if likely < 1e-10 else math.exp(-t * t / 2) / math.sqrt(2 * math.pi) / likely
        shrink = shift * (shift + t)

        def moved(s, sign):
            return s[0] + sign * s[1] / math.sqrt(spread) * shift, s[1] * max(1 - s[1] / spread * shrink, 1e-6)

        return moved(w, 1), moved(l, -1)

    return (mu0, sigma0**2), game, lambda s: s[0] - 3 * math.sqrt(s[1])


def _glicko(base: float = 1500.0, deviation: float = 350.0):
    q = math.log(10.0) / 400.0

    def moved(me, other, result):
        g = 1.0 / math.sqrt(1.0 + 3.0 * (q * other[1] / math.pi) ** 2)
        e = 1.0 / (1.0 + 10.0 ** (-g * (me[0] - other[0]) / 400.0))
        precision = 1.0 / me[1] ** 2 + (q * g) ** 2 * e * (1 - e)
        return me[0] + q / precision * g * (result - e), math.sqrt(1.0 / precision)

    return (base, deviation), lambda w, l: (moved(w, l, 1.0), moved(l, w, 0.0)), lambda s: s[0] - 2 * s[1]


def _weng_lin(mu0: float = 25.0, sigma0: float = 25.0 / 3, beta: float = 25.0 / 6, kappa: float = 1e-4):
    def game(w, l):
        c2 = w[1] + l[1] + 2 * beta**2
        c = math.sqrt(c2)
        win = 1.0 / (1.0 + math.exp((l[0] - w[0]) / c))

        def moved(s, sign):
            return s[0] + sign * s[1] / c * (1 - win), s[1] * max(1 - s[1] / c2 * win * (1 - win), kappa)

        return moved(w, 1), moved(l, -1)

    return (mu0, sigma0**2), game, lambda s: s[0] - 3 * math.sqrt(s[1])


ENGINES = {"elo": _elo, "trueskill": _trueskill, "glicko": _glicko, "weng_lin": _weng_lin}


class Replay:
    """Ratings that take games (winner, loser) one at a time; it holds a state an item."""

    def __init__(self, engine: str, **parameters):
        self.start, self.game, self.score = ENGINES[engine](**parameters)
        self.state: dict = {}

    def play(self, winner, loser) -> None:
        state, start = self.state, self.start
        state[winner], state[loser] = self.game(state.get(winner, start), state.get(loser, start))

    def scores(self) -> dict:
        return {item: self.score(s) for item, s in self.state.items()}


def replay(games: Iterable[tuple], engine: str, **parameters) -> dict:
    """Scores after games (winner, loser) in order."""
    ratings = Replay(engine, **parameters)
    for winner, loser in games:
        ratings.play(winner, loser)
    return ratings.scores()


def ordered_rating(prefs: DataFrame, engine: str, seq: str, board: str | None = None, **parameters) -> DataFrame:
    """item, score (and board) by replay in order of seq. A retracted game is one that is not among the rows.

    Spark sorts the games, on disk where they are many, and a board's pass by in batches: a worker holds
    one batch and the states of one board's items. Games of one place go by winner and loser, those
    without a place come last.
    """
    ship(prefs.sparkSession)
    rows = prefs if board else prefs.withColumn("_board", F.lit(0))
    by = board or "_board"
    games = rows.select(by, seq, "winner", "loser").repartition(by)
    games = games.sortWithinPartitions(by, F.asc_nulls_last(seq), "winner", "loser").select(by, "winner", "loser")
    out_schema = T.StructType([games.schema[by], T.StructField("item", games.schema["winner"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        def rated(key, ratings, types):
            scores = ratings.scores()
            cols = [pa.array([key] * len(scores), types[0]), pa.array(list(scores), types[1]), pa.array(list(scores.values()), pa.float64())]
            return pa.RecordBatch.from_arrays(cols, [by, "item", "score"])

        ratings, now, types = None, None, None
        for batch in batches:
            types = batch.schema.field(0).type, batch.schema.field(1).type
            for key, winner, loser in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ratings is None or key != now:
                    if ratings is not None:
                        yield rated(now, ratings, types)
                    ratings, now = Replay(engine, **parameters), key
                ratings.play(winner, loser)
        if ratings is not None:
            yield rated(now, ratings, types)

    out = games.mapInArrow(run, out_schema)
    return out if board else out.drop("_board")
