"""Mixing sources to target weights by temperature.

Token shares p_s of the sources become weights p_s^a / sum p^a. The exponent a in [0, 1] is the
largest one whose mixture meets the asked entropy (in nats) or keeps every source within the
repetition limit; it is found by bisection, all halvings of a round being one aggregate, so that
source tables of any size stay distributed. The budget is scaled so that the source that is
repeated least is read ``least_epochs`` times.

The weights are realised as budgeted block permutations: in each epoch the documents of a source
are dealt to hashed blocks, the blocks are permuted and the documents inside a block too. Whole
epochs are read in full; in the last one blocks are read in permuted order while their running
token sum stays within the budget, and only the block at the border is cut, document by document.
A document is told from others by its id, its text and, among rows that repeat both, a number, so the
mixture of the same rows is the same however they are stored.

Defined results: null and empty texts count one token, so that every document has a share; a null
source is a source of its own, a null id an id; repeated rows each count; an empty table gives an
empty result; the result's columns start with ``_mix_``, and columns of the input may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaview.llm._rows import marked, text_key
from deltaview.llm._store import Scratch

#: Tokens that a block of a source holds on average.
BLOCK_TOKENS = 1 << 18
#: Blocks that a source is dealt to at most; beyond that its blocks grow.
MOST_BLOCKS = 1 << 16
#: Exponents tried at once, and rounds: together a bisection to 1e-6.
POINTS, ROUNDS = 31, 4
SEED = 17
#: A table of this many blocks is broadcast at most: 40 bytes each.
BROADCAST_BLOCKS = 1 << 18


@dataclass(frozen=True)
class Target:
    """Either an entropy in nats, or the most times a document may be read (with least_epochs 1)."""

    entropy: float | None = None
    repetitions: float | None = None


def word_tokens(text: Column) -> Column:
    n = F.size(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), " "))
    return F.greatest(n, F.lit(1)).cast("long")


def exponent(shares: DataFrame, target: Target) -> float:
    """shares: one row per source with ``tokens``. The largest exponent in [0, 1] that meets the target."""
    log_t = F.log(F.col("tokens").cast("double"))
    top = shares.agg(F.max(log_t)).first()[0]
    if top is None:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / (POINTS + 1) for i in range(POINTS + 2)]
        aggs = []
        for i, a in enumerate(grid):
            # the shift by the largest log keeps the powers in range
            e = F.exp(F.lit(a) * (log_t - F.lit(top)))
            aggs += [F.sum(e).alias(f"z{i}"), F.sum(e * F.lit(a) * (log_t - F.lit(top))).alias(f"m{i}")]
            aggs += [F.max(e / F.exp(log_t - F.lit(top))).alias(f"x{i}"), F.min(e / F.exp(log_t - F.lit(top))).alias(f"n{i}")]
        row = shares.agg(*aggs).first()

        def meets(i: int, row=row) -> bool:
            z = row[f"z{i}"]
            if target.entropy is not None:
                # entropy falls as the exponent grows
                return math.log(z) - row[f"m{i}"] / z >= target.entropy - 1e-12
            return row[f"x{i}"] / row[f"n{i}"] <= target.repetitions + 1e-12

        # Entropy falls with the exponent, repetition too: an entropy wants a small exponent, a limit a large one.
        ok = [meets(i) for i in range(len(grid))]
        if target.entropy is not None:
            last = max((i for i, x in enumerate(ok) if x), default=None)
            if last is None:
                return 0.0
            if last == len(grid) - 1:
                return hi
            lo, hi = grid[last], grid[last + 1]
        else:
            first = min((i for i, x in enumerate(ok) if x), default=None)
            if first is None:
                return 1.0
            if first == 0:
                return lo
            lo, hi = grid[first - 1], grid[first]
    return lo if target.entropy is not None else hi


@dataclass
class Mixture:
    """A mixture as tables: what each source, each block of its last epoch and each document at its border gets."""

    #: id, source, tokens, key, rows: how many rows are that document.
    documents: DataFrame
    #: s, weight, whole (epochs read in full), blocks.
    plan: DataFrame
    #: bs, block, share: "all", "some" or "none" of the block is read in the last epoch.
    blocks: DataFrame
    #: id, source, key, number of the documents read of blocks with a share of "some".
    border: DataFrame
    seed: int

    def block(self, epoch: Column, row: list[Column]) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), epoch, *row), F.col("blocks")).cast("int")


def _numbered(documents: DataFrame) -> DataFrame:
    """A row for each row of a document: with its number, from 0. Two steps, as one array would hold a large group whole."""
    step = 4096
    tens = documents.withColumn("ten", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / step))))
    last = F.least(F.col("ten") * step + step, F.col("rows")) - 1
    return tens.withColumn("number", F.explode(F.sequence(F.col("ten") * step, last))).drop("ten", "rows")


def mixture(
    docs: DataFrame,
    target: Target,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    least_epochs: float = 1.0,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> Mixture:
    scratch = Scratch(docs.sparkSession, "mixing")
    col = lambda c: F.col(f"`{c}`")
    read = docs.select(col(id_col).alias("id"), col(source_col).alias("source"), word_tokens(col(text_col)).alias("tokens"), text_key(col(text_col)).alias("key"))
    documents = scratch.save(read.groupBy("id", "source", "tokens", "key").agg(F.count(F.lit(1)).alias("rows")), "documents")
    shares = scratch.save(documents.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("tokens") * F.col("rows")).alias("tokens")), "shares")
    a = exponent(shares, target)
    log_t = F.log(F.col("tokens").cast("double"))
    # epochs of a source are proportional to p^(a - 1); the least repeated one gets least_epochs
    top = shares.agg(F.max(log_t)).first()[0] or 0.0
    power, epochs = F.exp(F.lit(a) * (log_t - F.lit(top))), F.exp(F.lit(a - 1.0) * log_t)
    z, least = shares.agg(F.sum(power), F.min(epochs)).first()
    plan = shares.withColumn("epochs", epochs / F.lit(least) * least_epochs)
    # a hair is added, so that whole numbers of epochs survive rounding
    plan = plan.select(
        F.col("s"),
        (power / F.lit(z)).alias("weight"),
        F.floor(F.col("epochs") + 1e-9).cast("int").alias("whole"),
        F.floor(F.greatest(F.col("epochs") - F.floor(F.col("epochs") + 1e-9), F.lit(0.0)) * F.col("tokens")).cast("long").alias("rest"),
        F.greatest(F.ceil(F.col("tokens") / F.greatest(F.lit(block_tokens), F.col("tokens") / MOST_BLOCKS)), F.lit(1)).cast("int").alias("blocks"),
    )
    plan = scratch.save(plan, "plan")
    out = Mixture(documents, plan.drop("rest"), plan, plan, seed)
    row = [F.col(c) for c in ("id", "key", "number")]
    # sources are few against documents; a skewed source is split by the adaptive join
    part = _numbered(documents).join(plan.filter("rest > 0"), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", out.block(F.col("whole"), row))
    part = scratch.save(part.select("id", "source", "key", "number", "tokens", "block", "whole", "rest"), "last-epoch")
    # running sums over the permuted blocks, a table of MOST_BLOCKS rows a source at most
    sums = part.groupBy(F.col("source").alias("bs"), "block", "rest", "whole").agg(F.sum("tokens").alias("held")).withColumn("turn", F.xxhash64(F.lit(seed), F.lit("turn"), "whole", "block"))
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(W.partitionBy("bs").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    share = F.when(F.col("before") + F.col("held") <= F.col("rest"), "all").when(F.col("before") < F.col("rest"), "some").otherwise("none")
    sums = scratch.save(sums.select("bs", "block", "before", share.alias("share")), "blocks")
    edge = part.join(sums.filter("share = 'some'").withColumnRenamed("block", "b"), F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("b")))
    order = W.partitionBy("bs").orderBy(F.xxhash64(F.lit(seed), F.lit("row"), "whole", *row), *row).rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).filter("upto <= rest")
    out.blocks, out.border = sums.drop("before"), scratch.save(edge.select("id", "source", "key", "number"), "border")
    return out


def _last(rows: DataFrame, m: Mixture, row: list[Column]) -> DataFrame:
    """rows with plan and ``share`` of their block in the last epoch (null: the source has none)."""
    blocks = m.blocks.withColumnRenamed("block", "b")
    # the number of blocks is known before the join, so that rows need not move for a small table of them
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
    dealt = rows.join(m.plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", m.block(F.col("whole"), row))
    return dealt.join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("b")), "left")


def mix(docs: DataFrame, target: Target, **options) -> DataFrame:
    """One row per reading of a document: _mix_id, _mix_source, _mix_tokens, _mix_epoch, _mix_block, _mix_weight, _mix_number."""
    m = mixture(docs, target, **options)
    row = [F.col(c) for c in ("id", "key", "number")]
    rows = _numbered(m.documents)
    whole = rows.join(m.plan.filter("whole > 0"), F.col("source").eqNullSafe(F.col("s"))).withColumn("epoch", F.explode(F.expr("sequence(0, whole - 1)"))).withColumn("block", m.block(F.col("epoch"), row))
    last = _last(rows, m, row).withColumn("epoch", F.col("whole"))
    border = m.border.select(*[F.col(c).alias(f"b_{c}") for c in m.border.columns])
    edge = last.filter("share = 'some'").join(border, _same(["id", "source", "key", "number"], "b_"), "left_semi")
    cols = [F.col(c).alias(f"_mix_{c}") for c in ("id", "source", "tokens", "epoch", "block", "weight", "number")]
    return whole.select(*cols).unionByName(last.filter("share = 'all'").select(*cols)).unionByName(edge.select(*cols))


def _same(names: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on


def mixed_documents(docs: DataFrame, target: Target, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, each as often as the mixture reads it. Texts stay where they are but for repeated rows and the blocks at the border."""
    m = mixture(docs, target, source_col=source_col, id_col=id_col, text_col=text_col, **options)
    names = [f"own_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    keyed = rows.withColumns({"id": at[id_col], "source": at[source_col], "key": text_key(at[text_col])})
    # rows that repeat an id and a text are numbered, all others are number 0
    again = m.documents.groupBy("id", "key").agg(F.sum("rows").alias("n")).filter("n > 1").select(F.col("id").alias("a_id"), F.col("key").alias("a_key"))
    again = Scratch(docs.sparkSession, "mixed").save(again, "again")
    tested = marked(keyed, [F.col("id"), F.col("key")], again, "hit")
    near = tested.filter("hit").drop("hit")
    one = tested.filter("NOT hit").drop("hit").unionByName(near.join(again, _same(["id", "key"], "a_"), "left_anti")).withColumn("number", F.lit(0).cast("long"))
    many = near.join(again, _same(["id", "key"], "a_"), "left_semi").withColumn("number", (F.row_number().over(W.partitionBy("id", "key", "source").orderBy(F.lit(0))) - 1).cast("long"))
    last = _last(one.unionByName(many), m, [F.col(c) for c in ("id", "key", "number")])
    inside = last.filter("share IS NULL OR share <> 'some'").withColumn("times", F.col("whole") + F.when(F.col("share") == "all", 1).otherwise(0))
    border = m.border.select(*[F.col(c).alias(f"b_{c}") for c in m.border.columns], F.lit(1).alias("read"))
    edge = last.filter("share = 'some'").join(border, _same(["id", "source", "key", "number"], "b_"), "left").withColumn("times", F.col("whole") + F.coalesce("read", F.lit(0)))
    out = inside.select(*names, "times").unionByName(edge.select(*names, "times")).filter("times > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*names).toDF(*docs.columns)
