"""Near-duplicate vectors through a pivot-permutation index.

Reference points (pivots) are unit vectors of a bounded sample, the rows with the smallest hash, that
are far enough from one another; there are more of them for more vectors, from PIVOTS to MOST_PIVOTS.
A vector is described by its ``prefix`` nearest pivots in order. An inverted list holds the vectors of a
label that count the same ``shared`` pivots among their nearest, each of them with ranks (from 0) whose
sum is at most ``ranks``: near vectors share the pivots that are nearest to both, so the order decides
under which of its pivots a vector is posted. Candidates of a list are verified by exact cosine in
double precision. A pair that shares several lists counts in the first of them alone. Without pivots
(``exact``) all vectors of a label are one list, which finds every link by brute force in blocks.

Equal vectors are one node with a multiplicity. A list leaves its task not as pairs but as counts
of links for each member, and as one link for each member to the smallest one that it reaches by the
links compared in one go, which joins all that these links join; lists of many members are cut into
blocks that are compared block against block in different tasks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a label, link with nothing; vectors of different lengths do not link; rows that repeat an id
are one vector of that id each and counted; a null id is no component's smallest id unless all its ids
are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaview.llm._components import components
from deltaview.llm._store import Scratch, partitions

THRESHOLD = 0.93
PIVOTS, MOST_PIVOTS, SAMPLE, SHARED, RANKS = 256, 1024, 4096, 2, 8
PREFIX = RANKS + 1
#: Members of a list that are compared in one go.
BLOCK = 1024


def pivots_for(vectors: int, least: int = PIVOTS, most: int = MOST_PIVOTS) -> int:
    return min(most, max(least, int(vectors**0.5)))


def choose_pivots(vectors: np.ndarray, pivots: int, apart: float = 0.9) -> np.ndarray:
    """Unit vectors of the sample, in its order, no two of them closer than ``apart``."""
    kept = np.zeros((0, vectors.shape[1] if vectors.ndim == 2 else 0))
    for v in vectors:
        if len(kept) >= pivots:
            break
        if not len(kept) or (kept @ v).max() < apart:
            kept = np.vstack([kept, v])
    return kept


def list_names(near: np.ndarray, label: np.ndarray, shared: int = SHARED, ranks: int = RANKS) -> np.ndarray:
    """near: pivots in order. One 64-bit name for each label and set of ``shared`` pivots whose ranks sum up to ``ranks``; rows are sorted."""
    near = near.astype(np.uint64)
    picks = [p for p in combinations(range(near.shape[1]), min(shared, near.shape[1])) if sum(p) <= ranks]
    out = []
    for pick in picks:
        h = label.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for c in np.sort(near[:, pick], axis=1).T:
            h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(29))
        out.append(h)
    return np.sort(np.stack(out, axis=1), axis=1)


def vectors_of(raw: list[bytes], wide: bool) -> np.ndarray:
    """Unit vectors in double precision of vectors of one length."""
    x = np.frombuffer(b"".join(raw), "<f8" if wide else "<f4").reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _post(pivots: dict[int, np.ndarray], prefix: int, shared: int, ranks: int, wide: bool):
    """node, label, vector -> node, its nearest pivots in order and the names of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, raw = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            size = np.array([len(u) for u in raw])
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                for lo in range(0, len(at), 2048):
                    own = at[lo : lo + 2048]
                    x = vectors_of([raw[i] for i in own], wide)
                    p = pivots.get(x.shape[1], np.zeros((0, x.shape[1])))
                    k = min(prefix, len(p))
                    near = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :k] if k else np.zeros((len(own), 0), np.int64)
                    names = list_names(near, label[own], shared, ranks) ^ np.uint64(x.shape[1])
                    offsets = pa.array(np.arange(len(own) + 1) * names.shape[1], pa.int32())
                    order = near.astype("<u2")
                    yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array([r.tobytes() for r in order], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(names.ravel().view(np.int64)))], ["node", "near", "lists"])

    return run


def joined(i: np.ndarray, j: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node that each member reaches by the links i-j, which are given in both directions."""
    order = np.argsort(nodes)
    low = np.empty(len(nodes), np.int64)
    low[order] = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        new = new[order[new]]
        if (new == low).all():
            return nodes[order[low]]
        low = new


def _compare(threshold: float, shared: int, ranks: int, wide: bool):
    """Rows sorted by (list, block pair): list, x, y, side, node, copies, vector, label, near -> node, links, least."""

    def names_of(rows: list[tuple], dim: int) -> np.ndarray:
        near = np.frombuffer(b"".join(r[5] for r in rows), "<u2").reshape(len(rows), -1)
        return list_names(near, np.array([r[4] for r in rows], np.int64), shared, ranks) ^ np.uint64(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(key: tuple[int, int, int], rows: list[tuple]) -> pa.RecordBatch | None:
            rows = sorted(rows, key=lambda r: r[1])
            own = key[1] == key[2]
            left = [r for r in rows if r[0] == key[1]]
            right = left if own else [r for r in rows if r[0] == key[2]]
            if not left or not right:
                return None
            a = vectors_of([r[3] for r in left], wide)
            b = a if own else vectors_of([r[3] for r in right], wide)
            hit = a @ b.T >= threshold
            if own:
                np.fill_diagonal(hit, False)
            i, j = np.nonzero(hit)
            if not len(i):
                return None
            # a pair counts in the smallest of its common lists
            la = names_of(left, a.shape[1])
            lb = la if own else names_of(right, a.shape[1])
            this = np.int64(key[0]).view(np.uint64)
            earlier = np.zeros(len(i), bool)
            for c in range(la.shape[1]):
                v = la[i, c]
                todo = np.flatnonzero((v < this) & ~earlier)
                if len(todo):
                    earlier[todo] = (lb[j[todo]] == v[todo, None]).any(1)
            i, j = i[~earlier], j[~earlier]
            nodes_a, nodes_b = np.array([r[1] for r in left]), np.array([r[1] for r in right])
            ca, cb = np.array([r[2] for r in left]), np.array([r[2] for r in right])
            nodes, copies = (nodes_a, ca) if own else (np.concatenate([nodes_a, nodes_b]), np.concatenate([ca, cb]))
            if not own:
                i, j = np.concatenate([i, j + len(left)]), np.concatenate([j + len(left), i])
            links = np.bincount(i, weights=copies[j], minlength=len(nodes)).astype(np.int64)
            hit_at = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(c[hit_at]) for c in (nodes, links, joined(i, j, nodes))], ["node", "links", "least"])

        key, held = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(9)]
            for name, x, y, *row in zip(*cols, strict=True):
                if (name, x, y) != key:
                    if key is not None and (out := settle(key, held)) is not None:
                        yield out
                    key, held = (name, x, y), []
                held.append(tuple(row))
        if key is not None and (out := settle(key, held)) is not None:
            yield out

    return run


def _checked(wide: bool):
    """Vectors as bytes; null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for v in batch.column(2).to_pylist():
                if not v or None in v:
                    out.append(None)
                    continue
                x = np.array(v, np.float64)
                length = np.sqrt((x * x).sum())
                good = np.isfinite(x).all() and np.isfinite(length) and length > 0
                out.append(x.astype("<f8" if wide else "<f4").tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "vector"])

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    pivots: int | None = None,
    sample: int = SAMPLE,
    shared: int = SHARED,
    ranks: int = RANKS,
    exact: bool = False,
) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    n = partitions(spark)
    wide = dict(vectors.dtypes)[vector_col] != "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    rows = scratch.save(rows.mapInArrow(_checked(wide), "id long, label long, vector binary"), "vectors")
    good = rows.filter("vector IS NOT NULL AND label IS NOT NULL")
    # equal vectors of a label are one node
    nodes = good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    drawn = [] if exact else [r["vector"] for r in nodes.orderBy(F.xxhash64("vector"), "label").limit(sample).select("vector").collect()]
    by_size = {k: vectors_of([v for v in drawn if len(v) == k], wide) for k in {len(v) for v in drawn}}
    points = {x.shape[1]: choose_pivots(x, pivots or pivots_for(nodes.count())) for x in by_size.values()}
    described = scratch.save(nodes.select("node", "label", "vector").mapInArrow(_post(points, ranks + 1, shared, ranks, wide), "node long, near binary, lists array<long>"), "described")
    posts = described.select("node", F.explode("lists").alias("list"))
    # lists of one member have nothing to compare; long ones are cut into blocks by a hash of the node
    sizes = posts.groupBy(F.col("list").alias("l")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    sizes = scratch.save(sizes, "sizes")
    dealt = posts.join(sizes, F.col("list") == F.col("l")).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each block meets every block, itself included
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("list", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", F.col("node").alias("member"))
    # vector and pivots are fetched by node
    known = nodes.join(described.select(F.col("node").alias("dn"), "near"), F.col("node") == F.col("dn")).select("node", "copies", "vector", "label", "near")
    full = dealt.join(known, F.col("member") == F.col("node")).select("list", "x", "y", "side", "node", "copies", "vector", "label", "near")
    full = full.repartition(n, "list", "x", "y").sortWithinPartitions("list", "x", "y")
    found = scratch.save(full.mapInArrow(_compare(threshold, shared, ranks, wide), "node long, links long, least long"), "found")
    counts = found.groupBy(F.col("node").alias("cn")).agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), scratch).withColumnRenamed("node", "ln")
    known = nodes.join(counts, F.col("node") == F.col("cn"), "left").join(label, F.col("node") == F.col("ln"), "left")
    known = known.select(F.col("label").alias("kl"), F.col("vector").alias("kv"), "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    known = scratch.save(known, "known")
    least = scratch.save(known.groupBy(F.col("component").alias("c")).agg(F.min("id").alias("component_id")), "least")
    named = known.join(least, F.col("component") == F.col("c")).select("kl", "kv", "n_links", "component_id", F.lit(True).alias("is_node"))
    out = rows.join(named, (F.col("label") == F.col("kl")) & (F.col("vector") == F.col("kv")), "left")
    component = F.when(F.col("is_node"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
