"""Exact Jaccard self-join of word-shingle sets by partitioning the universe.

Sets with J(X, Y) >= s/100 differ in at most H = floor((100 - s)(|X| + |Y|) / (100 + s)) shingles.
Sizes fall into bands [2^k, 2^(k+1)). Each band hashes the universe into segments; two sets that
differ in H shingles agree on all but H segments. Documents join inside their band, and the smaller
ones of a band also with the band below.

Which segments are indexed is a question of cost. All sets order their segments by one global rule,
the number of shingles that are not frequent first, so that segments that many sets share come
last. Of segments that two sets have in common, the first in that order is among the first H + 1 of
both sets; hence each set indexes H + 1 segments only and skips its costly ones. Where bands are so
small that segments would be single shingles, a band has half as many segments and indexes each
with its one-deletion neighbourhood, as one agreement up to one shingle then covers two differences.

Candidates of a segment are not paired with one another in rows: each meets the smallest one, the
list's centre c. A sketch goes before every text: the parities of the shingles that fall into each
of about as many buckets as the set has shingles. Sets that differ in d shingles differ in at most
d parities, so a pair with more of them cannot link, and none is lost by it. Pairs that pass are
checked by their whole sets, and links become components. Where the sets of a centre lie in several
components, those left are compared with one another, by sketches first; what may link across
components is compared by what it differs from c in: |X xor Y| = |(X xor c) xor (Y xor c)|, so the
shingles of c that each lacks (bits) and those it has besides (hashes) give the exact similarity. A
task holds two blocks of members and reports which may link, or links that join components, never
all pairs. Equal sets are one node.

Sets are named by a 64-bit digest. Defined results: null, empty and blank texts have the empty set,
which links with nothing; shorter texts than a shingle are one shingle; repeated rows are equal sets;
a null id is no component's smallest id unless all its ids are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaview.llm._components import components
from deltaview.llm._rows import fetch, marked, text_key, without
from deltaview.llm._store import Scratch, lean, partitions

WORDS, SIMILARITY = 5, 75
#: Frequent shingles that order segments, at most; they change the cost alone.
FREQUENT = 1 << 17
#: Shingles that are counted together at most.
GROUP_SHINGLES = 1 << 22
#: Texts whose shingles are counted together, and how often a shingle counts as frequent among them.
GROUP, OFTEN = 8192, 2
#: Ranges of hashes in which these are counted, and signatures that leave a task together.
RANGES, TOGETHER = 16, 1 << 18
#: Cost of the list of candidates of one shingle against that of a signature; of t shingles exp(2 - 2 t) of it.
LIST_COST = 12.0

_U = np.uint64
_P = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5), _U(0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of all words where there are fewer."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    out = np.full(len(w) - k + 1, len(w) if k < words else 0, np.uint64)
    for i in range(k):
        out = (out + h[i : len(w) - k + 1 + i]) * _P[i % 5]
    return np.unique(mixed(out))


def set_name(x: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64))


def linked(x: np.ndarray, y: np.ndarray, similarity: int = SIMILARITY) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= similarity * (len(x) + len(y) - both)


def sketch(x: np.ndarray) -> bytes:
    """Parities of the shingles in 64 * 2^k buckets, at least as many as shingles, as bits."""
    n = max(64, 1 << max(0, len(x) - 1).bit_length())
    odd = np.bincount((mixed(x ^ _P[3]) & _U(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) as they are with fewer buckets, ``width`` bytes of them."""
    return bits if bits.shape[1] == width else np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


def may_link(n_x: np.ndarray, x: np.ndarray, n_y: np.ndarray, y: np.ndarray, similarity: int) -> np.ndarray:
    """False where sets of these sizes and sketches (rows of bytes) cannot link."""
    width = min(x.shape[1], y.shape[1])
    d = np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(1, dtype=np.int64)
    small, large = np.minimum(n_x, n_y), np.maximum(n_x, n_y)
    return (100 * small >= similarity * large) & (d * (100 + similarity) <= (100 - similarity) * (small + large))


class Bands:
    """Segments and indexed share of each size band."""

    def __init__(self, similarity: int = SIMILARITY):
        self.s = similarity

    def differ(self, a: int, b: int) -> int:
        return (100 - self.s) * (a + b) // (100 + self.s)

    def largest(self, a: int) -> int:
        return 100 * a // self.s

    def of(self, n: int) -> int:
        return n.bit_length() - 1

    @cache  # noqa: B019  one object a worker
    def layout(self, band: int) -> tuple[int, int]:
        """(segments, level): level 1 where the one-deletion neighbourhood of every segment is indexed."""
        low, high = 1 << band, (2 << band) - 1
        need = self.differ(high, self.largest(high)) + 1
        plain, near = max(low + 2, need), (need + 1) // 2
        # the indexed segments are the fuller ones: about half of the others are empty
        per, wide = max(1.0, high / (need + (plain - need) / 2)), high / near
        cost_plain = need * (1 + LIST_COST * np.exp(-2 * (per - 1)))
        # a deletion from a segment of one shingle meets every set that lacks the segment
        thin = near * np.exp(-wide) * (1 + wide) if near > 1 else 0.0
        cost_near = near * (1 + wide) * (1 + LIST_COST * np.exp(-2 * max(0.0, wide - 2))) + thin * LIST_COST**2
        return (near, 1) if cost_near < cost_plain else (plain, 0)

    def roles(self, n: int) -> list[tuple[int, int]]:
        """(band, differences to cover) that a set of n shingles is indexed under."""
        band = self.of(n)
        out = [(band, max(self.differ(n, self.largest(n)), self.differ(n, n)))]
        below = (1 << band) - 1
        if band and self.s * n <= 100 * below:
            out.append((band - 1, self.differ(n, below)))
        return out


def signatures(x: np.ndarray, frequent: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes of the indexed segments (and deletions) of a set."""
    n, out = len(x), []
    rare = np.ones(n, bool)
    if len(frequent):
        at = np.searchsorted(frequent, x)
        rare = frequent[np.minimum(at, len(frequent) - 1)] != x
    place, value = mixed(x ^ _P[1]) >> _U(32), mixed(x + _P[2])
    for band, differ in bands.roles(n):
        m, level = bands.layout(band)
        seg = ((place * _U(m)) >> _U(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(seg[order]) > 0])
        total = np.zeros(m, np.uint64)
        total[seg[order][starts]] = np.add.reduceat(value[order], starts)
        salt = mixed(np.arange(m, dtype=np.uint64) + _U((band + 1) << 40))
        if level:
            out.append(mixed(total ^ salt))
            if differ:
                out.append(mixed((total[seg] - value) ^ salt[seg]))
            continue
        names = mixed(total ^ salt)
        keep = min(m, differ + 1)
        # a rule for all sets: many rare shingles first, then many shingles, then by name
        first = np.bincount(seg, weights=rare, minlength=m) * 65536.0 + np.minimum(np.bincount(seg, minlength=m), 65535)
        out.append(names[np.lexsort((names, -first))[:keep]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


DESCRIBED = ["id", "key", "n", "name", "sketch", "often"]


def _describe(words: int):
    """id, key, text -> size, name and sketch of its set; besides, shingles that are frequent among GROUP texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []

        def often(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            # sets are sorted: a range of hashes at a time needs little memory
            cuts = (np.arange(1, RANGES, dtype=np.uint64) * _U((1 << 64) // RANGES)).astype(np.uint64)
            at = [np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]]) for x in arrays]
            for r in range(RANGES):
                v, c = np.unique(np.concatenate([x[i[r] : i[r + 1]] for x, i in zip(arrays, at, strict=True)]), return_counts=True)
                v, c = v[c >= OFTEN], c[c >= OFTEN]
                k = len(v)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(c), pa.array(v.view(np.int64)), pa.nulls(k, pa.binary()), pa.array(np.ones(k, bool))], DESCRIBED)

        held, size = set(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, names, bits = [], [], []
                for text in part.column(2).to_pylist():
                    x = shingle_set(text, words)
                    sizes.append(len(x))
                    names.append(name := set_name(x))
                    bits.append(sketch(x))
                    if name not in held:  # equal sets count once
                        held.add(name)
                        seen.append(x)
                        size += len(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(bits, pa.binary()), pa.array(np.zeros(len(part), bool))], DESCRIBED)
                if len(seen) >= GROUP or size >= GROUP_SHINGLES:
                    yield from often(seen)
                    seen, held, size = [], set(), 0
        if seen:
            yield from often(seen)

    return run


def _index(frequent: bytes, words: int, similarity: int, parts: int):
    """Signatures of each task's distinct sets, dealt to parts by value, as packed columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, bands = np.frombuffer(frequent, np.uint64), Bands(similarity)
        held: set[int] = set()
        sigs: list[np.ndarray] = []
        owners: list[int] = []
        count = 0

        def flush() -> pa.RecordBatch:
            s = np.concatenate(sigs)
            n = [len(x) for x in sigs]
            o = np.repeat(np.array(owners, np.int64), n)
            to = ((s >> _U(32)) * _U(parts)) >> _U(32)
            order = np.argsort(to, kind="stable")
            s, o = s[order], o[order]
            at = np.r_[np.searchsorted(to[order], np.arange(parts, dtype=np.uint64)), len(s)]
            full = [i for i in range(parts) if at[i + 1] > at[i]]
            cut = lambda c: pa.array([c[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cut(s), cut(o)], ["part", "sigs", "owners"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(at, 512).to_pylist():
                    x = shingle_set(text, words)
                    if not len(x) or (name := set_name(x)) in held:
                        continue
                    held.add(name)
                    sigs.append(np.unique(signatures(x, often, bands)))
                    owners.append(name)
                    count += len(sigs[-1])
                    if count > TOGETHER:
                        yield flush()
                        sigs, owners, count = [], [], 0
        if sigs:
            yield flush()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list of two or more sets that share a signature, its first member (the centre) with each other one."""
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for s, o in zip(batch.column(1), batch.column(2), strict=True):
            got.append((np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(o.as_buffer(), np.int64)))
    if not got:
        return
    s, o = (np.concatenate([g[i] for g in got]) for i in range(2))
    del got
    order = np.lexsort((o, s))
    s, o = s[order], o[order]
    first = np.r_[True, s[1:] != s[:-1]]
    centre = o[np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))]
    other = centre != o
    if not other.any():
        return
    a, b = centre[other], o[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b = a[new], b[new]
    for at in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], ["a", "b"])


def _rows_of(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """Sketches of equal length, as rows of bytes."""
    return np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)


def _sift(similarity: int):
    """a, b, n_a, sketch_a, n_b, sketch_b -> a, b, n_b and whether the two may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            width = [np.array([len(x) for x in batch.column(i).to_pylist()], np.int64) for i in (3, 5)]
            near = np.zeros(batch.num_rows, bool)
            kind = width[0] * (1 << 32) + width[1]
            for k in np.unique(kind):
                at = np.flatnonzero(kind == k)
                near[at] = may_link(n_a[at], _rows_of(batch.column(3), at), n_b[at], _rows_of(batch.column(5), at), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(near)], ["a", "b", "n_b", "near"])

    return run


def _active(similarity: int):
    """Rows sorted by (centre, block pair): a, x, y, side, node, label, n, sketch -> members that may link with one of another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(key: tuple, held: list[tuple]) -> pa.RecordBatch:
            own = key[1] == key[2]
            sides = [[r for r in held if r[0] == s] for s in dict.fromkeys(key[1:])]
            found: set[int] = set()
            if all(sides) and (len(sides) == 2 or own):
                for left in _by_width(sides[0]):
                    for right in _by_width(sides[-1]):
                        for i in range(len(left[0])):
                            other = np.flatnonzero(right[1] != left[1][i])
                            if len(other):
                                one = np.broadcast_to(left[3][i], (len(other), left[3].shape[1]))
                                hit = other[may_link(np.full(len(other), left[2][i]), one, right[2][other], right[3][other], similarity)]
                                if len(hit):
                                    found.add(int(left[0][i]))
                                    found.update(right[0][hit].tolist())
            out = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.int64()), pa.array(out, pa.int64())], ["a", "member"])

        key, held = None, []
        for batch in batches:
            for a, x, y, *row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if (a, x, y) != key:
                    if key is not None:
                        yield settle(key, held)
                    key, held = (a, x, y), []
                held.append(tuple(row))
        if key is not None:
            yield settle(key, held)

    return run


def _by_width(rows: list[tuple]) -> list[tuple[np.ndarray, ...]]:
    """rows: side, node, label, n, sketch -> for each length of sketch the nodes, labels, sizes and sketches."""
    out = []
    for width in sorted({len(r[4]) for r in rows}):
        part = [r for r in rows if len(r[4]) == width]
        bits = np.frombuffer(b"".join(r[4] for r in part), np.uint8).reshape(len(part), width)
        out.append((*(np.array([r[i] for r in part], np.int64) for i in (1, 2, 3)), bits))
    return out


CHECKED = "a long, b long, linked boolean, n_b int"
#: Shingles of the sets that a worker remembers.
REMEMBERED = 1 << 20


class Sets:
    """Shingle sets by node, computed once while there is room."""

    def __init__(self, words: int):
        self.words, self.known, self.held = words, {}, 0

    def of(self, node: int, text: str | None) -> np.ndarray:
        x = self.known.get(node)
        if x is None:
            x = shingle_set(text, self.words)
            self.held += len(x)
            if self.held > REMEMBERED:
                self.known, self.held = {}, len(x)
            self.known[node] = x
        return x


def _verify(words: int, similarity: int):
    """Rows sorted by group, its centre first: whether each member links with the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre, name = None, None, None
        sets = Sets(words)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for g, k, leaf, node, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                x = sets.of(node, text)
                if (g, k) != group:
                    group, centre, name = (g, k), x, node
                    if leaf:
                        raise ValueError("a group lacks its centre")
                elif leaf:
                    for c, v in zip(out, (name, node, linked(centre, x, similarity), len(x)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int32()), strict=True)], ["a", "b", "linked", "n_b"])

    return run


def check_pairs(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str, words: int, similarity: int) -> DataFrame:
    """CHECKED rows of pairs (a, b). texts: node, text. A centre meets at most 64 or so others in one group."""
    counts = pairs.groupBy(F.col("a").alias("centre")).agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("chunks"))
    counts = scratch.save(counts, f"{name}-counts")
    leaves = pairs.join(counts, F.col("a") == F.col("centre")).select("centre", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("leaf"), F.col("b").alias("node"))
    # a chunk without leaves has only a centre, which does no harm
    centres = counts.select("centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("leaf"), F.col("centre").alias("node"))
    asked = scratch.save(leaves.unionByName(centres), f"{name}-asked")
    rows = asked.join(texts.withColumnRenamed("node", "text_node"), F.col("node") == F.col("text_node")).select("centre", "chunk", "leaf", "node", "text")
    rows = rows.repartition(partitions(scratch.spark), "centre", "chunk").sortWithinPartitions("centre", "chunk", "leaf")
    return scratch.save(rows.mapInArrow(lean(_verify(words, similarity)), CHECKED), f"{name}-checked")


class Differences:
    """Sets of one centre as their differences from it."""

    def __init__(self, rows: list[tuple]):
        """rows: node, label, size, size of the centre, lacks, besides."""
        self.node = np.array([r[0] for r in rows], np.int64)
        self.label = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([r[2] for r in rows], np.int64)
        self.bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        self.besides = [np.frombuffer(r[5], np.uint64) for r in rows]
        self.n_lacks = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.n_besides = np.array([len(b) for b in self.besides], np.int64)
        tokens = np.concatenate(self.besides)
        owner = np.repeat(np.arange(len(rows)), self.n_besides)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def differ(self, bits: np.ndarray, besides: np.ndarray) -> np.ndarray:
        """Size of the symmetric difference of one set with each of these."""
        common = np.bitwise_count(self.bits & bits).sum(1, dtype=np.int64)
        lo, hi = np.searchsorted(self.tokens, besides, "left"), np.searchsorted(self.tokens, besides, "right")
        some = hi > lo
        if some.any():
            at = np.concatenate([self.owner[i:j] for i, j in zip(lo[some].tolist(), hi[some].tolist(), strict=True)])
            common = common + np.bincount(at, minlength=len(self.node))
        return self.n_lacks + self.n_besides + int(np.bitwise_count(bits).sum()) + len(besides) - 2 * common


def joining_links(left: Differences, right: Differences, similarity: int, own: bool) -> list[tuple[int, int]]:
    """Links that join components, as few as suffice: links within what has been joined add nothing."""
    lab_l = left.label.copy()
    lab_r = lab_l if own else right.label.copy()
    out = []
    for i in range(len(left.node)):
        first = i + 1 if own else 0
        other = lab_r[first:] != lab_l[i]
        if not other.any():
            continue
        d = right.differ(left.bits[i], left.besides[i])[first:]
        total = left.size[i] + right.size[first:]
        both = (total - d) // 2
        hit = np.flatnonzero(other & (both > 0) & (100 * both >= similarity * (total - both)))
        for j in (first + hit).tolist():
            old, new = int(lab_r[j]), int(lab_l[i])
            if old != new:
                out.append((int(left.node[i]), int(right.node[j])))
                for lab in (lab_l, lab_r):
                    lab[lab == old] = new
    return out


def difference(centre: np.ndarray, x: np.ndarray) -> tuple[bytes, bytes]:
    """Bits of the centre's shingles that x lacks, and the shingles that it has besides."""
    at = np.minimum(np.searchsorted(centre, x), len(centre) - 1)
    hit = centre[at] == x
    lacks = np.ones(len(centre), bool)
    lacks[at[hit]] = False
    return np.packbits(lacks).tobytes(), x[~hit].tobytes()


def _compare(words: int, similarity: int):
    """Rows sorted by (centre, block pair), the centre first (side -1): a, x, y, side, node, label, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words)

        def settle(key: tuple, held: list[tuple]) -> pa.RecordBatch:
            own = key[1] == key[2]
            sides = [[r[1:] for r in held if r[0] == s] for s in key[1:]]
            links = []
            if all(sides):
                left = Differences(sides[0])
                links = joining_links(left, left if own else Differences(sides[1]), similarity, own)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["a", "b"])

        key, held, centre = None, [], None
        for batch in batches:
            for a, x, y, side, node, label, text in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                own = sets.of(node, text)
                if (a, x, y) != key:
                    if key is not None:
                        yield settle(key, held)
                    key, held, centre = (a, x, y), [], own
                    if side >= 0:
                        raise ValueError("a group lacks its centre")
                elif side >= 0:
                    held.append((side, node, label, len(own), len(centre), *difference(centre, own)))
        if key is not None:
            yield settle(key, held)

    return run


#: Members of a centre that one task compares with as many others, by sketches and by whole sets; shingles of the latter.
SKETCHES, BLOCK, BLOCK_SHINGLES = 1024, 512, 1 << 20


def _block_pairs(members: DataFrame, counts: DataFrame) -> DataFrame:
    """members: a, member, ...; counts: c, blocks. Each member once for each block that its own one meets, itself included."""
    dealt = members.join(counts, F.col("a") == F.col("c")).withColumn("side", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")}).drop("c", "blocks", "other")


def _classes(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, words: int, similarity: int) -> DataFrame:
    """One row per input row: id, key (of its text), n, label (a name of its component; null for the empty set)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    described = scratch.save(rows.mapInArrow(lean(_describe(words)), "id long, key long, n long, name long, sketch binary, often boolean"), "described")
    frequent = _frequent(described.filter("often").groupBy("name").agg(F.sum("n").alias("n")))
    described = described.filter("NOT often")
    parts = 4 * partitions(spark)
    blobs = rows.select("text").mapInArrow(lean(_index(frequent, words, similarity, parts)), "part int, sigs binary, owners binary")
    pairs = blobs.repartition(partitions(spark), "part").mapInArrow(lean(_lists), "a long, b long")
    pairs = scratch.save(pairs, "lists").distinct()
    pairs = scratch.save(pairs, "stars")
    # of each set in question one row stands for all
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    about = marked(described, [F.col("name")], asked, "hit").filter("hit").groupBy("name").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    about = scratch.save(about.join(asked, F.col("name") == F.col("node")).select("node", "rep.id", "rep.key", "n", "sketch"), "nodes")
    side = lambda c: about.select(F.col("node").alias(f"node_{c}"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    met = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b")).select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    met = scratch.save(met.mapInArrow(lean(_sift(similarity)), "a long, b long, n_b long, near boolean"), "met")
    near = met.filter("near").select("a", "b")
    texts = _texts(rows, about, near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct(), scratch, "texts-1")
    links = check_pairs(near, texts, scratch, "star", words, similarity).filter("linked").select("a", "b")
    label = scratch.save(components(links, scratch, "cc1"), "cc1-labels")
    # centres whose sets lie in several components
    labelled = met.join(label, F.col("b") == F.col("node"), "left").select("a", F.col("b").alias("member"), F.col("n_b").alias("n"), F.coalesce("component", "b").alias("label"))
    labelled = scratch.save(labelled, "labelled")
    torn = labelled.groupBy("a").agg(F.min("label").alias("u"), F.max("label").alias("v"), F.count(F.lit(1)).alias("k")).filter("u <> v")
    torn = scratch.save(torn.select(F.col("a").alias("c"), F.ceil(F.col("k") / SKETCHES).cast("int").alias("blocks")), "torn")
    dealt = scratch.save(_block_pairs(labelled, torn), "sketched")
    known = about.select(F.col("node").alias("known"), "sketch")
    dealt = dealt.join(known, F.col("member") == F.col("known")).select("a", "x", "y", "side", F.col("member").alias("node"), "label", "n", "sketch")
    dealt = dealt.repartition(partitions(spark), "a", "x", "y").sortWithinPartitions("a", "x", "y")
    active = scratch.save(dealt.mapInArrow(lean(_active(similarity)), "a long, member long").distinct(), "active")
    on = active.select(F.col("a").alias("on_a"), F.col("member").alias("on_b"))
    left = scratch.save(labelled.join(on, (F.col("a") == F.col("on_a")) & (F.col("member") == F.col("on_b"))).select("a", "member", "n", "label"), "left")
    counts = left.groupBy(F.col("a").alias("c")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    counts = scratch.save(counts, "counts")
    dealt = _block_pairs(left, counts).select("a", "x", "y", "side", "member", "label")
    heads = counts.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("y", F.explode(F.sequence(F.col("x"), F.col("blocks") - 1)))
    heads = heads.select(F.col("c").alias("a"), "x", "y", F.lit(-1).alias("side"), F.col("c").alias("member"), F.col("c").alias("label"))
    dealt = scratch.save(dealt.unionByName(heads), "dealt")
    texts = _texts(rows, about, dealt.select(F.col("member").alias("node")).distinct(), scratch, "texts-2")
    full = dealt.join(texts, F.col("member") == F.col("node")).select("a", "x", "y", "side", "node", "label", "text")
    full = full.repartition(partitions(spark), "a", "x", "y").sortWithinPartitions("a", "x", "y", "side")
    links = links.unionByName(scratch.save(full.mapInArrow(lean(_compare(words, similarity)), "a long, b long"), "joining"))
    label = scratch.save(components(links, scratch, "cc2"), "labels")
    named = described.select("id", "key", "n", "name").join(label, F.col("name") == F.col("node"), "left")
    return scratch.save(named.select("id", "key", "n", F.when(F.col("n") > 0, F.coalesce("component", "name")).alias("label")), "named")


def _frequent(counts: DataFrame) -> bytes:
    """Names of the most frequent shingles, FREQUENT of them at most: the uppermost bins of counts that fit."""
    binned = counts.withColumn("bin", F.floor(16 * F.log2("n")).cast("int"))
    held, least = 0, None
    for r in sorted(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["bin"]):  # at most 16 bins a doubling
        if held + r["k"] > FREQUENT:
            break
        held, least = held + r["k"], r["bin"]
    if least is None:
        return b""
    return np.sort(binned.filter(F.col("bin") >= least).select("name").toArrow()["name"].to_numpy().view(np.uint64)).tobytes()


def _texts(rows: DataFrame, about: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, text of the wanted nodes."""
    asked = scratch.save(about.join(wanted, "node", "left_semi").select("node", "id", "key"), f"{name}-asked")
    return scratch.save(fetch(rows, asked), name)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    named = _classes(docs, scratch, id_col, text_col, words, similarity)
    least = scratch.save(named.filter("label IS NOT NULL").groupBy(F.col("label").alias("l")).agg(F.min("id").alias("least")), "least")
    out = named.join(least, F.col("label") == F.col("l"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their component, with their columns.

    Defined results: the row with the smallest id stays, a null id after all others; rows that repeat
    id and text stay or go together; texts without words all stay; column names may be any.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    named = _classes(docs, scratch, id_col, text_col, words, similarity).filter("label IS NOT NULL")
    order = F.struct(F.col("id").isNull(), "id", "key")
    first = scratch.save(named.groupBy(F.col("label").alias("l")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "firsts")
    drop = named.join(first, F.col("label") == F.col("l")).filter(order != F.col("first")).select("id", "key").distinct()
    return without(docs, scratch.save(drop, "drop"), id_col, text_col)
