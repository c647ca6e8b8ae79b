"""Exact dedup through a log-structured merge index of text digests.

Each task fills a memtable; every ``memtable_rows`` rows it is sorted by digest, equal digests become
one entry with the smallest identifier and the number of rows, and the entries leave as a run, cut
into digest ranges, each with its Bloom filter. A range is merged in one task: the entries of an
arriving run probe the filters of the older runs; where a filter lets them pass they are searched
there, and an entry that is found gives its rows and identifier to the older one. What is new becomes
a run of level 0, and FANOUT runs of a level are compacted to one of the next. Groups of copies of any
size have left their tasks as one entry a memtable, so that no range is hot.

Entries of more than one row are hits: the bytes of their rows are compared with the bytes of the row
that stays, and rows that differ in spite of an equal digest are grouped by the text itself.

Defined results: a null text counts as empty; every row gets a result; a null id comes after all
others; of rows that repeat both id and text exactly one is kept; an empty table gives an empty
result; other columns are ignored, and column names may be any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.llm._rows import marked, text_key, without
from deltaview.llm._store import Scratch, lean, partitions

MEMTABLE_ROWS, FANOUT = 1 << 18, 4
DIGEST_BYTES = 32
#: Bits of a run's filter for each entry, and how many of them an entry sets.
FILTER_PER, FILTER_HASHES = 12, 4

RUN = "part int, digests binary, ids binary, uids binary, counts binary, filter binary"
LEVEL = "digest binary, id long, uid long, n long"
#: Stands for a null id, which comes last.
_NO_ID = np.iinfo(np.int64).max


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class Bloom:
    """A filter over digests, whose bytes are random enough to be the hashes themselves."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(digests: np.ndarray, size: int) -> np.ndarray:
        words = digests.view(np.uint8).reshape(len(digests), DIGEST_BYTES).view("<u8")[:, :FILTER_HASHES]
        return (words % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, digests: np.ndarray) -> Bloom:
        bits = np.zeros(max(64, FILTER_PER * len(digests)), bool)
        bits[cls._places(digests, len(bits)).ravel()] = True
        return cls(bits)

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        return self.bits[self._places(digests, len(self.bits))].all(1)

    def packed(self) -> bytes:
        return len(self.bits).to_bytes(8, "little") + np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Bloom:
        n = int.from_bytes(data[:8], "little")
        return cls(np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=n).astype(bool))


class Run:
    """Entries in order of their digests, each digest once."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, uids: np.ndarray, counts: np.ndarray, bloom: Bloom | None = None):
        self.digests, self.ids, self.uids, self.counts = digests, ids, uids, counts
        self.bloom = bloom or Bloom.of(digests)

    @classmethod
    def collapsed(cls, digests: np.ndarray, ids: np.ndarray, uids: np.ndarray, counts: np.ndarray) -> Run:
        """Of equal digests the smallest identifier stays and the rows add up."""
        order = np.lexsort((uids, ids, digests))
        digests, ids, uids, counts = digests[order], ids[order], uids[order], counts[order]
        first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]]) if len(digests) else np.zeros(0, np.int64)
        return cls(digests[first], ids[first], uids[first], np.add.reduceat(counts, first) if len(first) else counts)

    def rows(self, at: np.ndarray) -> Run:
        return Run(self.digests[at], self.ids[at], self.uids[at], self.counts[at])


class Levels:
    """One digest range of the index."""

    def __init__(self):
        self.levels: list[list[Run]] = []

    def add(self, run: Run) -> None:
        for level in self.levels:
            for older in level:
                maybe = np.flatnonzero(older.bloom.may_hold(run.digests))
                if not len(maybe):
                    continue
                at = np.searchsorted(older.digests, run.digests[maybe])
                hit = older.digests[np.minimum(at, len(older.digests) - 1)] == run.digests[maybe]
                at, mine = at[hit], maybe[hit]
                if not len(mine):
                    continue
                less = (run.ids[mine] < older.ids[at]) | ((run.ids[mine] == older.ids[at]) & (run.uids[mine] < older.uids[at]))
                older.ids[at[less]], older.uids[at[less]] = run.ids[mine[less]], run.uids[mine[less]]
                older.counts[at] += run.counts[mine]
                left = np.ones(len(run.digests), bool)
                left[mine] = False
                run = run.rows(np.flatnonzero(left))
                if not len(run.digests):
                    return
        self._put(0, run)

    def _put(self, level: int, run: Run) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, Run.collapsed(*(np.concatenate([getattr(r, c) for r in runs]) for c in ("digests", "ids", "uids", "counts"))))

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), f"S{DIGEST_BYTES}")


def _memtables(rows: int, parts: int):
    """uid, id, digest -> sorted runs, cut by ranges of digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            digests, ids, uids = (np.concatenate([h[i] for h in held]) for i in range(3))
            r = Run.collapsed(digests, ids, uids, np.ones(len(ids), np.int64))
            head = r.digests.view(np.uint8).reshape(-1, DIGEST_BYTES)[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
            at = np.searchsorted(head * parts >> 32, np.arange(parts + 1))
            full = [i for i in range(parts) if at[i + 1] > at[i]]
            cut = [r.rows(np.arange(at[i], at[i + 1])) for i in full]
            cols = [[getattr(c, name).tobytes() for c in cut] for name in ("digests", "ids", "uids", "counts")]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in cols), pa.array([c.bloom.packed() for c in cut], pa.binary())], ["part", "digests", "ids", "uids", "counts", "filter"])

        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                held.append((_digests(part.column(2)), np.asarray(part.column(1).fill_null(_NO_ID)), np.asarray(part.column(0))))
                size += part.num_rows
                if size >= rows:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge(least: int):
    """Runs of one range after the other -> entries of at least so many rows, in order of digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, Levels] = {}
        for batch in batches:
            for part, digests, *numbers, bloom in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                n = [np.frombuffer(x, np.int64).copy() for x in numbers]
                ranges.setdefault(part, Levels()).add(Run(np.frombuffer(digests, f"S{DIGEST_BYTES}"), *n, Bloom.unpacked(bloom)))
        for part in sorted(ranges):
            runs = ranges.pop(part).runs()
            whole = Run.collapsed(*(np.concatenate([getattr(r, c) for r in runs]) for c in ("digests", "ids", "uids", "counts")))
            keep = np.flatnonzero(whole.counts >= least)
            raw = whole.digests.view(np.uint8).reshape(-1, DIGEST_BYTES)
            for lo in range(0, len(keep), 1 << 16):
                at = keep[lo : lo + (1 << 16)]
                ids = pa.array(whole.ids[at], mask=whole.ids[at] == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([raw[i].tobytes() for i in at], pa.binary()), ids, pa.array(whole.uids[at]), pa.array(whole.counts[at])], ["digest", "id", "uid", "n"])

    return run


class MergeIndex:
    """The index: ``flush`` adds sorted runs, ``compact`` merges them, ``lookup`` probes the result's filters."""

    def __init__(self, scratch: Scratch, memtable_rows: int = MEMTABLE_ROWS):
        self.scratch, self.memtable_rows = scratch, memtable_rows
        self.runs: list[str] = []
        self.levels = 0

    def flush(self, rows: DataFrame) -> None:
        """rows: uid, id, digest (cut or filled up to DIGEST_BYTES)."""
        name = f"run-{len(self.runs)}"
        rows = rows.select(F.col("uid").cast("long"), F.col("id").cast("long"), F.rpad("digest", F.lit(DIGEST_BYTES), F.lit(b"\0")).alias("digest"))
        self.scratch.save(rows.mapInArrow(lean(_memtables(self.memtable_rows, partitions(self.scratch.spark))), RUN), name)
        self.runs.append(name)

    def compact(self, least: int = 1) -> DataFrame:
        """Merge every run: digest, first (smallest id, then uid), n of the digests with at least so many rows."""
        spark = self.scratch.spark
        if not self.runs:
            raise ValueError("nothing was flushed")
        rows = spark.read.schema(RUN).parquet(*[self.scratch.path(r) for r in self.runs])
        merged = rows.repartition(partitions(spark), "part").mapInArrow(lean(_merge(least)), LEVEL)
        merged = merged.select("digest", F.struct("id", "uid").alias("first"), "n")
        self.levels += 1
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.memtable_rows)}
        return self.scratch.save(merged, f"level-{self.levels}", maxRecordsPerFile=self.memtable_rows, **bloom)

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Point probes of the newest level; row groups whose filter rejects all digests are skipped."""
        level = self.scratch.spark.read.parquet(self.scratch.path(f"level-{self.levels}"))
        return level.filter(F.col("digest").isin([bytearray(d) for d in digests]))


def _judged(docs: DataFrame, id_col: str, text_col: str, normalise, digest, memtable_rows: int) -> DataFrame:
    """One row per input row: id, key (of its raw text), sha, uid, first (id and uid of the row that stays), n."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    index = MergeIndex(scratch, memtable_rows)
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = docs.select(own.alias("id"), normalise(text).alias("t"), text_key(text).alias("key"))
    sha = F.unhex(F.sha2(F.col("t").cast("binary"), 256))
    name = F.rpad(digest(F.col("t")), F.lit(DIGEST_BYTES), F.lit(b"\0"))
    wide = scratch.save(rows.select("id", "key", name.alias("digest"), sha.alias("sha")).withColumn("uid", F.monotonically_increasing_id()), "keys")
    index.flush(wide)
    hits = index.compact(least=2)
    # rows that no hit's digest can be are alone; the others meet the index
    tested = marked(wide, [F.col("digest")], hits.select("digest"), "hit")
    entries = hits.select(F.col("digest").alias("d"), "first", "n")
    found = scratch.save(tested.filter("hit").drop("hit").join(entries, F.col("digest") == F.col("d")).drop("d"), "found")
    passed = tested.filter("hit").drop("hit").join(hits.select(F.col("digest").alias("d")), F.col("digest") == F.col("d"), "left_anti")
    alone = tested.filter("NOT hit").drop("hit").unionByName(passed).withColumns({"first": F.struct("id", "uid"), "n": F.lit(1).cast("long")})
    # the bytes of hits only
    ids = found.select("id", "key").distinct()
    texts = marked(rows, [F.col("id"), F.col("key")], ids, "hit").filter("hit").select("id", "t", digest(F.col("t")).alias("digest"))
    texts = scratch.save(texts.withColumn("digest", F.rpad("digest", F.lit(DIGEST_BYTES), F.lit(b"\0"))), "texts")
    keeper = hits.select(F.col("digest").alias("d"), F.col("first.id").alias("keep_id"))
    stays = texts.join(keeper, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("t").alias("keep_t"))
    stays = scratch.save(stays, "stays")  # so that the join below can split a large group
    differ = scratch.save(texts.join(stays, "digest").filter(F.col("t") != F.col("keep_t")).select("digest"), "differ")
    if not differ.isEmpty():
        # digests that stand for several texts: the text itself is the key there
        shared = differ.distinct()
        again = texts.join(shared, "digest").groupBy("digest", "t").agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("k"), F.count(F.lit(1)).alias("m"), F.first(sha).alias("s"))
        again = again.select(F.col("digest").alias("gd"), F.col("s").alias("gs"), F.col("k.id").alias("again_id"), "m")
        firsts = found.join(again, (F.col("digest") == F.col("gd")) & (F.col("sha") == F.col("gs")) & F.col("id").eqNullSafe(F.col("again_id"))).groupBy("gd", "gs", "again_id", "m").agg(F.min("uid").alias("again_uid"))
        found = found.join(firsts, (F.col("digest") == F.col("gd")) & (F.col("sha") == F.col("gs")), "left").withColumns(
            {"first": F.when(F.col("m").isNotNull(), F.struct(F.col("again_id").alias("id"), F.col("again_uid").alias("uid"))).otherwise(F.col("first")), "n": F.coalesce("m", "n")}
        )
    cols = ["id", "key", "sha", "uid", "first", "n"]
    return alone.select(*cols).unionByName(found.select(*cols))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = collapse_space,
    digest: Callable[[Column], Column] = sha256_digest,
    memtable_rows: int = MEMTABLE_ROWS,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    out = _judged(docs, id_col, text_col, normalise, digest, memtable_rows)
    return out.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns. Of equal texts the row with the smallest id stays, a null id only where all are null."""
    groups = _judged(docs, id_col, text_col, collapse_space, sha256_digest, MEMTABLE_ROWS).filter("n > 1")
    kept = F.col("uid") == F.col("first.uid")
    judged = Scratch(docs.sparkSession, "keep-first").save(groups.groupBy("id", "key").agg(F.max(kept).alias("stays"), F.min(kept).alias("all")), "judged")
    return without(docs, judged.filter("NOT stays").select("id", "key"), id_col, text_col, judged.filter("stays AND NOT all").select("id", "key"))
