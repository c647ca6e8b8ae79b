"""Packing by shortest-pack-first over the length histogram.

Documents become token ids and end with the separator id. A document longer than a sequence is cut
into full sequences and a remainder. Only the histogram of piece lengths (at most ``limit`` rows)
reaches the driver, where lengths are placed longest first into the open pack that is shortest
among those with room, and the rest open as few packs as hold them; packs alike are counted, not
listed. Pieces then find their place by rank
among the pieces of their length: ranks come from counts by (length, bucket), so a length that a
third of all pieces share is spread over all buckets.

Sequences are padded to ``limit``, except where their length is a power of two.

Defined results: a null or empty text is the separator alone; repeated rows are packed each for
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaview.llm._store import Scratch, give_back, lean, worker_cache

LIMIT = 1024
TOKENIZER = "byte_bpe_50k.json"
#: Entries of a worker's cache of chunk ids (some 200 bytes each), and characters of the longest chunk kept. When full, the chunks of the last texts stay.
CACHE, KEPT = 150_000, 64
#: Texts encoded at once, and their characters.
GROUP, GROUP_CHARS = 256, 1 << 20
#: The same vocabulary as ranks, which encodes single chunks faster; one in CHECKED of them is compared with the tokenizer's ids.
CHECKED = 64
RANKS = "byte_bpe_50k.tiktoken"

def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Token ids of texts. Chunks that start at a single space are encoded once and remembered.

    The vocabulary's own splitter never joins a word with what stands before a space, so a text is
    the concatenation of its chunks; texts where white space touches a space, or that hold a special
    token, go to the tokenizer whole.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        give_back()  # what reading it took, before the ranks take theirs
        self.one = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.one = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
            del table
            give_back()
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        if "  " in text or "\n " in text or "\t " in text or "\r " in text or text[:1].isspace() or text[-1:].isspace():
            return False
        return text.isascii() or not any(c in text for c in self._odd_spaces)

    #: White space outside ASCII, and the separators that ASCII has below the space.
    _odd_spaces = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
    _odd_ascii = "\x0b\x0c\x1c\x1d\x1e\x1f"

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.t.encode_batch(texts, add_special_tokens=False)]

    def _agree(self, new: set[str]) -> bool:
        """Whether one in CHECKED of the new chunks has the tokenizer's own ids; if not, the tokenizer takes over for good."""
        some = [c for i, c in enumerate(new) if i % CHECKED == 0]
        if self.one is None or [self.known[c] for c in some] == self._whole(some):
            return True
        self.one = None
        self.known.clear()
        return False

    def _learn(self, new: set[str]) -> None:
        known = self.known
        if self.one is None:
            todo = list(new)
            for at in range(0, len(todo), 4096):
                known.update(zip(todo[at : at + 4096], self._whole(todo[at : at + 4096]), strict=True))
            return
        one = self.one
        for c in new:
            stem = c.rstrip(".,;:!?")
            # the splitter always cuts between a letter and such marks
            if len(c) <= KEPT and stem[-1:].isalpha() and len(stem) < len(c):
                a, b = known.get(stem), known.get(tail := c[len(stem) :])
                if a is None:
                    a = known[stem] = array("I", one(stem)).tobytes()
                if b is None:
                    b = known[tail] = array("I", one(tail)).tobytes()
                known[c] = a + b
            else:
                known[c] = array("I", one(c)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, chunks, whole = self.known, [], []
        for i, text in enumerate(texts):
            if not text or not self._plain(text) or any(c in text for c in self._odd_ascii) or any(s in text for s in self.special):
                whole.append(i)
                chunks.append(None)
                continue
            chunks.append(text.replace(" ", "\x1f ").split("\x1f"))  # which no text has that comes here
        self._learn(new := set().union(*filter(None, chunks)).difference(known))
        if not self._agree(new):
            return self.encode(texts)
        out = [b"".join(map(known.__getitem__, parts)) if parts else b"" for parts in chunks]
        if len(known) > CACHE:
            self.known = known = {c: known[c] for parts in chunks if parts for c in parts}
        for c in new:
            if len(c) > KEPT:
                known.pop(c, None)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process, kept between tasks."""
    kept = worker_cache("packing")
    if path not in kept:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept[path] = ChunkEncoder(path, tokenizer_path(RANKS) if os.path.basename(path) == TOKENIZER else None)
    return kept[path]


PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long"
END = (0).to_bytes(4, "little")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of up to GROUP rows; of fewer where they hold GROUP_CHARS characters."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if len(ids) == GROUP or size >= GROUP_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def pieces_of(path: str, limit: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for ids, texts in _groups(batches):
            rows: list[list[int]] = [[], [], [], [], []]
            for doc, data in zip(ids, enc.encode(texts), strict=True):
                data += END
                n = len(data) // 4
                for start in range(0, n, limit):
                    piece = data[4 * start : 4 * (start + limit)]
                    for col, v in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return lean(cut, "packing")


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order of placing) and how many packs follow each."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # the shortest open packs are those with most room; what a piece leaves of it comes up again further down
        for space in range(limit, length - 1, -1):
            if not left:
                break
            for pattern in sorted(room.get(space, ())):
                if not left:
                    break
                take = min(left, room[space][pattern])
                left -= take
                room[space][pattern] -= take
                if not room[space][pattern]:
                    del room[space][pattern]
                room[space - length][(*pattern, length)] += take
        # new packs hold as many of the length as fit
        fit = limit // length
        if left >= fit:
            room[limit - fit * length][(length,) * fit] += left // fit
        if left % fit:
            room[limit - left % fit * length][(length,) * (left % fit)] += 1
        room = defaultdict(lambda: defaultdict(int), {s: p for s, p in room.items() if p})
    return sorted((p, n) for packs in room.values() for p, n in packs.items())


def seats(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks of a length in order of patterns."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


#: Pieces of a length that one task ranks, about.
RANKED = 1 << 17


def padding(length: int, limit: int = LIMIT) -> int:
    return 0 if length & (length - 1) == 0 else limit - length


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = rows.mapInArrow(pieces_of(path or tokenizer_path(), limit), PIECES)
    cut = scratch.save(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    lengths = scratch.save(cut.groupBy(F.col("length").alias("hl")).agg(F.count(F.lit(1)).alias("n")), "histogram")
    histogram = {r["hl"]: r["n"] for r in lengths.collect()}  # at most ``limit`` rows
    table = seats(shortest_pack_first(histogram, limit))
    seat_rows = spark.createDataFrame(table or [(0, 0, 0, 0, 0)], "seat_length long, lo long, hi long, base long, offset long")
    # pieces of a length are ranked in buckets of about RANKED rows
    spread = lengths.select("hl", F.ceil(F.col("n") / RANKED).alias("spread"))
    cut = cut.join(F.broadcast(spread), F.col("length") == F.col("hl")).drop("hl").withColumn("bucket", F.pmod(F.xxhash64("uid"), F.col("spread"))).drop("spread")
    counts = scratch.save(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = counts.select(F.col("length").alias("bl"), F.col("bucket").alias("bb"), (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.row_number().over(W.partitionBy("length", "bucket").orderBy("uid")) - 1
    ranked = cut.withColumn("local", local).join(before, (F.col("length") == F.col("bl")) & (F.col("bucket") == F.col("bb"))).withColumn("rank", F.col("local") + F.col("before"))
    # seats are bounded by the histogram of at most ``limit`` lengths, not by the data
    placed = ranked.join(F.broadcast(seat_rows), (F.col("length") == F.col("seat_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
