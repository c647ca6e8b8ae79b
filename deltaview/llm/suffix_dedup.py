"""Removal of long repeats with a run-compressed Burrows-Wheeler index.

A byte goes if a string of ``length`` bytes that covers it starts at two or more places.

1. Anchors. Of every window of ``length`` bytes the k-gram with the least hash is its anchor; equal
   windows have equal anchors at equal places. A window holds half of its other bytes either before
   its anchor or after it, and the anchor counts together with these bytes, so that a common line
   shorter than that gathers no regions. Windows in a row with one anchor form a region. Only the
   hashes of anchor and region move, dealt by anchor. A region that occurs twice as a whole is
   repeated throughout, and an anchor that occurs once has no repeated window.
2. Index. What is left are regions that share an anchor with others but are not equal to one: edges
   of repeats. Their bytes, and those of one region of each kind that they may match, are dealt by
   anchor. Each task joins anchors to texts of a few megabytes and builds the suffix order and the
   Burrows-Wheeler transform, keeps its runs, and samples the match length at the ends of runs
   alone: in text order a match shortens by one a step unless a run ends there (the irreducible LCP
   lemma), so the statistics of all positions stream from the samples. Positions whose longest match
   with another position reaches ``length`` are repeats.
3. Marks. Repeats of a text are merged and cut out of it.

``passage`` words in a row that another row's text holds too are counted beside that and never cut:
a passage of 50 words is often shorter than ``length`` bytes. Windows of words have anchors and
regions of their own; words are compared, not what stands between them. Regions that occur in two
texts are shared as a whole, and of the edges the windows' hashes are dealt by anchor. Words are
named by 64 bits, windows by 128.

Equal texts are one: of texts with copies every window is repeated. Texts are named by a 64-bit hash.

Defined results: null texts count as empty; texts shorter than ``length`` keep everything; rows that
repeat an id are texts each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaview.llm._rows import fetch
from deltaview.llm._store import Scratch, lean, partitions

LENGTH, GRAM = 400, 32
#: Bytes of text whose equal regions are found at once, and bytes of regions that share an index.
BUFFER, CHUNK = 4 << 20, 1 << 19
#: Bits for a position in a buffer; a buffer and one more piece of a text have room.
PLACE_BITS = 24
#: Bytes of text whose anchors or words are hashed at once, a longer word stands as its digest, and words of an anchor.
BLOCK, LONG_WORD, WORD_GRAM = 1 << 20, 4096, 8
#: Hashes of windows that are compared at once, and shares of a task's regions of words, of which it holds one.
WINDOWS, SHARES = 1 << 17, 16
#: The seed with which Spark's xxhash64 names strings.
SEED = 42

_U = np.uint64
_C = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5), _U(0xFF51AFD7ED558CCD)]


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes (a multiple of 8) from each position."""
    m = len(data) - gram + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(m, np.uint64)
    for i in range(gram // 8):
        h += words[8 * i : 8 * i + m] * _C[i % 4]
        h ^= h >> _U(31)
        h *= _C[4]
    return h ^ (h >> _U(29))


def window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least hash of each window of ``width`` hashes."""
    # always as many bits of the hash, so that a window has the same anchor in every buffer
    if len(h) > 1 << PLACE_BITS:
        raise ValueError("too long a buffer")
    bits = _U(PLACE_BITS)
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    n = len(h) - width + 1
    pad = -len(key) % width
    rows = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    return (least & ((_U(1) << bits) - _U(1))).astype(np.int64)


ROW = np.dtype([("anchor", "<u8"), ("region", "<u8"), ("name", "<i8"), ("start", "<u4"), ("span", "<u2"), ("off", "<u2"), ("again", "u1")])


def regions(parts: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """parts: (name, position in its text, bytes). Regions of windows that lie in one part, as ROW records."""
    parts = [p for p in parts if len(p[2]) >= length]
    if not parts:
        return np.zeros(0, ROW)
    data = b"".join(p[2] for p in parts)
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = gram_hashes(data, gram)
    at = window_anchors(h, length - gram + 1)
    own = np.repeat(np.arange(len(parts)), sizes)[: len(at)]
    whole = np.arange(len(at)) + length <= (begin + sizes)[own]
    # windows that hold half of the other bytes before their anchor, and those that hold them after it
    half = (length - gram) // 2
    before = at - np.arange(len(at)) >= half
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (whole[1:] != whole[:-1]) | (before[1:] != before[:-1])
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    out = np.zeros(len(first), ROW)
    p = own[first]
    view = memoryview(data)
    hash_of = xxhash.xxh3_64_intdigest
    low, high = (at - half * before)[first], (at + gram + half * ~before)[first]
    out["anchor"] = [hash_of(view[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    out["region"] = [hash_of(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    out["name"] = np.array([x[0] for x in parts], np.int64)[p]
    out["start"] = first - begin[p] + np.array([x[1] for x in parts], np.int64)[p]
    out["span"] = last - first
    out["off"] = at[first] - first
    return out


def blocks(pieces: list[tuple[int, int, bytes]], size: int = BLOCK) -> Iterator[list[tuple[int, int, bytes]]]:
    """The pieces, as many at once as hold size bytes."""
    block, n = [], 0
    for piece in pieces:
        block.append(piece)
        n += len(piece[2])
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def segments(name: int, data: bytes, length: int, size: int = BLOCK) -> Iterator[tuple[int, int, bytes]]:
    """Pieces of a long text that overlap so that each window lies in exactly one as a start."""
    for at in range(0, max(1, len(data) - length + 1), size):
        yield name, at, data[at : at + size + length - 1]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A number for each byte, and an odd base whose powers tell places apart.
_BYTES = np.random.default_rng(4).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def running(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, from which any stretch has its hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from a to b, equal for equal values wherever they stand."""
    h = (sums[b] - sums[a]) * _power(len(sums))[1][a]
    h ^= h >> _U(32)
    h *= _C[4]
    h ^= h >> _U(29)
    h *= _C[1]
    return h ^ (h >> _U(32))


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the blobs, and the number of words of each blob."""
    data = b" ".join([b"", *blobs, b""])
    at = np.frombuffer(data, np.uint8)
    space = _SPACE[at]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    if len(first) and (last - first).max() > LONG_WORD:
        return word_hashes([b" ".join(w if len(w) <= LONG_WORD else hashlib.sha256(w).hexdigest().encode() for w in b.split()) for b in blobs])
    begin = np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])])
    return span_hashes(running(_BYTES[at]), first, last), np.diff(np.searchsorted(first, begin + 1))


def word_pieces(name: int, data: bytes, overlap: int, size: int = BLOCK) -> Iterator[tuple[int, int, bytes]]:
    """(name, number of its first word, words) of pieces of a text that have ``overlap`` words in common."""
    if len(data) <= size:
        yield name, 0, data
        return
    at, fresh, piece, held = 0, 0, [], 0
    for m in _WORD.finditer(data):
        word = m.group()
        if len(word) > LONG_WORD:
            word = hashlib.sha256(word).hexdigest().encode()
        piece.append(word)
        fresh += 1
        held += len(word) + 1
        if held >= size and len(piece) > overlap:
            yield name, at, b" ".join(piece)
            at += len(piece) - overlap
            piece = piece[len(piece) - overlap :]
            fresh, held = 0, 0
    if fresh:
        yield name, at, b" ".join(piece)


def word_regions(parts: list[tuple[int, int, bytes]], passage: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Regions of windows of ``passage`` words that lie in one part, as ROW records that count words; and (name, last start) of the parts that have windows."""
    words, sizes = word_hashes([p[2] for p in parts])
    names, starts = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
    ends = [(n, s + k - passage) for n, s, k in zip(names.tolist(), starts.tolist(), sizes.tolist(), strict=True) if k >= passage]
    if not ends:
        return np.zeros(0, ROW), ends
    gram = min(WORD_GRAM, passage)
    sums = running(words)
    places = np.arange(len(words) - gram + 1)
    at = window_anchors(span_hashes(sums, places, places + gram), passage - gram + 1)
    own = np.repeat(np.arange(len(parts)), sizes)
    begin = np.cumsum(sizes) - sizes
    whole = own[: len(at)] == own[passage - 1 :]
    half = (passage - gram) // 2
    before = at - np.arange(len(at)) >= half
    own = own[: len(at)]
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (whole[1:] != whole[:-1]) | (before[1:] != before[:-1])
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    out = np.zeros(len(first), ROW)
    p, at, before = own[first], at[first], before[first]
    out["anchor"] = span_hashes(sums, at - half * before, at + gram + half * ~before)
    out["region"] = span_hashes(sums, first, last + passage)
    out["name"] = names[p]
    out["start"] = first - begin[p] + starts[p]
    out["span"] = last - first
    out["off"] = at - first
    return out, ends


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """True where any of the sorted columns changes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _shared(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with equal regions together, the first of each kind, the kinds' numbers and whether a kind is in two texts."""
    rows = rows[np.lexsort((rows["region"], rows["anchor"]))]
    first = _firsts(rows["anchor"], rows["region"])
    at = np.flatnonzero(first)
    two = np.minimum.reduceat(rows["name"], at) != np.maximum.reduceat(rows["name"], at)
    return rows, first, np.cumsum(first) - 1, two | (np.maximum.reduceat(rows["again"], at) > 0)


def _same(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal regions together, and the number of the kind of each row in it."""
    order = np.lexsort((rows["off"], rows["span"], rows["region"], rows["anchor"]))
    s = rows[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["anchor"][1:] != s["anchor"][:-1]) | (s["region"][1:] != s["region"][:-1]) | (s["span"][1:] != s["span"][:-1]) | (s["off"][1:] != s["off"][:-1])
    return order, np.cumsum(new) - 1


def _marks(rows: np.ndarray) -> list[pa.Array]:
    start = rows["start"].astype(np.int64)
    return [pa.array(rows["name"]), pa.array(start), pa.array(start + rows["span"])]


#: What a row of the first pass is about: bytes, words, or all words of a text.
ABOUT_BYTES, ABOUT_WORDS, ABOUT_WHOLE = 0, 1, 2
_FOUND = ["about", "part", "rows", "name", "a", "b"]


def _found(about: int, name: pa.Array, a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    k = len(name)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, about, np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), name, a, b], _FOUND)


def _dealt(about: int, rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows by the part that their anchor goes to."""
    to = ((rows["anchor"] >> _U(32)) * _U(parts)) >> _U(32)
    rows, to = rows[order := np.argsort(to, kind="stable")], to[order]
    at = np.searchsorted(to, np.arange(parts + 1, dtype=np.uint64))
    full = [i for i in range(parts) if at[i + 1] > at[i]]
    k = len(full)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, about, np.int32)), pa.array(full, pa.int32()), pa.array([np.ascontiguousarray(rows[at[i] : at[i + 1]]).tobytes() for i in full], pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())],
        _FOUND,
    )


def _anchors(parts: int, length: int, passage: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[int] = set()
        todo: list[tuple[int, int, bytes]] = []
        words: list[tuple[int, int, bytes]] = []
        size = word_size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate([regions(block, length) for block in blocks(todo)])
            if not len(rows):
                return
            order, kind = _same(rows)
            rows, n = rows[order], np.bincount(kind)
            twice = n[kind] > 1
            first = np.ones(len(rows), bool)
            first[1:] = kind[1:] != kind[:-1]
            if twice.any():
                yield _found(ABOUT_BYTES, *_marks(rows[twice]))
            rows["again"] = twice
            yield _dealt(ABOUT_BYTES, rows[first], parts)  # of equal regions one goes on

        def flush_words() -> Iterator[pa.RecordBatch]:
            got, ends = [], []
            for block in blocks(words):
                rows, last = word_regions(block, passage)
                got.append(rows)
                ends += last
            if not ends:
                return
            yield _found(ABOUT_WHOLE, pa.array([n for n, _ in ends], pa.int64()), pa.array(np.zeros(len(ends), np.int64)), pa.array([b for _, b in ends], pa.int64()))
            rows, first, kind, two = _shared(np.concatenate(got))
            two = two[kind]
            if two.any():
                yield _found(ABOUT_WORDS, *_marks(rows[two]))
            rows["again"] = two
            yield _dealt(ABOUT_WORDS, rows[first | ~two], parts * SHARES)

        least = length if passage is None else min(length, 2 * passage - 1)
        for batch in batches:
            for text in batch.column(0):
                data = (text.as_py() or "").encode()
                if len(data) < least or (name := int(np.uint64(xxhash.xxh64_intdigest(data, seed=SEED)).view(np.int64))) in held:
                    continue
                held.add(name)
                if passage is not None:
                    for piece in word_pieces(name, data, passage - 1):
                        words.append(piece)
                        word_size += len(piece[2])
                        if word_size >= BUFFER:
                            yield from flush_words()
                            words, word_size = [], 0
                for piece in segments(name, data, length) if len(data) >= length else ():
                    todo.append(piece)
                    size += len(piece[2])
                    if size >= BUFFER:
                        yield from flush()
                        todo, size = [], 0
        if todo:
            yield from flush()
        if words:
            yield from flush_words()

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of regions that occur twice as a whole, and the regions whose bytes are needed (anchor not null)."""
    got = [np.frombuffer(r.as_py(), ROW) for batch in batches for r in batch.column(1)]
    if not got:
        return
    rows = np.concatenate(got)
    del got
    order, kind = _same(rows)
    rows = rows[order]
    n = np.bincount(kind)
    again = np.bincount(kind, weights=rows["again"]) > 0
    twice = (n > 1) | again
    marked = rows[twice[kind] & (rows["again"] == 0)]  # the others were marked where they were found
    first = np.ones(len(rows), bool)
    first[1:] = kind[1:] != kind[:-1]
    kinds, twice_kind = rows[first], twice
    new = np.ones(len(kinds), bool)
    new[1:] = kinds["anchor"][1:] != kinds["anchor"][:-1]
    group = np.cumsum(new) - 1
    open_kinds = np.bincount(group, weights=~twice_kind)
    need = kinds[(np.bincount(group)[group] > 1) & (open_kinds[group] > 0)]
    for out, wanted in ((marked, False), (need, True)):
        for at in range(0, len(out), 1 << 16):
            part = out[at : at + (1 << 16)]
            anchor = pa.array(part["anchor"].view(np.int64)) if wanted else pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([*_marks(part), anchor], ["name", "a", "b", "anchor"])


def _resolve_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part; marks of regions of words that two texts hold, and the regions whose windows are needed (anchor not null)."""
    got: list[np.ndarray] = []
    last = None

    def flush() -> Iterator[pa.RecordBatch]:
        rows, first, kind, two = _shared(np.concatenate(got))
        new = _firsts(rows["anchor"])
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        kinds = np.add.reduceat(first.astype(np.int64), at)
        texts = (np.minimum.reduceat(rows["name"], at) != np.maximum.reduceat(rows["name"], at)) | (np.maximum.reduceat(rows["again"], at) > 0)
        two = two[kind]
        # an open kind's rows all ask; of a shared kind one tells what it holds
        need = ((kinds > 1) & texts & (np.minimum.reduceat(two, at) == 0))[group] & (first | ~two)
        for take, wanted in ((two & (rows["again"] == 0), False), (need, True)):
            out, told = rows[take], two[take]
            for i in range(0, len(out), 1 << 16):
                part, flag = out[i : i + (1 << 16)], told[i : i + (1 << 16)]
                anchor = pa.array(part["anchor"].view(np.int64)) if wanted else pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([*_marks(part), anchor, pa.array(flag)], ["name", "a", "b", "anchor", "shared"])

    for batch in batches:
        for part, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != last and got:
                yield from flush()
                got = []
            last = part
            got.append(np.frombuffer(rows.as_py(), ROW))
    if got:
        yield from flush()


def _cut_words(passage: int):
    """name, text, wanted regions -> the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, names, starts, shared, hashes = [], [], [], [], []
            for name, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = np.concatenate([word_hashes([piece])[0] for _, _, piece in word_pieces(name, (text or "").encode(), 0)])
                # regions' words one after another, and the starts of their windows there
                a, b = (np.array([w[k] for w in wanted]) for k in "ab")
                n = b - a + 1
                held = np.concatenate([words[x : y + passage] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                begin = np.cumsum(n + passage - 1) - (n + passage - 1)
                ends = np.cumsum(n)
                at = np.repeat(begin - (ends - n), n) + np.arange(ends[-1])
                h = span_hashes(running(held), at, at + passage)
                for w, x, y in zip(wanted, (ends - n).tolist(), ends.tolist(), strict=True):
                    anchors.append(w["anchor"])
                    names.append(name)
                    starts.append(w["a"])
                    shared.append(w["shared"])
                    hashes.append(h[x:y].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors, pa.int64()), pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(shared, pa.bool_()), pa.array(hashes, pa.binary())], ["anchor", "name", "start", "shared", "hashes"]
            )

    return run


def _match_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; marks of the windows that another text holds under the same anchor."""
    rows: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        n = np.array([len(r[4]) // 8 for r in rows])
        own = np.repeat(np.arange(len(rows)), n)
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) - np.repeat(ends - n, n)
        anchor, name, start = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        told = np.array([r[3] for r in rows])
        h = np.frombuffer(b"".join(r[4] for r in rows), np.uint64)
        order = np.lexsort((h, anchor[own]))
        first = _firsts(anchor[own][order], h[order])
        at, names = np.flatnonzero(first), name[own][order]
        two = (np.minimum.reduceat(names, at) != np.maximum.reduceat(names, at)) | np.maximum.reduceat(told[own][order], at)
        hit = np.empty(len(h), bool)
        hit[order] = two[np.cumsum(first) - 1]
        hit &= ~told[own]
        # windows in a row are one mark
        before = np.concatenate([[False], hit[:-1]]) & (place > 0)
        after = np.concatenate([hit[1:], [False]]) & (place < n[own] - 1)
        a, b = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
        return pa.RecordBatch.from_arrays([pa.array(name[own[a]]), pa.array(start[own[a]] + place[a]), pa.array(start[own[b]] + place[b])], ["name", "a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[0] != last and size >= WINDOWS:
                yield flush()
                rows, size = [], 0
            last = row[0]
            rows.append(row)
            size += len(row[4]) // 8
    if rows:
        yield flush()


def _cut_regions(length: int):
    """name, text, wanted regions -> their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, names, starts, bodies = [], [], [], []
            for name, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = (text or "").encode()
                for w in wanted:
                    anchors.append(w["anchor"])
                    names.append(name)
                    starts.append(w["a"])
                    bodies.append(data[w["a"] : w["b"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(bodies, pa.binary())], ["anchor", "name", "start", "body"])

    return run


class RunLengthIndex:
    """Suffix order of texts that end in separators of their own, and its run-compressed transform."""

    def __init__(self, bodies: list[bytes]):
        sizes = np.array([len(b) for b in bodies])
        n = int(sizes.sum()) + len(bodies)
        symbols = np.empty(n, np.int64)
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + len(bodies)
        symbols[ends] = np.arange(len(bodies))
        self.symbols, self.begin, self.sizes = symbols, ends - sizes, sizes
        self.order = self._suffixes(symbols)
        before = symbols[self.order - 1]  # the transform; what stands before the first symbol is a separator
        heads = np.ones(n, bool)
        heads[1:] = before[1:] != before[:-1]
        self.run_heads = np.flatnonzero(heads)  # run-length form: first row and symbol of each run
        self.run_symbols = before[self.run_heads]
        self.samples = self._samples()

    @staticmethod
    def _suffixes(s: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; only suffixes that are still tied are sorted again."""
        n, base = len(s), int(s.max()) + 2
        pad = np.concatenate([s + 1, [0, 0]])
        key = (pad[:n] * base + pad[1 : n + 1]) * base + pad[2 : n + 2]
        order = np.argsort(key, kind="stable")
        k = 3
        sorted_key = key[order]
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while True:
            tied = ~new | np.concatenate([~new[1:], [False]])
            at = np.flatnonzero(tied)
            if not len(at):
                return order
            who = order[at]
            nxt = who + k
            second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
            first = rank[who]
            again = np.argsort(first * (n + 1) + second, kind="stable")
            who, first, second = who[again], first[again], second[again]
            order[at] = who
            fresh = np.ones(len(at), bool)
            fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            new[at] = fresh
            rank[who] = np.maximum.accumulate(np.where(fresh, at, 0))
            k *= 2

    def _samples(self) -> np.ndarray:
        """Length of the match with the suffix before, at the first row of each run."""
        rows = self.run_heads
        out = np.zeros(len(rows), np.int64)
        left = np.flatnonzero(rows > 0)
        a, b = self.order[rows[left]], self.order[rows[left] - 1]
        s = np.concatenate([self.symbols, np.full(16, -1)])
        n = len(self.symbols)
        step = np.arange(16)
        while len(left):
            same = s[np.minimum(a, n)[:, None] + step] == s[np.minimum(b, n)[:, None] + step]
            got = np.where(same.all(1), 16, np.argmin(same, axis=1))
            out[left] += got
            go = got == 16
            left, a, b = left[go], a[go] + 16, b[go] + 16
        return out

    def match_lengths(self) -> np.ndarray:
        """For each position the longest match of its suffix with any other suffix."""
        n = len(self.symbols)
        held = np.full(n, -1, np.int64)
        at = self.order[self.run_heads]
        held[at] = self.samples + at
        with_before = np.maximum.accumulate(held) - np.arange(n)  # streamed in text order
        in_rows = with_before[self.order]
        best = np.maximum(in_rows, np.concatenate([in_rows[1:], [0]]))
        out = np.empty(n, np.int64)
        out[self.order] = best
        return out


def repeats(bodies: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(body, first start, last start) of runs of starts whose ``length`` bytes start elsewhere too."""
    if not bodies:
        return []
    index = RunLengthIndex(bodies)
    long = index.match_lengths() >= length
    edge = np.flatnonzero(np.diff(np.concatenate([[False], long, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        i = int(np.searchsorted(index.begin, a, side="right")) - 1
        out.append((i, a - int(index.begin[i]), b - 1 - int(index.begin[i])))
    return out


def _index(length: int):
    """Rows sorted by anchor; whole anchors are gathered to chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int] = []
        starts: list[int] = []
        bodies: list[bytes] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = repeats(bodies, length)
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i, _, _ in found], pa.int64()), pa.array([starts[i] + a for i, a, _ in found], pa.int64()), pa.array([starts[i] + b for i, _, b in found], pa.int64())], ["name", "a", "b"]
            )

        for batch in batches:
            for anchor, name, start, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if anchor != last and size >= CHUNK:
                    yield flush()
                    names, starts, bodies, size = [], [], [], 0
                last = anchor
                names.append(name)
                starts.append(start)
                bodies.append(body)
                size += len(body)
        if bodies:
            yield flush()

    return run


def kept_bytes(data: bytes, starts: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs; starts: first and last start of repeats."""
    gone, spans, out, at = 0, 0, [], 0
    end = -1
    for a, b in sorted(starts):
        b = min(len(data), b + length)
        if a > end:
            out.append(data[at:a])
            spans += 1
            gone += b - a
            end = at = b
        elif b > end:
            gone += b - end
            end = at = b
    out.append(data[at:])
    return b"".join(out), gone, spans


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, gone, spans, shas = batch.column(0), [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, n, k = kept_bytes((text or "").encode(), [(m["a"], m["b"]) for m in marks], length)
                gone.append(n)
                spans.append(k)
                shas.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([names, pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], ["name", "gone", "spans", "sha"])

    return run


def find_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(rows, texts, marks, shared): rows has id, name, n_bytes, sha, copies; texts one text for each name with marks or needs; marks name, a, b; shared the same of windows of ``passage`` words that another row holds."""
    n = partitions(scratch.spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("name", F.xxhash64("text"))
    rows = scratch.save(base.select("id", "name", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")).withColumn("uid", F.monotonically_increasing_id()), "rows")
    classes = scratch.save(rows.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep")), "classes")
    found = scratch.save(base.select("text").mapInArrow(lean(_anchors(n, length, passage)), "about int, part int, rows binary, name long, a long, b long"), "anchors")
    about = lambda what: found.filter(F.col("about") == what)
    dealt = lambda what: about(what).filter("part IS NOT NULL").select("part", "rows").repartition(n, "part")
    local = lambda what: about(what).filter("part IS NULL").select("name", "a", "b")
    settled = scratch.save(dealt(ABOUT_BYTES).mapInArrow(lean(_resolve), "name long, a long, b long, anchor long"), "settled")
    marks = local(ABOUT_BYTES).unionByName(settled.filter("anchor IS NULL").select("name", "a", "b"))
    # of texts with copies all is repeated: their marks are not needed
    alone = classes.filter("copies = 1").select(F.col("name").alias("only"))
    marks = scratch.save(marks.join(alone, F.col("name") == F.col("only"), "left_semi"), "marks-1")
    wanted = settled.filter("anchor IS NOT NULL")
    names = marks.select("name").unionByName(wanted.select("name"))
    if passage is not None:
        settled_words = scratch.save(dealt(ABOUT_WORDS).sortWithinPartitions("part").mapInArrow(lean(_resolve_words), "name long, a long, b long, anchor long, shared boolean"), "settled-words")
        wanted_words = settled_words.filter("anchor IS NOT NULL")
        names = names.unionByName(wanted_words.select("name"))
    asked = names.distinct().join(classes.withColumnRenamed("name", "cn"), F.col("name") == F.col("cn")).select(F.col("name").alias("node"), F.col("rep").alias("id"), F.col("name").alias("key"))
    texts = fetch(base.select("id", F.col("name").alias("key"), "text"), scratch.save(asked, "asked")).withColumnRenamed("node", "name")
    texts = scratch.save(texts, "texts", compression="zstd")
    lists = wanted.groupBy(F.col("name").alias("wn")).agg(F.collect_list(F.struct("anchor", "a", "b")).alias("wanted"))
    cut = texts.join(lists, F.col("name") == F.col("wn")).select("name", "text", "wanted").mapInArrow(lean(_cut_regions(length)), "anchor long, name long, start long, body binary")
    cut = cut.repartition(n, "anchor").sortWithinPartitions("anchor")
    edges = scratch.save(cut.mapInArrow(lean(_index(length)), "name long, a long, b long"), "marks-2")
    marks = marks.unionByName(edges.join(alone, F.col("name") == F.col("only"), "left_semi"))
    rows = rows.join(classes.select(F.col("name").alias("cn"), "copies"), F.col("name") == F.col("cn")).drop("cn")
    if passage is None:
        return rows, texts, marks, None
    lists = wanted_words.groupBy(F.col("name").alias("wn")).agg(F.collect_list(F.struct("anchor", "a", "b", "shared")).alias("wanted"))
    cut = texts.join(lists, F.col("name") == F.col("wn")).select("name", "text", "wanted").mapInArrow(lean(_cut_words(passage)), "anchor long, name long, start long, shared boolean, hashes binary")
    cut = cut.repartition(n, "anchor").sortWithinPartitions("anchor")
    edges = scratch.save(cut.mapInArrow(lean(_match_words), "name long, a long, b long"), "shared-2")
    copied = classes.filter("copies > 1").select(F.col("name").alias("only"))
    shared = local(ABOUT_WORDS).unionByName(settled_words.filter("anchor IS NULL").select("name", "a", "b")).unionByName(edges)
    return rows, texts, marks, shared.unionByName(local(ABOUT_WHOLE).join(copied, F.col("name") == F.col("only"), "left_semi"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and with ``passage`` n_shared_words, the words in runs of so many that another row's text holds too."""
    if passage is not None and passage < 2:
        raise ValueError("a passage has two words at least")
    scratch = Scratch(docs.sparkSession, "suffix")
    rows, texts, marks, shared = find_repeats(docs, scratch, id_col, text_col, length, passage)
    lists = marks.groupBy(F.col("name").alias("mn")).agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    cut = texts.join(lists, F.col("name") == F.col("mn")).select("name", "text", "marks").mapInArrow(lean(_cut(length)), "name long, gone long, spans long, sha string")
    cut = scratch.save(cut, "cut").select(F.col("name").alias("cut_name"), "gone", "spans", F.col("sha").alias("cut_sha"))
    out = rows.join(cut, F.col("name") == F.col("cut_name"), "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    columns = [
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    ]
    if shared is not None:
        # words of a mark that no mark before it covers
        upto = Window.partitionBy("name").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
        new = F.greatest(F.lit(0), F.col("b") + passage - F.greatest("a", F.coalesce(F.max(F.col("b") + passage).over(upto), F.lit(0))))
        counts = shared.withColumn("new", new).groupBy(F.col("name").alias("shared_name")).agg(F.sum("new").alias("shared_words"))
        out = out.join(scratch.save(counts, "shared"), F.col("name") == F.col("shared_name"), "left")
        columns.append(F.coalesce("shared_words", F.lit(0)).cast("long").alias("n_shared_words"))
    return out.select(*columns)
