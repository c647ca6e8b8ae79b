"""Toxicity by nearest labelled examples under the cosine of weighted TF-IDF vectors.

Examples are at most ``max_fit`` labelled documents of the training rows (smallest hash of their id),
none of them longer than LONGEST_FIT bytes, and up to a third of them toxic.
Terms are words of letters and digits and the first bytes of longer words. Every term of an example
is a dimension; none is left out by frequency, relevance or number. Its weight is (1 + log tf) times
idf, with document frequencies over all documents, times the correlation of the term with the
examples' labels (the root of chi-square over the number of examples) plus one over their number.
Words that no example holds have no dimension.

The examples form an inverted index whose postings lie in blocks with their largest weight; terms of
many examples are dense rows, which a matrix product scores for many texts at once. A search bounds
each block by its best dense score and the query's weights times these maxima, and opens blocks from
the best bound down until none can change the k nearest, so the neighbours are exact. Their labels
vote with weights that grow as the distance shrinks; the votes that each example gets from the others
calibrate the score.

Defined results: null and empty texts, and texts without any term of the index, have no neighbours
and get the calibrated share of toxic examples without terms; without labels of both classes every
score is the share of toxic labels (0 without any); ties go to the smaller example id; repeated rows
get equal scores; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaview.llm._store import worker_cache
from deltaview.session import ship

MAX_FIT, K = 2000, 15
#: One in so many examples is toxic at most, where labels have enough of them; calibration undoes what that adds.
TOXIC_SHARE = 3
#: Longer texts than this many bytes are no examples; they are scored like all others.
LONGEST_FIT = 1 << 20
BLOCK = 64
#: Postings a run, on the mean of a text's terms, up to which a search opens all blocks without bounds.
FEW = 8
#: A term of more than one in so many examples is a dense row of the index.
DENSE = 24
#: Bytes of texts whose words are looked up at once.
SLICE = 4 << 20
#: Lengths of word beginnings that are terms.
HEADS = (4, 5, 6, 7)
THRESHOLD = 0.3

#: Upper case to lower case, and what is neither letter, digit nor beyond ASCII to a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32) for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def terms(text: str | None) -> list[bytes]:
    """Words and, for inflected and compound ones, their first bytes (HEADS of them) after a caret."""
    w = words(text)
    return w + [b"^" + x[:n] for n in HEADS for x in w if len(x) > n]


class Terms:
    """Finds the terms of a vocabulary in texts; each distinct word of a slice of texts is looked up once, by Arrow."""

    def __init__(self, vocabulary: list[bytes]):
        heads = {n: [] for n in HEADS}
        whole = []
        for i, w in enumerate(vocabulary):
            (heads[len(w) - 1] if w.startswith(b"^") else whole).append(i)
        # a length of beginnings (0 for whole words), these without caret, and their numbers
        self.sets = [(n, pa.array([vocabulary[i][1:] for i in at], pa.large_binary()), np.array([*at, -1], np.int32)) for n, at in heads.items()]
        self.sets.append((0, pa.array([vocabulary[i] for i in whole], pa.large_binary()), np.array([*whole, -1], np.int32)))

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms in ascending order and how often each occurs."""
        return next(self.of_all([text]))

    def of_all(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``of``, for each text."""
        held, size = [], 0
        for text in texts:
            data = (text or "").encode()
            if size and size + len(data) > SLICE:
                yield from self._slice(held)
                held, size = [], 0
            if len(data) > SLICE:
                yield from self._slice(held)
                held = []
                yield self._long(data)
                continue
            held.append(data)
            size += len(data)
        yield from self._slice(held)

    def _long(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a long text by its stretches, which end at spaces."""
        data, at, parts = data.translate(_FOLD), 0, []
        while at < len(data):
            end = data.find(b" ", at + SLICE)
            end = len(data) if end < 0 else end
            parts += self._slice([data[at:end]])
            at = end
        found, which = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        times = np.zeros(len(found), np.int64)
        np.add.at(times, which, np.concatenate([n for _, n in parts]))
        return found, times

    def _slice(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not texts:
            return
        begin = np.cumsum([0] + [len(x) + 1 for x in texts])
        data = b" ".join(texts).translate(_FOLD)
        inside = np.zeros(len(data) + 2, bool)
        np.not_equal(np.frombuffer(data, np.uint8), 32, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, size = edge[::2], edge[1::2] - edge[::2]
        body = pa.py_buffer(data.translate(None, b" "))
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(0, np.cumsum(size))), body]).dictionary_encode()
        found = self._rows(words.dictionary)[words.indices.to_numpy()]
        known = found >= 0
        # where the words of each text begin among all, and its terms among those found
        at = np.append(0, np.cumsum(known.sum(1)))[np.searchsorted(first, begin)].tolist()
        found = found[known]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(found[a:b], return_counts=True)

    def _rows(self, words: pa.Array) -> np.ndarray:
        """The number of each word and of its beginnings, -1 where the vocabulary lacks it."""
        length = pc.binary_length(words).to_numpy()
        rows = np.empty((len(words), len(self.sets)), np.int32)
        for col, (n, held, number) in enumerate(self.sets):
            got = number[pc.index_in(pc.binary_slice(words, 0, n) if n else words, value_set=held).fill_null(-1).to_numpy()]
            rows[:, col] = np.where(length > n, got, -1)
        return rows


def terms_of(vocabulary: list[bytes]) -> Terms:
    """Terms of a vocabulary; a worker keeps the last one between tasks."""
    key, kept = hash(tuple(vocabulary)), worker_cache("toxicity")
    if kept.get("vocabulary") != key:
        kept.clear()  # before the next one takes its memory
        kept["vocabulary"], kept["terms"] = key, Terms(vocabulary)
    return kept["terms"]


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of ``size`` from ``first`` on."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


@dataclass
class BlockMaxIndex:
    """Postings by term, cut into runs of one block each; unit example vectors in blocks of BLOCK."""

    ids: np.ndarray
    labels: np.ndarray
    docs: np.ndarray  # postings in order of term and example
    weights: np.ndarray
    runs: np.ndarray  # first run of each term
    run_block: np.ndarray
    run_first: np.ndarray  # first posting of each run
    run_max: np.ndarray
    row: np.ndarray  # row of each term in the dense part, or -1
    _dense: np.ndarray | None = None

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: list[dict[int, float]], n_terms: int) -> BlockMaxIndex:
        """vectors: weights by term, of unit length or empty; examples are ordered by id."""
        return cls.of(ids, labels, [(np.array(list(v), np.int64), np.array(list(v.values()), float)) for v in vectors], n_terms)

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> BlockMaxIndex:
        order = np.argsort(ids, kind="stable")
        term = np.concatenate([vectors[i][0] for i in order])
        weight = np.concatenate([vectors[i][1] for i in order])
        doc = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])
        by = np.argsort(term, kind="stable")
        term, doc, weight = term[by], doc[by], weight[by]
        blocks = -(-len(ids) // BLOCK)
        key = term * blocks + doc // BLOCK
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        top = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        runs = np.searchsorted(key[first] // blocks, np.arange(n_terms + 1))
        many = np.bincount(term, minlength=n_terms) * DENSE > len(ids)
        row = np.where(many, np.cumsum(many) - 1, -1)
        return cls(ids[order], labels[order], doc, weight, runs, (key[first] % blocks).astype(np.int32), np.append(first, len(key)).astype(np.int32), top, row)

    def dense(self) -> np.ndarray:
        """Weights of the frequent terms, rows by examples."""
        if self._dense is None:
            self._dense = np.zeros((int(self.row.max(initial=-1)) + 1, len(self.ids)))
            for t in np.flatnonzero(self.row >= 0):
                at = slice(self.run_first[self.runs[t]], self.run_first[self.runs[t + 1]])
                self._dense[self.row[t], self.docs[at]] = self.weights[at]
        return self._dense

    def dense_scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms add to the cosines, queries by examples."""
        dense = self.dense()
        q = np.zeros((len(queries), len(dense)))
        for i, (t, w) in enumerate(queries):
            row = self.row[t]
            q[i, row[row >= 0]] = w[row >= 0]
        return q @ dense

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with any common term, nearest first."""
        terms, weights = np.array(list(query), np.int64), np.array(list(query.values()), float)
        return self.search(terms, weights, self.dense_scores([(terms, weights)])[0], k, without)

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """As nearest, given what the frequent terms add."""
        n = len(self.ids)
        rare = self.row[terms] < 0
        terms, weights = terms[rare], weights[rare]
        first, last = self.runs[terms], self.runs[terms + 1]
        start, length = self.run_first[first], self.run_first[last] - self.run_first[first]
        if length.sum() <= FEW * (last - first).sum():
            # runs so short that bounds cost what they would save: all blocks are opened
            at = spans(start, length)
            score = np.bincount(self.docs[at], weights=np.repeat(weights, length) * self.weights[at], minlength=n) + dense
            if without >= 0:
                score[without] = 0
            least = max(0.0, np.partition(score, n - k)[n - k]) if n > k else 0.0
        else:
            score, least = self._opened(weights, first, last - first, dense, k, without)
        who = np.flatnonzero((score > 0) & (score >= least - 1e-9))
        who = who[np.lexsort((who, -np.round(score[who], 12)))[:k]]
        return who, np.minimum(score[who], 1.0)

    def _opened(self, weights: np.ndarray, first: np.ndarray, size: np.ndarray, dense: np.ndarray, k: int, without: int) -> tuple[np.ndarray, float]:
        """Cosines in the blocks that can hold one of the k nearest, 0 in others, and the least of the k."""
        n, blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        run, w = spans(first, size), np.repeat(weights, size)
        block = self.run_block[run]
        best = np.zeros(blocks * BLOCK)
        best[:n] = dense
        bound = best.reshape(blocks, BLOCK).max(1) + np.bincount(block, weights=w * self.run_max[run], minlength=blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score, least = np.zeros(n), 0.0
        # the best blocks first, then all that could still change their k best
        for now in (order[: max(4, blocks // 8)], order[max(4, blocks // 8) :]):
            now = now[bound[now] >= least - 1e-12]
            if not len(now):
                break
            wanted = np.zeros(blocks, bool)
            wanted[now] = True
            hit = np.flatnonzero(wanted[block])
            of = run[hit]
            size = self.run_first[of + 1] - self.run_first[of]
            at = spans(self.run_first[of], size)
            fresh = np.bincount(self.docs[at], weights=np.repeat(w[hit], size) * self.weights[at], minlength=n) + dense
            members = np.repeat(wanted, BLOCK)[:n]
            score[members] = fresh[members]
            if without >= 0:
                score[without] = 0
            if n > k:
                least = max(0.0, np.partition(score, n - k)[n - k])
        return score, least


@dataclass
class Model:
    vocabulary: list[bytes]
    weight: np.ndarray  # of each term: idf and its relevance
    index: BlockMaxIndex | None
    prior: float  # the share of toxic examples, which stands in where neighbours are few
    none: float  # calibrated score without neighbours
    slope: float = 1.0
    shift: float = 0.0
    examples: list[tuple[bytes, bytes]] | None = None  # terms and their counts

    def learn(self, ids: np.ndarray, labels: np.ndarray, examples: list[tuple[bytes, bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Index the examples, which are ordered by id; their vectors."""
        self.examples = examples
        vectors = [self.vector(np.frombuffer(t, "<i4"), np.frombuffer(c, "<i4")) for t, c in examples]
        self.index = BlockMaxIndex.of(ids, labels, vectors, len(self.vocabulary))
        return vectors

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(counts)) * self.weight[terms]
        length = np.sqrt((v * v).sum())
        return terms, v / length if length else v

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine / (1.05 - cosine)
        return float((w @ self.index.labels[who] + self.prior) / (w.sum() + 1.0))

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """Score and evidence of texts, given the terms of each and their counts."""
        if self.index is None:
            return [(self.none, [])] * len(found)
        vectors = [self.vector(*f) for f in found]
        out = []
        for v, dense in zip(vectors, self.index.dense_scores(vectors), strict=True):
            who, cosine = self.index.search(*v, dense, K)
            if not len(who):
                out.append((self.none, []))
                continue
            p = min(max(self.vote(who, cosine), 1e-6), 1 - 1e-6)
            out.append((float(1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))), [int(i) for i in self.index.ids[who[:5]]]))
        return out


def platt(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit on log-odds, by Newton steps with a small ridge."""
    x = np.log(p.clip(1e-6, 1 - 1e-6) / (1 - p.clip(1e-6, 1 - 1e-6)))
    a, b = 1.0, 0.0
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((s - y) * x).sum() + 1e-2 * (a - 1), (s - y).sum() + 1e-2 * b])
        h = s * (1 - s)
        m = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(m, g)
        # a slope that separable votes would let grow without bound stays moderate
        a, b = min(max(a - np.clip(step[0], -1, 1), 0.05), 2.0), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


def in_fold(id_col: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)) == remainder


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, toxic = [], []
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = set(terms(text))
            word += found
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(toxic, pa.int32())], ["word", "toxic"])


def _frequencies(vocabulary: list[bytes]):
    """Document frequencies by term; documents under -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms_of(vocabulary)
        df = np.zeros(len(vocabulary), np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for found, _ in known.of_all(batch.column(0).to_pylist()):
                df[found] += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(df[hit], n))], ["term", "n"])

    return run


def _vectors(vocabulary: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(vocabulary)
        for batch in batches:
            found = list(known.of_all(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.astype("<i4").tobytes() for t, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], ["id", "toxic", "terms", "counts"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT) -> Model:
    """labels: the rows that may be learnt from."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic IN (0, 1) AND label_id IS NOT NULL")
    whole = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = min(whole.get(1, 0), max_fit // TOXIC_SHARE)
    drawn = [marked.filter(F.col("toxic") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(n) for label, n in ((1, most), (0, max_fit - most))]
    marked = drawn[0].unionByName(drawn[1])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # at most max_fit rows of two numbers
    examples = texts.join(F.broadcast(marked), F.col("id") == F.col("label_id")).filter(F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST_FIT).select("id", "toxic", "text").cache()
    total = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    share = whole.get(1, 0) / sum(whole.values()) if whole else 0.0
    if not n0 or not n1:
        examples.unpersist()
        return Model([], np.zeros(0), None, share, share)
    counts = examples.mapInArrow(_words, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").cast("double").alias("b"), F.sum(1 - F.col("toxic")).cast("double").alias("a"))
    counts = counts.toArrow().sort_by("word")  # the terms of at most max_fit documents
    vocabulary = counts["word"].to_pylist()
    a, b = counts["a"].to_numpy(), counts["b"].to_numpy()
    n = float(n0 + n1)
    chi2 = n * (a * (n1 - b) - b * (n0 - a)) ** 2 / ((a + b) * (n - a - b + 1e-9) * n0 * n1)
    held = examples.mapInArrow(_vectors(vocabulary), "id long, toxic int, terms binary, counts binary").toArrow().to_pylist()
    examples.unpersist()
    found = texts.select("text").mapInArrow(_frequencies(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, times = found["term"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[term[term >= 0]] = times[term >= 0]
    weight = np.log(1 + times[term < 0].sum() / (1 + df)) * (np.sqrt(chi2 / n) + 1 / n)
    model = Model(vocabulary, weight, None, share, share)
    held.sort(key=lambda r: r["id"])
    y = np.array([r["toxic"] for r in held], float)
    vectors = model.learn(np.array([r["id"] for r in held], np.int64), y, [(r["terms"], r["counts"]) for r in held])
    index = model.index
    votes, truth, empty = [], [], []
    for lo in range(0, len(vectors), 256):
        for i, dense in enumerate(index.dense_scores(vectors[lo : lo + 256]), lo):
            if not len(vectors[i][0]):
                empty.append(y[i])
                continue
            who, cosine = index.search(*vectors[i], dense, K, without=i)
            if len(who):
                votes.append(model.vote(who, cosine))
                truth.append(y[i])
    model.none = (sum(empty) + share) / (len(empty) + 1)
    if len(set(truth)) == 2:
        model.slope, model.shift = platt(np.array(votes), np.array(truth))
        # the sample may hold more toxic examples than all labels do
        model.shift += float(np.log(whole[1] * n0 / (whole[0] * n1)))
    return model


def packed(model: Model) -> bytes:
    """The model without what its counts and weights give again."""
    x = model.index
    body = (b" ".join(model.vocabulary), model.weight, model.prior, model.none, model.slope, model.shift)
    return zlib.compress(pickle.dumps((body, None if x is None else (x.ids, x.labels, model.examples))), 1)


def unpacked(data: bytes) -> tuple[Terms, Model]:
    """The model and its terms; a worker keeps the last one between tasks."""
    key, kept = hash(data), worker_cache("toxicity")
    if key not in kept:
        for old in kept.keys() - {"vocabulary", "terms"}:
            del kept[old]  # before the next one takes its memory
        (vocabulary, weight, *rest), index = pickle.loads(zlib.decompress(data))
        model = Model(vocabulary.split(), weight, None, *rest)
        if index is not None:
            ids, labels, examples = index
            model.learn(ids, labels, examples)
            model.examples = None
        known = terms_of(model.vocabulary)
        kept[key] = (known, model)
    return kept[key]


def _scorer(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = unpacked(data)
        for batch in batches:
            parts = [batch.slice(at, 256) for at in range(0, batch.num_rows, 256)]
            found = known.of_all(t for part in parts for t in part.column(1).to_pylist())
            for part in parts:
                got = model.scores(list(islice(found, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))], ["id", "score", "evidence"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and evidence (ids of the nearest examples, nearest first)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(packed(model)), "id long, score double, evidence array<long>").withColumnRenamed("id", id_col)
