"""Scores under a log-bilinear language model with exact corpus counts.

Texts are tokenised once. A task keeps the token sequences of a group of documents with the group's
own dictionary, and asks for the corpus counts of that dictionary: the words' hashes and their
counts in the training rows are dealt by hash, added up, and the sums go back to each group that
asked. All that moves is proportional to the dictionaries, and no count is left out.

The model's vocabulary is the most frequent training words (WORDS of them at most, each seen LEAST
times), the end of a text and one class for all other words. The predicted representation of a
context is C1 r(w-1) + C2 s(class of w-2); the score of a word is its product with the word's target
vector plus a bias. It is trained by noise-contrastive estimation with unigram noise on mini-batches
of every training token: each task goes on from the shared parameters with its own groups, and what
it changed is averaged by row, weighted by how often it met the row, so that all that moves is a copy
of the touched parameters a task. Small corpora are passed several times. Batched matrix products
over the whole vocabulary give the normaliser of every context, a table of a fixed size; with it each
token's log-probability is exact. A word of the class of others has the probability of the class
times its share (c + 0.5) / (n + 0.5 (v + 1)) of the class's training tokens.

Defined results: null and empty texts are the end alone; with no training rows counts are zero and
the model is uniform; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.llm._store import Scratch, partitions

#: Words of the model at most, and how often each occurs in training at least.
WORDS, LEAST = 16384, 5
#: Classes of w-2: so many frequent words each alone, the others by doublings of their rank, the end and the rest.
CLASSES, ALONE = 32, 18
#: Text bytes and documents that share a dictionary, about.
GROUP_BYTES, GROUP_DOCS = 8 << 20, 4096
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Stands for the end among word hashes.
END_HASH = xxhash.xxh3_64_intdigest(b"", seed=1)
DIM, BATCH, NOISE, RATE = 24, 4096, 128, 0.03
#: Times that the tasks' parameters are averaged; tokens that training draws at least, and passes over a text at most.
ROUNDS, LEAST_DRAWS, MOST_PASSES = 2, 4_000_000, 40

FORWARD = "kind string, grp string, part int, hashes binary, counts binary, ids binary, lengths binary, docs binary, held binary"


def held_out(doc: object, modulus: int, remainder: int) -> bool:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % modulus == remainder


def _tokenise(parts: int, modulus: int, remainder: int):
    """Per group: one forward row (sequences and dictionary) and an asking row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        lengths: list[int] = []
        held: list[bool] = []
        seqs: list[np.ndarray] = []
        known: dict[bytes, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(seqs)
            n = np.array(lengths, np.int64)
            words = list(known)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            hashes[0] = END_HASH
            train = np.repeat(~np.array(held), n)
            counts = np.bincount(ids[train], minlength=len(words)).astype("<i8")
            group = uuid.uuid4().hex
            to = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            # the dictionary is kept in part order, so that answers line up
            order = np.argsort(to, kind="stable")
            place = np.empty(len(order), "<i4")
            place[order] = np.arange(len(order))
            hashes, counts, to = hashes[order], counts[order], to[order]
            at = np.searchsorted(to, np.arange(parts + 1, dtype=np.uint64))
            full = [i for i in range(parts) if at[i + 1] > at[i]]
            k = len(full)
            forward = [hashes.tobytes(), None, place[ids].astype("<i4").tobytes(), n.tobytes(), np.array(docs, "<i8").tobytes(), np.array(held, bool).tobytes()]
            cols = {
                "kind": pa.array(["forward"] + ["ask"] * k),
                "grp": pa.array([group] * (k + 1)),
                "part": pa.array([-1, *full], pa.int32()),
                "hashes": pa.array([forward[0], *(hashes[at[i] : at[i + 1]].tobytes() for i in full)], pa.binary()),
                "counts": pa.array([None, *(counts[at[i] : at[i + 1]].tobytes() for i in full)], pa.binary()),
            }
            for name, v in zip(("ids", "lengths", "docs", "held"), forward[2:], strict=True):
                cols[name] = pa.array([v, *[None] * k], pa.binary())
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode().lower()
                if not known:
                    known[b" end"] = 0  # no word holds a space
                put = known.setdefault
                words = data.split()
                seq = np.fromiter((put(w, len(known)) for w in words), np.int32, len(words))
                seqs.append(np.append(seq, np.int32(0)))
                docs.append(NO_ID if doc is None else doc)
                lengths.append(len(words) + 1)
                held.append(held_out(doc, modulus, remainder))
                size += len(data)
                if size >= GROUP_BYTES or len(docs) >= GROUP_DOCS:
                    yield flush()
                    docs, lengths, held, seqs, known, size = [], [], [], [], {}, 0
        if docs:
            yield flush()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Total counts of the words asked for, to each group; then the parts' totals and their most frequent words."""
    asked: list[tuple[str, int, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for g, p, h, c in zip(*(batch.column(i) for i in range(4)), strict=True):
            asked.append((g.as_py(), p.as_py(), np.frombuffer(h.as_py(), np.uint64), np.frombuffer(c.as_py(), "<i8")))
    if not asked:
        return
    words, inverse = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([a[3] for a in asked]).astype(float), minlength=len(words)).astype("<i8")
    at = 0
    for i in range(0, len(asked), 64):
        rows = asked[i : i + 64]
        out = []
        for a in rows:
            out.append(total[inverse[at : at + len(a[2])]].tobytes())
            at += len(a[2])
        n = len(rows)
        yield pa.RecordBatch.from_pydict({"grp": pa.array([a[0] for a in rows]), "part": pa.array([a[1] for a in rows], pa.int32()), "counts": pa.array(out, pa.binary()), "hash": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int64()), "v": pa.nulls(n, pa.int64())})
    top = np.lexsort((words, -total))[: WORDS + 1]
    top = top[(total[top] >= LEAST) | (words[top] == np.uint64(END_HASH))]
    yield pa.RecordBatch.from_pydict(
        {
            "grp": pa.nulls(len(top) + 1, pa.string()),
            "part": pa.nulls(len(top) + 1, pa.int32()),
            "counts": pa.nulls(len(top) + 1, pa.binary()),
            "hash": pa.array([None, *words[top].view(np.int64).tolist()], pa.int64()),
            "n": pa.array([int(total.sum()), *total[top].tolist()], pa.int64()),
            "v": pa.array([int((total > 0).sum()), *[None] * len(top)], pa.int64()),
        }
    )


class Vocabulary:
    """Model words by rank, then the end, then the class of others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.end, self.other, self.size = hashes, len(hashes), len(hashes) + 1, len(hashes) + 2
        self.order = np.argsort(hashes)
        rank = np.arange(len(hashes))
        band = ALONE + np.floor(np.log2(np.maximum(rank, 1) / ALONE)).astype(np.int64)
        self.kind = np.append(np.where(rank < ALONE, rank, np.minimum(band, CLASSES - 3)), [CLASSES - 2, CLASSES - 1]).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Model word of each dictionary entry."""
        out = np.full(len(hashes), self.other, np.int32)
        if len(self.hashes):
            by = self.hashes[self.order]
            at = np.minimum(np.searchsorted(by, hashes), len(by) - 1)
            hit = by[at] == hashes
            out[hit] = self.order[at[hit]]
        out[hashes == np.uint64(END_HASH)] = self.end
        return out

    def contexts(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(w-1, class of w-2) of each token; texts begin after two ends."""
        first = np.zeros(len(words), bool)
        first[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = True
        one = np.empty_like(words)
        one[1:] = words[:-1]
        one[first] = self.end
        two = np.empty_like(words)
        two[1:] = one[:-1]
        two[first] = self.end
        return one, self.kind[two]


@dataclass
class LogBilinear:
    """Vectors of w-1 (r), of the class of w-2 (s) and of targets (q), both context matrices and biases."""

    r: np.ndarray
    s: np.ndarray
    q: np.ndarray
    c: np.ndarray  # C1 above C2
    b: np.ndarray

    PARTS = ("r", "s", "q", "c", "b")

    @classmethod
    def start(cls, unigram: np.ndarray, dim: int = DIM, seed: int = 7) -> LogBilinear:
        rng = np.random.default_rng(seed)
        near = np.vstack([np.eye(dim), np.eye(dim)]) + rng.normal(0, 0.02, (2 * dim, dim))
        parts = rng.normal(0, 0.1, (len(unigram), dim)), rng.normal(0, 0.1, (CLASSES, dim)), rng.normal(0, 0.1, (len(unigram), dim)), near, np.log(unigram)[:, None]
        return cls(*(x.astype(np.float32) for x in parts))

    def copy(self) -> LogBilinear:
        return LogBilinear(*(getattr(self, k).copy() for k in self.PARTS))

    def hat(self) -> tuple[np.ndarray, np.ndarray]:
        """What w-1 and the class of w-2 add to the predicted representation."""
        d = self.r.shape[1]
        return self.r @ self.c[:d], self.s @ self.c[d:]

    def log_normaliser(self, one: np.ndarray) -> np.ndarray:
        """log of the sum over all words of exp(score), for w-1 in ``one`` (rows) and each class of w-2."""
        a, b = self.hat()
        z = (a[one][:, None, :] + b[None, :, :]).reshape(-1, self.r.shape[1]) @ self.q.T + self.b[:, 0]
        top = z.max(1, keepdims=True)
        z -= top
        np.exp(z, out=z)
        return (top[:, 0].astype(np.float64) + np.log(z.sum(1, dtype=np.float64))).reshape(len(one), CLASSES)

    def scores(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, b = self.hat()
        out = np.empty(len(w))
        for lo in range(0, len(w), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            out[at] = np.einsum("ij,ij->i", a[one[at]] + b[two[at]], self.q[w[at]]) + self.b[w[at], 0]
        return out


class Trainer:
    """Noise-contrastive estimation by Adagrad on rows; remembers how often each row was met."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, rate: float = RATE, seed: int = 11):
        self.model, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.cum = np.cumsum(unigram / unigram.sum())
        self.log_noise = np.log(NOISE * unigram / unigram.sum()).astype(np.float32)
        self.seen = {k: np.zeros(len(getattr(model, k)), np.float32) for k in LogBilinear.PARTS}
        self.squares = {k: np.full(getattr(model, k).shape, 1e-3, np.float32) for k in LogBilinear.PARTS}

    def _step(self, part: str, at: np.ndarray, grad: np.ndarray) -> None:
        # short keys sort in linear time
        order = np.argsort(at.astype(np.uint16) if len(self.seen[part]) <= 1 << 16 else at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rows, g = at[first], np.add.reduceat(grad[order], first, axis=0)
        squares = self.squares[part]
        squares[rows] += g * g
        getattr(self.model, part)[rows] -= self.rate * g / np.sqrt(squares[rows])
        self.seen[part][rows] += np.diff(np.append(first, len(at)))

    def batch(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> None:
        m, d = self.model, self.model.r.shape[1]
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(self.cum) - 1)
        both = np.hstack([m.r[one], m.s[two]])
        hat = both @ m.c
        q_true, q_noise = m.q[w], m.q[noise]
        # data against noise: sigmoid(score - log(k noise))
        x_true = np.einsum("ij,ij->i", hat, q_true) + m.b[w, 0] - self.log_noise[w]
        x_noise = hat @ q_noise.T + (m.b[noise, 0] - self.log_noise[noise])
        d_true = 1 / (1 + np.exp(-np.clip(x_true, -30, 30))) - 1
        d_noise = 1 / (1 + np.exp(-np.clip(x_noise, -30, 30)))
        d_hat = d_true[:, None] * q_true + d_noise @ q_noise
        d_both = d_hat @ m.c.T
        words = np.concatenate([w, noise])
        gradients = (
            ("c", np.arange(2 * d), both.T @ d_hat),
            ("r", one, d_both[:, :d]),
            ("s", two, d_both[:, d:]),
            ("q", words, np.vstack([d_true[:, None] * hat, d_noise.T @ hat])),
            ("b", words, np.concatenate([d_true, d_noise.sum(0)])[:, None]),
        )
        for part, at, g in gradients:
            self._step(part, at, g)

    def learn(self, one: np.ndarray, two: np.ndarray, w: np.ndarray, passes: int = 1) -> None:
        for _ in range(passes):
            order = self.rng.permutation(len(w))
            for lo in range(0, len(w), BATCH):
                at = order[lo : lo + BATCH]
                self.batch(one[at], two[at], w[at])


CHANGED = "part string, block int, rows binary, weights binary, change binary"
#: Rows of parameters that move together.
PARAMETERS = 2048


def _fit(top: bytes, model: LogBilinear, unigram: np.ndarray, turn: int, passes: int):
    """Goes on from the shared parameters with this turn's share of each group's training tokens; emits what changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(np.frombuffer(top, np.uint64))
        trainer = Trainer(model.copy(), unigram, RATE / (1 + turn), 11 + turn)
        for batch in batches:
            for h, ids, n, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                lengths = np.frombuffer(n, np.int64)
                w = vocabulary.ids(np.frombuffer(h, np.uint64))[np.frombuffer(ids, "<i4")]
                one, two = vocabulary.contexts(w, lengths)
                mine = np.flatnonzero(np.repeat(~np.frombuffer(held, bool), lengths))
                mine = np.random.default_rng(len(w)).permutation(mine)[turn::ROUNDS]
                if len(mine):
                    trainer.learn(one[mine], two[mine], w[mine], passes)
        for part in LogBilinear.PARTS:
            seen = trainer.seen[part]
            for block in range(0, len(seen), PARAMETERS):
                rows = block + np.flatnonzero(seen[block : block + PARAMETERS])
                if len(rows):
                    change = (getattr(trainer.model, part)[rows] - getattr(model, part)[rows]).astype("<f2")
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (rows.astype("<i4"), seen[rows], change))], ["part", "block", "rows", "weights", "change"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of a block, averaged by row with the weights."""
    sums: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part, block, rows, weights, change in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            at, weight = np.frombuffer(rows, "<i4") - block, np.frombuffer(weights, np.float32).astype(float)
            x = np.frombuffer(change, "<f2").reshape(len(at), -1).astype(float)
            total, held = sums.setdefault((part, block), (np.zeros((PARAMETERS, x.shape[1])), np.zeros(PARAMETERS)))
            total[at] += weight[:, None] * x
            held[at] += weight
    for (part, block), (total, held) in sums.items():
        at = np.flatnonzero(held)
        mean = (total[at] / held[at, None]).astype("<f2")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in ((at + block).astype("<i4"), held[at].astype(np.float32), mean))], ["part", "block", "rows", "weights", "change"])


def train(forward: DataFrame, top: bytes, unigram: np.ndarray, n_train: int, parts: int) -> LogBilinear:
    """forward: hashes, ids, lengths, held. All rounds of training; parameters of the model's fixed size come to the driver."""
    model = LogBilinear.start(unigram)
    if not n_train:
        return LogBilinear(*(np.zeros_like(getattr(model, k)) for k in LogBilinear.PARTS))
    passes = min(MOST_PASSES, -(-LEAST_DRAWS // n_train))
    for turn in range(ROUNDS):
        changed = forward.select("hashes", "ids", "lengths", "held").mapInArrow(_fit(top, model, unigram, turn, passes), CHANGED)
        mean = changed.repartition(parts, "part", "block").mapInArrow(_average, CHANGED).toArrow()
        for r in mean.to_pylist():
            at, x = np.frombuffer(r["rows"], "<i4"), getattr(model, r["part"])
            x[at] += np.frombuffer(r["change"], "<f2").reshape(len(at), -1)
    return model


#: Words whose contexts are normalised together.
TOGETHER = 16


def normalisers(spark: SparkSession, model: LogBilinear, parts: int) -> np.ndarray:
    """log-normalisers of all contexts: words by classes, spread over tasks."""
    size = len(model.q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                z = model.log_normaliser(np.arange(block * TOGETHER, min(size, (block + 1) * TOGETHER)))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([z.astype("<f4").tobytes()], pa.binary())], ["block", "z"])

    blocks = -(-size // TOGETHER)
    got = spark.range(0, blocks, 1, max(1, min(parts, blocks))).mapInArrow(run, "block long, z binary").collect()
    return np.concatenate([np.frombuffer(r["z"], "<f4") for r in sorted(got, key=lambda r: r["block"])]).reshape(size, CLASSES)


def _score(top: bytes, model: LogBilinear, norm: np.ndarray, n_train: int, v_train: int, n_other: int, v_other: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(np.frombuffer(top, np.uint64))
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for h, ids, n, docs, held, answers in zip(*cols, strict=True):
                lengths = np.frombuffer(n, np.int64)
                counts = np.concatenate([np.frombuffer(a["counts"], "<i8") for a in sorted(answers, key=lambda a: a["part"])])
                hashes = np.frombuffer(h, np.uint64)
                if len(counts) != len(hashes):
                    raise ValueError("answers do not match the dictionary")
                own = vocabulary.ids(hashes)
                ids = np.frombuffer(ids, "<i4")
                log_c = np.log10(counts + 0.5)
                w = own[ids]
                one, two = vocabulary.contexts(w, lengths)
                within = np.where(own == vocabulary.other, log_c - np.log10(n_other + 0.5 * (v_other + 1)), 0.0)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                base = np.add.reduceat(log_c[ids], starts) - lengths * np.log10(n_train + 0.5 * (v_train + 1))
                log_p = (model.scores(one, two, w) - norm[one, two]) / np.log(10)
                score = np.add.reduceat(log_p + within[ids], starts)
                seen = np.add.reduceat((counts > 0)[ids].astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own_ids := np.frombuffer(docs, "<i8"), mask=own_ids == NO_ID), pa.array(np.frombuffer(held, bool)), pa.array(lengths), pa.array(seen), pa.array(np.full(len(lengths), n_train)), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 1) -> DataFrame:
    """One row per document; rows whose crc32(id as text) mod modulus is the remainder are not learnt from."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    n_parts = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.mapInArrow(_tokenise(n_parts, modulus, remainder), FORWARD).write.partitionBy("kind").option("compression", "zstd").parquet(scratch.path("groups"))
    groups = spark.read.schema(FORWARD).parquet(scratch.path("groups"))
    asks = groups.filter("kind = 'ask'").select("grp", "part", "hashes", "counts")
    answered = asks.repartition(n_parts, "part").mapInArrow(_answer, "grp string, part int, counts binary, hash long, n long, v long")
    answered = scratch.save(answered, "answers", compression="zstd")
    sums = answered.filter("v IS NOT NULL").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, v_train = int(sums["n"] or 0), int(sums["v"] or 0)
    end = np.uint64(END_HASH).view(np.int64)
    counted = answered.filter((F.col("hash").isNotNull()) & (F.col("n") > 0)).select("hash", "n", F.floor(16 * F.log2("n")).alias("bin"))
    # the uppermost bins of counts that hold WORDS + 1 words, and little more: no task sends its own most frequent words
    held, least = 0, 0
    for r in sorted(counted.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["bin"]):
        held, least = held + r["k"], r["bin"]
        if held > WORDS:
            break
    found = counted.filter(F.col("bin") >= least).orderBy(F.desc("n"), "hash").limit(WORDS + 1).collect()
    ends = [r["n"] for r in found if r["hash"] == end]
    if not ends:  # the end may be rarer than the words
        row = answered.filter(F.col("hash") == int(end)).first()
        ends = [row["n"]] if row else [0]
    words = [r for r in found if r["hash"] != end][:WORDS]
    top = np.array([r["hash"] for r in words], np.int64).view(np.uint64).tobytes()
    n_other = n_train - sum(r["n"] for r in words) - ends[0]
    v_other = max(0, v_train - len(words) - (ends[0] > 0))
    unigram = np.array([*(r["n"] for r in words), ends[0], n_other]) + 0.5
    forward = groups.filter("kind = 'forward'")
    model = train(forward, top, unigram / unigram.sum(), n_train, n_parts)
    norm = normalisers(spark, model, n_parts)
    replies = answered.filter("grp IS NOT NULL").groupBy(F.col("grp").alias("g")).agg(F.collect_list(F.struct("part", "counts")).alias("answers"))
    joined = forward.join(replies, F.col("grp") == F.col("g")).select("hashes", "ids", "lengths", "docs", "held", "answers")
    return joined.mapInArrow(_score(top, model, norm, n_train, v_train, n_other, v_other), RESULT).withColumnRenamed("doc_id", id_col)
