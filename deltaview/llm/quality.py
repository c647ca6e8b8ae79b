"""Quality by ordinal regression: a cumulative-link (logit) model on graded ratings.

P(grade <= k | x) = sigmoid(theta_k - w.x) with ordered thresholds theta and one weight vector w
shared by all grades. x is the mean of hashed features over a text: its words, the byte before each
space, byte classes in pairs, and bins of how often words repeat, anywhere and at once. The fit takes at most ``max_fit``
rated documents, those with the smallest hash of their id; every document is scored by its whole text.

Defined results: a null or empty text has the zero vector and gets the scores of the thresholds
alone; rows without a grade are not fitted; with fewer than two grades in the ratings every document
is accepted; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaview.llm._store import lean
from deltaview.session import ship

#: At most so many rated documents are fitted, none of them longer than so many bytes.
MAX_FIT, LONGEST_FIT = 6000, 1 << 20
WORD_DIMS = 1 << 15
CLASSES = 24
BINS = 16
DIMS = WORD_DIMS + 256 + CLASSES * CLASSES + 2 * BINS

#: Byte classes: white space, letters by case, digits, bytes beyond ASCII, and single punctuation marks.
_CLASS = np.full(256, 23, np.intp)
for _i, _set in enumerate((b"\t\n\x0b\x0c\r ", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)))):
    _CLASS[list(_set)] = _i
for _i, _c in enumerate(b".,!?|*#$%&@<>=/-:;"):
    _CLASS[_c] = 5 + _i


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: indices (they may repeat) and values."""
    data = text.encode()
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    n = len(words)
    idx = np.fromiter(map(zlib.crc32, words), np.uint32, n).astype(np.int64) % WORD_DIMS
    b = np.frombuffer(data, np.uint8)
    cls = _CLASS[b]
    ends = b[:-1][(cls[1:] == 0) & (cls[:-1] != 0)]
    last = np.bincount(ends, minlength=256) / n
    pairs = np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES) / max(1, len(b) - 1)
    bin_at = min(BINS - 1, int(BINS * len(set(words)) / n))
    echo_at = min(BINS - 1, int(BINS * 2 * np.count_nonzero(idx[1:] == idx[:-1]) / n))
    dense = np.sqrt(np.concatenate([last, pairs]))
    at = np.flatnonzero(dense)
    return (
        np.concatenate([idx, WORD_DIMS + at, [DIMS - 2 * BINS + bin_at, DIMS - BINS + echo_at]]),
        np.concatenate([np.full(n, 1.0 / np.sqrt(n)), dense[at], [1.0, 1.0]]),
    )


@dataclass
class CumulativeLink:
    weights: np.ndarray
    theta: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, one row per score."""
        return 1.0 / (1.0 + np.exp(np.clip(self.theta[None, :] - z[:, None], -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, steps: int = 250, rate: float = 0.15, ridge: float = 1e-5, dims: int = DIMS) -> CumulativeLink:
    """Maximum likelihood by Adam over all rows; gaps between thresholds stay positive."""
    n = len(rows)
    idx = np.concatenate([r[0] for r in rows]) if n else np.zeros(0, np.int64)
    val = np.concatenate([r[1] for r in rows]) if n else np.zeros(0)
    row = np.repeat(np.arange(n), [len(r[0]) for r in rows]) if n else np.zeros(0, np.int64)
    w = np.zeros(dims)
    share = np.array([(grades >= k).mean() if n else 0.5 for k in range(1, levels)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    # theta_0, then logs of the gaps
    p = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    state = [np.zeros(dims), np.zeros(dims), np.zeros(levels - 1), np.zeros(levels - 1)]
    one_hot = np.zeros((n, levels + 1))

    def thresholds() -> np.ndarray:
        return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])

    for step in range(1, steps + 1):
        theta = thresholds()
        z = np.bincount(row, weights=w[idx] * val, minlength=n)
        cum = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(z[:, None] - theta[None, :], -60, 60))), np.ones((n, 1))], axis=1)
        slope = cum * (1 - cum)
        up, down = cum[np.arange(n), grades + 1], cum[np.arange(n), grades]
        like = np.maximum(up - down, 1e-12)
        s_up, s_down = slope[np.arange(n), grades + 1] / like, slope[np.arange(n), grades] / like
        dz = (s_up - s_down) / n  # of minus the log likelihood
        one_hot[:] = 0
        one_hot[np.arange(n), grades + 1] -= s_up / n
        one_hot[np.arange(n), grades] += s_down / n
        dt = one_hot[:, 1:levels].sum(0)
        gw = np.bincount(idx, weights=dz[row] * val, minlength=dims) + ridge * w
        tail = np.cumsum(dt[::-1])[::-1]
        gp = np.concatenate([[tail[0]], tail[1:] * np.exp(p[1:])])
        for x, g, m, v in ((w, gw, state[0], state[1]), (p, gp, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return CumulativeLink(w, thresholds())


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grades, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 64):
            found = [features(t or "") for t in texts.slice(at, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [grades.slice(at, 64), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                ["grade", "idx", "val"],
            )


def train(docs: DataFrame, ratings: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_fit: int = MAX_FIT) -> CumulativeLink | None:
    """Fit on rated documents; None where fewer than two grades occur. ratings: id and grade 0 .. levels-1."""
    ship(docs.sparkSession)
    rated = ratings.select(F.col(id_col).alias("rated_id"), F.col(grade_col).cast("int").alias("grade")).filter("grade IS NOT NULL AND rated_id IS NOT NULL")
    rated = rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(max_fit)
    # at most max_fit rows of two numbers
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rated), F.col("id") == F.col("rated_id"))
    joined = joined.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST_FIT)
    got = joined.select("grade", "text").mapInArrow(lean(_featurise), "grade int, idx binary, val binary").collect()
    grades = np.array([r["grade"] for r in got], np.intp)
    if len(np.unique(grades)) < 2:
        return None
    return fit([(np.frombuffer(r["idx"], "<i4").astype(np.int64), np.frombuffer(r["val"], "<f4").astype(float)) for r in got], grades, levels)


def _scorer(weights: np.ndarray, theta: np.ndarray):
    model = CumulativeLink(weights, theta)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                z = np.zeros(len(part := batch.slice(at, 256)))
                for i, t in enumerate(part.column(1).to_pylist()):
                    idx, val = features(t or "")
                    z[i] = model.weights[idx] @ val if len(idx) else 0.0
                tails = model.tails(z)
                flat = pa.array(tails.ravel(), pa.float64())
                offsets = pa.array(np.arange(0, tails.size + 1, tails.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(1)), pa.ListArray.from_arrays(offsets, flat)], ["id", "expected_grade", "tails"])

    return score


def grade(docs: DataFrame, model: CumulativeLink | None, levels: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade and tails (P(grade >= k) for k = 1 ..) of every document."""
    ship(docs.sparkSession)
    if model is None:
        sure = F.array(*[F.lit(1.0)] * (levels - 1))
        return docs.select(F.col(id_col), F.lit(float(levels - 1)).alias("expected_grade"), sure.alias("tails"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(_scorer(model.weights.astype("f4"), model.theta)), "id long, expected_grade double, tails array<double>").withColumnRenamed("id", id_col)


#: Grades of the tables' labels: 0 poor, 1 good but toxic, 2 good.
LEVELS = 3
#: A document is accepted when it is at least grade 1 with this probability.
ACCEPT = 0.5


def label_grade(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, F.lit(0)).when(quality == 1, F.when(toxic == 1, F.lit(1)).otherwise(F.lit(2)))


def classify(docs: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None, accept: float = ACCEPT) -> DataFrame:
    """doc_id, expected_grade, p_good (tail probability of grade 1), accepted. Fitted on the labels of fit_on."""
    ratings = labels.select("doc_id", label_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = train(docs if fit_on is None else fit_on, ratings, LEVELS)
    out = grade(docs, model, LEVELS)
    p = F.element_at("tails", 1)
    return out.select("doc_id", "expected_grade", p.alias("p_good"), (p >= accept).alias("accepted"))
