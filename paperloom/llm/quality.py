"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold_out, id_and_text

#: Labelled rows that the field is fitted on at most: those of the smallest hash of their id.
EXAMPLES = 4000
ROUNDS, RATE, RIDGE = 120, 0.1, 2e-3
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_DIGIT = b"0123456789"
_STOP = b".,;:!?"
_SYMBOL = b"#$%&*@~^=<>{}[]/\\_+|"
_HIGH = bytes(range(128, 256))
OWN = 15
#: Features of a line: its own, those of the lines before and after, and whether there are any.
WIDTH = 3 * OWN + 2


def line_features(line: bytes, seen: bool) -> list[float]:
    n = max(1, len(line))
    words = line.split()
    k = max(1, len(words))
    upper = len(line) - len(line.translate(None, _UPPER))
    letters = max(1, upper + len(line) - len(line.translate(None, _LOWER + _HIGH)))
    stops = len(line) - len(line.translate(None, _STOP))
    symbols = len(line) - len(line.translate(None, _SYMBOL))
    return [
        1.0, min(1.0, len(words) / 50), min(1.0, len(words) / 5), upper / letters, min(1.0, 2 * upper / letters),
        (len(line) - len(line.translate(None, _DIGIT))) / n, min(1.0, stops / k), symbols / n, min(1.0, 3 * symbols / k),
        min(1.0, line.count(b"!") / k), min(1.0, line.count(b"|") / k), 1 - len(set(words)) / k if words else 0.0,
        min(1.0, len(line) / k / 12), float(seen), float(not words),
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the lines' lengths in bytes (one at least)."""
    lines = text.encode("utf-8", "replace").split(b"\n")
    seen: set[int] = set()
    own = np.empty((len(lines), OWN), np.float32)
    for i, line in enumerate(lines):
        h = hash(line)
        own[i] = line_features(line, h in seen)
        seen.add(h)
    out = np.zeros((len(lines), WIDTH), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[1:, -2] = out[:-1, -1] = 1
    return out, np.array([max(1, len(x)) for x in lines], float)


@dataclass
class Field:
    """Weights of the label good (1) against bad (0), log-potentials of the first label and of neighbours, and the
    calibration of a document's mean marginal."""

    weights: np.ndarray
    first: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(good) of each line by forward and backward passes, scaled at each step."""
        e = np.exp(np.clip(x @ self.weights, -30, 30)).tolist()
        (p00, p01), (p10, p11) = np.exp(self.pair).tolist()
        a0, a1 = np.exp(self.first).tolist()
        a1 *= e[0]
        ahead = [(a0 / (a0 + a1), a1 / (a0 + a1))]
        for k in e[1:]:
            a0, a1 = ahead[-1]
            a0, a1 = a0 * p00 + a1 * p10, (a0 * p01 + a1 * p11) * k
            ahead.append((a0 / (a0 + a1), a1 / (a0 + a1)))
        b0 = b1 = 1.0
        out = [0.0] * len(e)
        for t in range(len(e) - 1, -1, -1):
            a0, a1 = ahead[t]
            out[t] = a1 * b1 / (a0 * b0 + a1 * b1)
            b1 *= e[t]
            b0, b1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
            s = b0 + b1
            b0, b1 = b0 / s, b1 / s
        return np.array(out)

    def mean(self, x: np.ndarray, lengths: np.ndarray) -> float:
        return float(self.marginals(x) @ lengths / lengths.sum())

    def score(self, text: str) -> tuple[float, int, int]:
        """The document's score, and how many lines are good and bad by their marginals."""
        x, lengths = features(text)
        p = self.marginals(x)
        good = int((p >= 0.5).sum())
        return self.calibrated(float(p @ lengths / lengths.sum())), good, len(p) - good

    def calibrated(self, mean: float) -> float:
        return 1 / (1 + math.exp(-(self.slope * logit(mean) + self.offset)))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _group(docs: list[tuple[np.ndarray, np.ndarray, int]]):
    """Documents of like numbers of lines, padded."""
    by: dict[int, list] = {}
    for d in docs:
        by.setdefault(max(2, 1 << (len(d[0]) - 1).bit_length()), []).append(d)
    for _, own in sorted(by.items()):
        n, size = len(own), max(len(d[0]) for d in own)
        x = np.zeros((n, size, WIDTH), np.float32)
        for i, d in enumerate(own):
            x[i, : len(d[0])] = d[0]
        yield x, np.array([len(d[0]) for d in own]), np.array([d[2] for d in own])


def train(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> Field:
    """Maximum likelihood with a ridge, by Adam over (features, lengths, label); every line bears its document's label."""
    field = Field(np.zeros(WIDTH), np.zeros(2), np.zeros((2, 2)))
    if not docs:
        return field
    groups = list(_group(docs))
    sizes = [WIDTH, 2, 4]
    theta, m, v = (np.zeros(sum(sizes)) for _ in range(3))
    total = len(docs)
    for step in range(1, ROUNDS + 1):
        w, first, pair = theta[:WIDTH], theta[WIDTH : WIDTH + 2], theta[WIDTH + 2 :].reshape(2, 2)
        g = np.zeros_like(theta)
        p = np.exp(pair)
        for x, n, y in groups:
            k, size = x.shape[:2]
            e = np.ones((k, size, 2))
            e[:, :, 1] = np.exp(np.clip(x @ w, -30, 30))
            on = np.arange(size)[None, :] < n[:, None]
            a = np.empty((size, k, 2))
            a[0] = np.exp(first) * e[:, 0]
            a[0] /= a[0].sum(1, keepdims=True)
            for t in range(1, size):
                nxt = (a[t - 1] @ p) * e[:, t]
                a[t] = np.where(on[:, t, None], nxt / nxt.sum(1, keepdims=True), a[t - 1])
            b = np.ones((k, 2))
            one = np.zeros((k, size))
            for t in range(size - 1, -1, -1):
                post = a[t] * b
                one[:, t] = np.where(on[:, t], post[:, 1] / post.sum(1), 0)
                if t:
                    eb = e[:, t] * b
                    both = a[t - 1][:, :, None] * p[None] * eb[:, None, :]
                    both /= both.sum((1, 2), keepdims=True)
                    g[WIDTH + 2 :] -= (both * on[:, t, None, None]).sum(0).ravel()
                    back = eb @ p.T
                    b = np.where(on[:, t, None], back / back.sum(1, keepdims=True), b)
            g[:WIDTH] += np.einsum("kt,ktf->f", (y[:, None] - one) * on, x)
            head = a[0] * b
            g[WIDTH : WIDTH + 2] += np.array([(y == 0).sum(), (y == 1).sum()]) - (head / head.sum(1, keepdims=True)).sum(0)
            g[WIDTH + 2] += ((n - 1) * (y == 0)).sum()
            g[WIDTH + 5] += ((n - 1) * (y == 1)).sum()
        g = g / total - RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field = Field(theta[:WIDTH], theta[WIDTH : WIDTH + 2], theta[WIDTH + 2 :].reshape(2, 2))
    z = np.array([logit(field.mean(x, n)) for x, n, _ in docs])
    y = np.array([d[2] for d in docs], float)
    slope, offset = 1.0, 0.0
    for _ in range(30):  # Newton's steps of a ridged logistic regression
        q = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        grad = np.array([((y - q) * z).sum() - (slope - 1), (y - q).sum() - offset])
        h = q * (1 - q)
        hess = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 1]])
        slope, offset = np.array([slope, offset]) + np.linalg.solve(hess, grad)
    field.slope, field.offset = float(slope), float(offset)
    return field


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field fitted on at most ``examples`` labelled rows that are not held out, of the smallest hash of their id.

    Of several labels of one id the least holds, of several rows of one id that of the smallest digest, so the driver reads no
    more documents than ``examples``, one partition after another. Without labels every score is one half.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("own_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("own_id is not null and quality in (0, 1)").where(~hold_out("own_id", 5, 0))
    chosen = known.groupBy("own_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("own_id"), "own_id").limit(examples)
    chosen = spark.createDataFrame(chosen.collect(), "own_id long, quality int")  # bounded by ``examples``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            own = [features(t) for t in texts]
            digests = [hashlib.md5(t.encode("utf-8", "replace")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digests), b.column(2), pa.array([x.tobytes() for x, _ in own]), pa.array([n.tobytes() for _, n in own])],
                ["doc_id", "digest", "y", "x", "n"],
            )

    own = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("own_id"))
    found = own.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, digest binary, y int, x binary, n binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct("digest", "y", "x", "n")).alias("e"))
    rows = sorted((r["doc_id"], r["e"]["x"], r["e"]["n"], r["e"]["y"]) for r in one.toLocalIterator())
    return train([(np.frombuffer(x, np.float32).reshape(-1, WIDTH), np.frombuffer(n), y) for _, x, n, y in rows])


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (the calibrated chance that the document is good), good_lines and bad_lines, one row for each input row.

    Every line gets P(good) from its own features and those of its neighbours; a document's score is their mean weighted
    by length. Null text is one empty line; repeated rows score alike; an empty table gives no rows. No text is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, examples, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [held.value.score(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([o[k] for o in own], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "score", "good_lines", "bad_lines"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, good_lines long, bad_lines long")
