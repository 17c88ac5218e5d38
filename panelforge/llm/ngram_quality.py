"""Quality rules: base rules and a hashed word and character n-gram logistic regression.

Words, word pairs and 4-grams of characters (code points) are hashed into three blocks of weights; a document's logit is the
sum of its mean weight in each block, so long texts cost no more memory than one batch. Weights are
fitted on a bounded sample of labelled rows, probabilities are calibrated (Platt) on a held-back fifth,
and whole texts are scored in Arrow batches against the fixed threshold KEEP_AT.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; without usable
labels the model's probability is the smoothed share of label 1; repeated rows count each; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map
from .doc_features import base_stats
from .labelled import labelled_sample
from .words import WordHashes, texts, window_hashes

MAX_TRAIN_ROWS = 3_000
BITS = 15
BLOCKS = 3
#: Fixed thresholds: least calibrated probability, least words, most repeated words in percent.
KEEP_AT = 0.3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
STEPS = 60
RATE = 0.3
RIDGE = 1e-4
#: Scale of the mean-pooled inputs: a share of a few hundredths then moves a logit by about one.
SCALE = 10.0

STATS_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, probability double, kept boolean"
)


@dataclass
class NgramModel:
    weights: np.ndarray  # BLOCKS x 2**BITS, float32
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, text: bytes, hashes: WordHashes) -> float:
        z = self.base
        for block, at in zip(self.weights, grams(text, hashes)):
            if len(at):
                z += SCALE * float(block[at].mean())
        return z

    def probability(self, z: float) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * z + self.shift, -30, 30))))


def grams(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of words, word pairs and character 4-grams of a whole text."""
    h = hashes.of(text.split())
    shift = np.uint64(64 - BITS)
    return h >> shift, window_hashes(h, 2) >> shift, character_grams(text)


def character_grams(text: bytes) -> np.ndarray:
    """Slots of every four neighbouring code points (none in shorter texts)."""
    if text.isascii():
        points = np.frombuffer(text, np.uint8).astype(np.uint32)
    else:
        points = np.frombuffer(text.decode(errors="replace").encode("utf-32-le"), np.uint32)
    n = max(0, len(points) - 3)
    quad = np.zeros(n, np.uint32)
    for i in range(4):  # a polynomial modulo 2**32: equal for equal characters only, but for clashes
        quad = quad * np.uint32(0x01000193) + points[i : i + n]
    return (quad ^ quad >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)


def _counted(batch):
    hashes = WordHashes()
    slots, shares = [], []
    for text in texts(batch.column(1)):
        at, share = [], []
        for b, got in enumerate(grams(text, hashes)):
            which, n = np.unique(got, return_counts=True)
            at.append(which.astype(np.int32) + (b << BITS))
            share.append(n.astype(np.float32) * (SCALE / max(1, len(got))))
        slots.append(np.concatenate(at).tobytes())
        shares.append(np.concatenate(share).astype(np.float32).tobytes())
    yield {"doc_id": batch.column(0), "label": batch.column(2), "slots": pa.array(slots, pa.binary()), "shares": pa.array(shares, pa.binary())}


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", train_rows=None, max_rows: int = MAX_TRAIN_ROWS) -> NgramModel:
    """Fit on at most max_rows labelled rows; their hashed counts come to the driver, texts don't."""
    sample = labelled_sample(documents, labels, label, max_rows, train_rows)
    got = arrow_map(sample.select("doc_id", "text", "label"), _counted, "doc_id bigint, label int, slots binary, shares binary").toPandas()
    got = got.sort_values(["doc_id", "label"])
    return fit([np.frombuffer(x, np.int32) for x in got["slots"]], [np.frombuffer(x, np.float32) for x in got["shares"]], got["label"].to_numpy(float))


def fit(slots: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray) -> NgramModel:
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    empty = np.zeros((BLOCKS, 1 << BITS), np.float32)
    if n < 20 or y.min() == y.max():
        return NgramModel(empty, base)
    back = np.arange(n) % 5 == 4
    pick = lambda mask: ([s for s, b in zip(slots, mask) if b], [v for v, b in zip(shares, mask) if b], y[mask])
    w, b = _descend(*pick(~back), base)
    bs, bv, by = pick(back)
    slope, shift = _platt(_margins(bs, bv, w) + b, by)
    w, b = _descend(slots, shares, y, base)
    return NgramModel(w.reshape(BLOCKS, -1), b, slope, shift)


def _margins(slots, shares, w) -> np.ndarray:
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    return np.bincount(row, np.concatenate(shares) * w[np.concatenate(slots)], len(slots))


def _descend(slots, shares, y, base) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the logistic loss with a small ridge."""
    at, val = np.concatenate(slots), np.concatenate(shares)
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    w, b = np.zeros(BLOCKS << BITS, np.float32), base
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(row, val * w[at], len(y)) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(at, val * r[row].astype(np.float32), len(w)).astype(np.float32) + RIDGE * w / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * r.sum(), 0.99 * vb + 0.01 * r.sum() ** 2
        rate = RATE / (1 + t / 40)
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w, float(b)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of y on z, with smoothed targets and a weak prior on slope 1."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t = np.where(y > 0, hi, lo)
    theta, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)

    def loss(c):
        m = x @ c
        return np.sum(np.logaddexp(0, m) - t * m) + 0.5 * (c[0] - 1) ** 2 + 0.005 * c[1] ** 2

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (p - t) + np.array([theta[0] - 1.0, 0.01 * theta[1]])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1.0, 0.01]), g)
        while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta - step
    return float(max(theta[0], 0.05)), float(theta[1])


def judge(documents: DataFrame, model: NgramModel, keep_at: float = KEEP_AT) -> DataFrame:
    """Base statistics, base verdict, calibrated probability and kept flag of every document."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    hashes = WordHashes()

    def run(batch):
        m = held.value
        docs = texts(batch.column(1))
        stats = np.array([base_stats(t, hashes) for t in docs], np.int64).reshape(len(docs), 5)
        failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])
        p = np.array([m.probability(m.logit(t, hashes)) for t in docs], float)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        yield {"doc_id": batch.column(0), **{k: stats[:, i] for i, k in enumerate(names)}, "base_failed": failed, "probability": p, "kept": ~failed & (p >= keep_at)}

    return arrow_map(documents.select("doc_id", "text"), run, STATS_SCHEMA)
