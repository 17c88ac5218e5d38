"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features (cyclic boosting, small learning rate), and each
tree is added into its feature's lookup table over quantile bins. Pairs of features are chosen by the
gain that a tree on both makes over the additive fit and get two-dimensional tables the same way.
Scoring looks up a bin for each feature and pair and adds the entries, for a whole batch at once.

Training takes a bounded sample of labelled rows (MAX_TRAIN_ROWS): its features, a few numbers per
row, come to the driver; texts don't. Scoring is narrow and covers every row.

Defined cases: null and empty texts have all-zero features and get the score of those; without
labelled rows (or with one class only) every score is the smoothed share of label 1; repeated rows
are scored each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map
from .doc_features import NAMES, features
from .labelled import labelled_sample
from .words import WordHashes, texts

#: Most labelled rows that are used for training.
MAX_TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
RATE = 0.1
#: Weight of the prior in each leaf and the least rows in one.
RIDGE = 4.0
MIN_LEAF = 8


@dataclass
class GamModel:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cut, x[:, j], "right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
            for (a, b), table in zip(self.pairs, self.pair_tables):
                out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins; place 0 is none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where((nl >= MIN_LEAF) & (nr >= MIN_LEAF), gain, 0)
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 0 else 0


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree with up to four leaves."""
    out, todo = np.zeros(len(g)), [(0, len(g), 0)]
    while todo:
        a, b, depth = todo.pop()
        _, cut = _best_cut(g[a:b], h[a:b], n[a:b]) if depth < 2 else (0, 0)
        if cut:
            todo += [(a, a + cut, depth + 1), (a + cut, b, depth + 1)]
        else:
            out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree on two features: one cut of the first, then one on each side."""
    best, out = 0.0, np.zeros(g.shape)
    for turn in (False, True):
        gg, hh, nn = (x.T if turn else x for x in (g, h, n))
        for cut in range(1, gg.shape[0]):
            gain, leaves = 0.0, np.zeros(gg.shape)
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs, ns = gg[side].sum(0), hh[side].sum(0), nn[side].sum(0)
                more, at = _best_cut(gs, hs, ns)
                gain += more
                for part in (slice(0, at), slice(at, None)) if at else (slice(None),):
                    leaves[side, part] = _leaf(gs[part].sum(), hs[part].sum())
            if gain > best:
                best, out = gain, leaves.T if turn else leaves
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> GamModel:
    """Cyclic boosting on features x and 0/1 labels y; the number of rounds is set on a held-back fifth."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if n < 20 or y.min() == y.max():
        return GamModel(base)
    back = np.arange(n) % 5 == 4
    trial = _boost(x[~back], y[~back], base, ROUNDS, x[back], y[back])
    return _boost(x, y, base, trial[1])[0]


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _boost(x, y, base, rounds, vx=None, vy=None) -> tuple[GamModel, int]:
    f = x.shape[1]
    m = GamModel(base, [_cuts(x[:, j], BINS) for j in range(f)])
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.cuts)]
    z, best, best_round = np.full(len(y), base), np.inf, rounds

    def sums(keys, size):
        p = 1 / (1 + np.exp(-z))
        return tuple(np.bincount(keys, w, size) for w in (y - p, p * (1 - p), None))

    for r in range(1, rounds + 1):
        for j in range(f):
            step = RATE * _tree(*sums(bins[j], len(m.tables[j])))
            m.tables[j] += step
            z += step[bins[j]]
        if vx is not None and r % 5 == 0 and (loss := _loss(m.logit(vx), vy)) < best:
            best, best_round = loss, r
    if vx is not None:
        return m, best_round
    m.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(f)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.pair_cuts)]

    def pair_sums(a, b):
        shape = (len(m.pair_cuts[a]) + 1, len(m.pair_cuts[b]) + 1)
        return tuple(s.reshape(shape) for s in sums(coarse[a] * shape[1] + coarse[b], shape[0] * shape[1]))

    gains = sorted(((-_pair_tree(*pair_sums(a, b))[0], a, b) for a in range(f) for b in range(a)))
    m.pairs = [(a, b) for g, a, b in gains[:PAIRS] if g < 0]
    m.pair_tables = [np.zeros((len(m.pair_cuts[a]) + 1, len(m.pair_cuts[b]) + 1)) for a, b in m.pairs]
    for _ in range(min(rounds, 20)):
        for (a, b), table in zip(m.pairs, m.pair_tables):
            step = RATE * _pair_tree(*pair_sums(a, b))[1]
            table += step
            z += step[coarse[a], coarse[b]]
    return m, rounds


def train(documents: DataFrame, labels: DataFrame, label: str, train_rows=None, max_rows: int = MAX_TRAIN_ROWS) -> GamModel:
    """Fit on a bounded sample of labelled rows; train_rows is a condition on doc_id."""
    sample = labelled_sample(documents, labels, label, max_rows, train_rows)
    got = arrow_map(sample.select("doc_id", "text", "label"), _featurise, "doc_id bigint, label int, x array<double>").toPandas()
    got = got.sort_values(["doc_id", "label"])
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return fit(x, got["label"].to_numpy(float))


def _featurise(batch):
    hashes = WordHashes()
    yield {"doc_id": batch.column(0), "label": batch.column(2), "x": [features(t, hashes) for t in texts(batch.column(1))]}


def score(documents: DataFrame, model: GamModel) -> DataFrame:
    """(doc_id, score) of every row: the model's probability of label 1."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    hashes = WordHashes()

    def run(batch):
        x = np.array([features(t, hashes) for t in texts(batch.column(1))], float).reshape(batch.num_rows, len(NAMES))
        yield {"doc_id": batch.column(0), "score": held.value.score(x)}

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id bigint, score double")
