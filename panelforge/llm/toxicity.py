"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding disguises.

Texts are lower-cased, look-alike letters of other scripts become Latin ones, and digits and signs
that stand for letters inside words are put back. One automaton finds lexicon entries (whole words,
or word beginnings) and exception phrases; an entry inside an exception phrase doesn't count. The
weights are summed, normalised by the number of words, and turned into a probability.

Entries and weights are learned from a bounded sample of labelled rows (MAX_TRAIN_ROWS): patterns are
counted on the executors, the significant ones picked one by one, each judged on the documents that
the earlier ones leave unexplained, so that words which merely stand in copies of a toxic text gain
nothing. A short list of common insults needs less evidence.

Defined cases: null and empty texts have no words and score as a text without hits; without usable
labels the base list and a fixed calibration are used; repeated rows are scored each; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, release, sliced
from .labelled import labelled_sample

MAX_TRAIN_ROWS = 20_000
#: Least evidence (likelihood ratio) of a learned entry and of one in BASE.
MIN_EVIDENCE = 22.0
MIN_EVIDENCE_BASE = 4.0
PREFIXES = (4, 5, 6, 7)
REJECT_AT = 0.7

#: Common insults, phrases in which such words are harmless, look-alikes, substitutions.
BASE = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "retard", "bastard", "vermin")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pond scum", "sore loser", "dumb waiter", "dumb bell", "stupid simple", "savant idiot", "idiot savant")
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ı": "i", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF))
_ANY_FOLD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_INSIDE = re.compile(r"(?<![0-9@$!])[013457@$](?=[^\W\d_])|(?<=[^\W\d_])[013457@$!]{1,2}(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii() and _ANY_FOLD.search(text):
        text = text.translate(_FOLD)
    return _INSIDE.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), text)


@dataclass
class Lexicon:
    """weights: entry -> weight; an entry that ends in '*' is a word beginning."""

    weights: dict[str, float]
    theta: np.ndarray = field(default_factory=lambda: np.array([-3.0, 3.0, 1.0]))
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        a = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for entry, weight in self.weights.items():
            found.setdefault(entry.rstrip("*"), []).append((entry.endswith("*"), weight))
        for phrase in self.exceptions:
            found.setdefault(phrase, []).append((False, None))
        for key, what in found.items():
            a.add_word(key, (len(key), what))
        if found:
            a.make_automaton()
        return a if found else None

    def probability(self, hits: float, words: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(inputs(hits, words) @ self.theta, -30, 30))))


def inputs(hits: float, words: int) -> np.ndarray:
    """Calibration inputs: one, whether and how much was hit, and the weight per hundred words."""
    return np.array([1.0, np.log1p(hits), np.log1p(100 * hits / (words + 20))])


def scan(automaton, text: str) -> list[tuple[int, int, float]]:
    """(begin, end, weight) in the folded text of entries outside exception phrases."""
    if automaton is None:
        return []
    hits, free = [], []
    for last, (size, what) in automaton.iter(text):
        begin, end = last - size + 1, last + 1
        if begin and text[begin - 1].isalpha():
            continue
        ends = end == len(text) or not text[end].isalpha()
        for beginning, weight in what:
            if beginning or ends:
                (free if weight is None else hits).append((begin, end, weight))
    if not free:
        return hits
    free.sort(key=lambda f: f[0])
    starts, reach = [a for a, _, _ in free], list(itertools.accumulate((b for _, b, _ in free), max))
    return [h for h in hits if not (i := bisect.bisect_right(starts, h[0])) or reach[i - 1] < h[1]]  # inside no phrase


def n_words(text: str) -> int:
    return len(text.split())


def total(automaton, text: str | None) -> tuple[float, int]:
    folded = fold(text or "")
    return sum(w for _, _, w in scan(automaton, folded)), n_words(folded)


def patterns(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", train_rows=None, max_rows: int = MAX_TRAIN_ROWS) -> Lexicon:
    """Learn entries, weights and calibration from at most max_rows labelled rows."""
    sample = labelled_sample(documents, labels, label, max_rows, train_rows)
    sample = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).select("doc_id", "text", "label")  # copies count once
    sample = materialize(sample.repartition(32, "doc_id"), "sample")
    counts = arrow_map(sample, _pattern_counts, "pattern string, hit bigint, n bigint").groupBy("pattern").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    counts = materialize(counts, "patterns")
    size = counts.where("pattern = ''").first()
    if not size or not 0 < size.hit < size.n:
        return Lexicon(dict.fromkeys(BASE, 3.0))
    rate = size.hit / size.n
    wanted = counts.where(F.col("pattern") != "").where((F.col("hit") > 2 * rate * F.col("n")) & ((F.col("hit") >= 4) | F.col("pattern").isin(*BASE)) & (2 * F.col("hit") >= F.col("n")))
    names = sorted(r.pattern for r in wanted.collect())
    rows = arrow_map(sample, _incidence(names), "doc_id bigint, label int, words int, found array<int>").toPandas().sort_values(["doc_id", "label"])
    release(sample, counts)
    y = rows["label"].to_numpy(float)
    found = [np.asarray(x, np.int64) for x in rows["found"]]
    weights = choose(names, found, y)
    margins = np.zeros((len(y), 3))
    for part in (0, 1):  # each half is judged by a lexicon of the other half
        there = np.arange(len(y)) % 2 == part
        half = choose(names, [f for f, t in zip(found, there) if not t], y[~there])
        for i in np.flatnonzero(there):
            margins[i] = inputs(sum(half.get(names[k], 0.0) for k in found[i]), int(rows["words"].iloc[i]))
    return Lexicon(weights, _logistic(margins, y))


def _pattern_counts(batch):
    hit, n = Counter(), Counter()
    for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        got = patterns(text)
        got.add("")
        n.update(got)
        if y:
            hit.update(got)
    yield {"pattern": list(n), "hit": [hit[k] for k in n], "n": list(n.values())}


def _incidence(names: list[str]):
    number = {k: i for i, k in enumerate(names)}

    def run(batch):
        docs = batch.column(1).to_pylist()
        yield {
            "doc_id": batch.column(0),
            "label": batch.column(2),
            "words": [n_words(t) for t in docs],
            "found": [sorted(number[p] for p in patterns(t) if p in number) for t in docs],
        }

    return run


def choose(names: list[str], found: list[np.ndarray], y: np.ndarray) -> dict[str, float]:
    """Pick entries by evidence on the documents that earlier picks leave unexplained.

    Base words of the sample that no picked beginning covers keep the weight of all their documents, even if
    other entries explain these.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1)
    docs: list[list[int]] = [[] for _ in names]
    for i, f in enumerate(found):
        for k in f:
            docs[k].append(i)
    at = [np.array(d, np.int64) for d in docs]
    open_, out = np.ones(len(y), bool), {}

    def evidence(k: int) -> float:
        d = at[k][open_[at[k]]]
        n, h = len(d), y[d].sum()
        if not n or h <= rate * n:
            return 0.0
        p = h / n
        return 2 * (h * np.log(p / rate) + (n - h) * np.log(max(1e-12, 1 - p) / (1 - rate)))

    value = {k: evidence(k) for k in range(len(names))}
    floor = lambda k: MIN_EVIDENCE_BASE if names[k] in BASE else MIN_EVIDENCE
    while value:
        k = max(value, key=lambda j: (value[j], len(names[j]), names[j]))
        fresh = evidence(k)
        if fresh < value[k] - 1e-9:  # earlier picks explain part of it: look again
            if fresh < floor(k):
                del value[k]
            else:
                value[k] = fresh
            continue
        del value[k]
        if fresh < floor(k):
            continue
        hit = y[at[k]].sum()
        out[names[k]] = float(np.log((hit + 0.5) / (len(at[k]) - hit + 0.5)) - np.log(rate / (1 - rate)))
        open_[at[k]] = False
    begins = tuple(name[:-1] for name in out if name.endswith("*"))
    for k in (j for j, name in enumerate(names) if name in BASE and name not in out and len(at[j]) and not name.startswith(begins)):
        hit = y[at[k]].sum()
        out[names[k]] = float(np.log((hit + 0.5) / (len(at[k]) - hit + 0.5)) - np.log(rate / (1 - rate)))
    return {k: w for k, w in out.items() if w > 0}


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    theta = np.zeros(3)
    prior = np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (p - y) + prior @ theta
        theta = theta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, g)
    return theta


def _held(documents: DataFrame, lexicon: Lexicon):
    held, made = documents.sparkSession.sparkContext.broadcast(lexicon), {}

    def get():
        if "a" not in made:
            made["a"] = held.value.automaton()
        return held.value, made["a"]

    return get


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, hits, n_words, score) of every row: summed weights and the probability of toxicity."""
    get = _held(documents, lexicon)

    def run(batch):
        lex, a = get()
        got = [total(a, t) for t in batch.column(1).to_pylist()]
        yield {"doc_id": batch.column(0), "hits": [h for h, _ in got], "n_words": [n for _, n in got], "score": [lex.probability(*x) for x in got]}

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id bigint, hits double, n_words bigint, score double")


def reject(documents: DataFrame, lexicon: Lexicon, reject_at: float = REJECT_AT) -> DataFrame:
    """Documents, with all their columns, that score under reject_at."""
    get, at = _held(documents, lexicon), documents.columns.index("text")

    def run(batches):
        lex, a = get()
        for batch in sliced(batches):
            keep = [lex.probability(*total(a, t)) < reject_at for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
