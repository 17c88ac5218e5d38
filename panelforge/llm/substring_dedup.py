"""Substring deduplication by recompression: long passages that also start in an earlier document go.

Each document's words are named in rounds, runs of a word first and then neighbouring symbols, by hashes
of what they stand for. Names are the same everywhere in the corpus without any exchange, and whether two
symbols join depends only on their neighbours; so equal passages have equal symbol borders, except near
their ends. With RADIUS words of context a border is certain, and symbols have at most MAX_LEN words:
every window of WINDOW words has a border in its middle part, and the one with the smallest hash is the
window's anchor. Equal windows have equal anchors with the same CONTEXT words around them.

Anchors whose context occurs in several documents are matched by a shuffle. An anchor stands for a
segment: all consecutive windows it is the anchor of. Equal segments are settled as a whole, against the
smallest doc_id that has it; only where a context has different segments (at the ends of passages) one
segment of each kind is unrolled and its windows are verified one by one. So the work follows the number of
repeated passages, not of their pairs.

Defined cases: null and empty texts and texts under a window lose nothing; documents of over PIECE_WORDS words
are named in overlapping pieces, with the same result; documents with a null doc_id
neither lose nor take words; rows that repeat a doc_id are judged each but never against each other;
ties cannot arise, since a word goes only for a smaller doc_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, maybe_in, surely_not_in
from .words import WordHashes, mix, rolling_hashes, texts

WINDOW = 50
#: Words that decide about a border: 2 for runs, and twice the longest symbol for each of two rounds.
RADIUS = 2 + 2 * 2 + 2 * 4
MAX_LEN = 8
#: Words of documents that are named together.
CHUNK_WORDS = 1 << 16
#: Words of a longer document that are named together; positions in a piece have to fit into 24 bits.
PIECE_WORDS = 1 << 20

_U = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


class SpanHashes:
    """Hash of any span of a sequence of word hashes in constant time."""

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, h: np.ndarray):
        n = len(h) + 1
        self.down = self._table(_INVERSE, n)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h + _U(1)) * self._table(_BASE, n)[: len(h)])])

    @classmethod
    def _table(cls, base: int, n: int) -> np.ndarray:
        have = cls._powers.get(base)
        if have is None or len(have) < n:
            have = np.full(max(n, 2 * CHUNK_WORDS), base, _U)
            have[0] = 1
            have = cls._powers[base] = np.cumprod(have)
        return have

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(_U))


def borders(h: np.ndarray) -> np.ndarray:
    """First words of the symbols that a sequence of word hashes is named into (at most MAX_LEN words each)."""
    n = len(h)
    same = np.zeros(n + 1, bool)  # same[i]: words i-1 and i are equal
    same[1:n] = h[1:] == h[:-1]
    pair = np.zeros(n, bool)  # word i is the second of a run of exactly two
    pair[1:] = same[1:n] & ~same[: n - 1] & ~same[2:]
    at = np.flatnonzero(~pair)
    name = mix(h[at] + np.where(np.append(pair, False)[at + 1], _U(0xA0761D6478BD642F), _U(0)))
    for level in range(2):
        weight = np.zeros(len(at) + 1, _U)
        weight[1:-1] = mix(name[:-1] * _U(_BASE) + name[1:] + _U(level))
        joins = np.zeros(len(at), bool)  # symbol i is joined to the one before
        joins[1:] = (weight[1:-1] > weight[:-2]) & (weight[1:-1] > weight[2:])
        head = ~joins
        joined = np.append(joins[1:], False)[head]
        name = np.where(joined, weight[1:][head], name[head])
        at = at[head]
    return at


def anchors(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each segment; doc numbers keep windows inside documents."""
    n = len(h)
    last = n - WINDOW
    if last < 0:
        return (np.empty(0, np.int64),) * 3
    value = np.full(n, ~_U(0))
    at = borders(h)
    pad = np.concatenate([np.zeros(2, _U), h, np.zeros(2, _U)])
    around = mix(pad[at] * _U(3) + pad[at + 1] * _U(0x9E3779B97F4A7C15) + pad[at + 2] * _U(0xC2B2AE3D27D4EB4F) + pad[at + 3] * _U(_BASE))
    value[at] = (around >> _U(24) << _U(24)) | at.astype(_U)
    least, width, size = value[RADIUS : n - RADIUS + 1], 1, WINDOW - 2 * RADIUS + 1
    while 2 * width <= size:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = size - width
    least = np.minimum(least[: len(least) - rest], least[rest:])[: last + 1] if rest else least[: last + 1]
    anchor = (least & _U(0xFFFFFF)).astype(np.int64)
    inside = doc[: last + 1] == doc[WINDOW - 1 :]
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (doc[1 : last + 1] != doc[:last])
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    first, final = np.flatnonzero(begins), np.flatnonzero(ends)
    return anchor[first], first, final


def _chunks(docs: list[list[bytes]]):
    """Runs of documents of about CHUNK_WORDS words: (begin, end)."""
    begin, size = 0, 0
    for i, words in enumerate(docs):
        if i > begin and size + len(words) > CHUNK_WORDS:
            yield begin, i
            begin, size = i, 0
        size += len(words)
    yield begin, len(docs)


def _pieces(n: int, words: int):
    """Pieces (begin, end) of at most so many words of n that overlap by WINDOW - 1: each window is in one of them."""
    for begin in range(0, max(1, n - WINDOW + 1), words - WINDOW + 1):
        yield begin, min(n, begin + words)


def segments(documents: DataFrame) -> DataFrame:
    """(key, seg, doc_id, th, s1, s2): every anchor's context and segment, and its window starts."""
    hashes = WordHashes()

    def run(batch):
        ids, th = batch.column(0).to_pylist(), batch.column(2).to_numpy()
        split = [t.split() if i is not None else [] for i, t in zip(ids, texts(batch.column(1)))]
        split = [w if len(w) >= WINDOW else [] for w in split]
        for a, b in _chunks(split):
            sizes = np.array([len(w) for w in split[a:b]])
            if not sizes.sum():
                continue
            h = np.concatenate([hashes.of(w) for w in split[a:b] if w])
            doc = np.repeat(np.arange(a, b), sizes)
            start = np.cumsum(sizes) - sizes
            for low, high in _pieces(len(h), PIECE_WORDS):
                # a border depends on words of its window only; a segment that a piece cuts is verified by windows
                anchor, first, final = anchors(h[low:high], doc[low:high])
                spans = SpanHashes(h[low:high])
                key = spans.of(anchor - RADIUS, anchor + RADIUS)
                seg = mix(spans.of(first, final + WINDOW) + (anchor - first).astype(_U) * _U(_BASE))
                d = doc[low:high][first]
                at = start[d - a] - low
                yield {"key": key.view(np.int64), "seg": seg.view(np.int64), "doc_id": np.array([x or 0 for x in ids], np.int64)[d], "th": th[d], "s1": first - at, "s2": final - at}

    return arrow_map(documents.select("doc_id", "text", F.hash("text").alias("th")), run, "key bigint, seg bigint, doc_id bigint, th int, s1 int, s2 int")


def _with_lists(documents: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents (doc_id, text, th) joined to their rows (doc_id, th, spans); others aren't shuffled."""
    found = maybe_in(documents.select("doc_id", "text"), "doc_id", lists)
    return found.withColumn("th", F.hash("text")).join(lists, ["doc_id", "th"]).select("doc_id", "text", "th", "spans")


def _windows(documents: DataFrame, kinds: DataFrame) -> DataFrame:
    """(window, doc_id, th, s): hashes of all windows of the given segments."""
    hashes = WordHashes()

    def run(batch):
        ids, th, spans = (batch.column(i).to_pylist() for i in (0, 2, 3))
        for i, t, text, own in zip(ids, th, texts(batch.column(1)), spans):
            w = rolling_hashes(hashes.of(text.split()), WINDOW)
            s = np.unique(np.concatenate([np.arange(x["s1"], x["s2"] + 1) for x in own]))
            yield {"window": w[s].view(np.int64), "doc_id": np.full(len(s), i), "th": np.full(len(s), t), "s": s}

    lists = kinds.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s1", "s2")).alias("spans"))
    return arrow_map(_with_lists(documents, lists), run, "window bigint, doc_id bigint, th int, s int")


def removed_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, th, spans array<struct<s1,s2>>): window starts whose windows start in a smaller doc_id."""
    keyed = segments(documents).repartition("key")
    several = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key")
    shared = materialize(keyed.join(several, "key", "left_semi"), "segments")

    # equal segments: settled by the smallest document that has it
    kinds = shared.groupBy("key", "seg").agg(F.min("doc_id").alias("first"))
    marked = shared.join(kinds, ["key", "seg"])
    whole = marked.where("doc_id > first").select("doc_id", "th", "s1", "s2")
    # contexts with several kinds of segments: the windows of each kind's first document are compared
    mixed = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    unrolled = marked.where("doc_id = first").join(mixed, "key", "left_semi").select("doc_id", "th", "s1", "s2")
    windows = materialize(_windows(documents, unrolled), "windows")
    least = windows.groupBy("window").agg(F.min("doc_id").alias("first"))
    single = windows.join(least, "window").where("doc_id > first").select("doc_id", "th", F.col("s").alias("s1"), F.col("s").alias("s2"))
    # a kind's later documents lose what its first document loses: their windows are equal
    spans = whole.unionByName(single)
    return spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s1", "s2")).alias("spans"))


def removed_mask(n: int, spans: list[dict]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [x["s1"] for x in spans], 1)
    np.add.at(edge, [x["s2"] + WINDOW for x in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document: its kept words, joined by one space."""
    lists = materialize(removed_spans(documents), "removed")
    docs = documents.select("doc_id", "text")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string"

    def whole(batch):
        split = [t.split() for t in texts(batch.column(1))]
        yield {"doc_id": batch.column(0), "n_words": [len(w) for w in split], "n_removed": np.zeros(len(split), np.int64), "kept": [b" ".join(w).decode() for w in split]}

    def cut(batch):
        n, removed, kept = [], [], []
        for text, spans in zip(texts(batch.column(1)), batch.column(3).to_pylist()):
            words = text.split()
            gone = removed_mask(len(words), spans or [])
            n.append(len(words))
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
        yield {"doc_id": batch.column(0), "n_words": n, "n_removed": removed, "kept": kept}

    touched = maybe_in(docs, "doc_id", lists).withColumn("th", F.hash("text")).join(lists, ["doc_id", "th"], "left").select("doc_id", "text", "th", "spans")
    return arrow_map(surely_not_in(docs, "doc_id", lists), whole, schema).unionByName(arrow_map(touched, cut, schema))
