"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised to words (A-Z lower-cased, maximal runs of digits, letters and non-ASCII
characters). The automaton runs over word numbers, so every document is scanned once, and a match is
mapped back to character offsets of the original text through the word positions.

A benchmark of more text than one automaton should take is dealt by item into parts. Each part is a pass of its own over
the documents, with one automaton, that leaves only the texts with hits; the part is released after it. The passes'
hits meet by a hash of the text, and only documents that may have one are shuffled for that.

Defined cases: null or empty texts have no words and no hits; items without words (or with a null
id or text) have no windows; repeated items count once per item_id; repeated documents are scanned
each on its own; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, maybe_in, release, sliced, surely_not_in
from .words import texts

WINDOW = 10
#: Bytes of benchmark text that one automaton takes; more is scanned by further passes.
MAX_AUTOMATON_BYTES = 32 << 20

#: Fixed character classes of the normalisation, one entry per byte.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: The same words in a text whose letters have kept their case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, item_ids array<string>, "
    "spans array<struct<begin:bigint,end:bigint>>"
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


#: Base of the digits that stand for a word number: keeps the children of an automaton's node few.
_BASE = 128


class Automaton:
    """Word numbers and the Aho-Corasick automaton of all windows; shared by a worker's tasks.

    A word number is spelled as digits, each place with symbols of its own, so that matches can only
    begin and end at word borders. Words that occur in no window can't be part of a match: only runs of
    known words, at least as long as the shortest window, are handed to the automaton.
    """

    def __init__(self, items: tuple[tuple[str, bytes], ...], window: int):
        self.number: dict[bytes, int] = {}
        wins: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in normal_words(text)]
            k = min(window, len(w))
            for i in range(len(w) - k + 1) if k else ():
                wins.setdefault(tuple(w[i : i + k]), set()).add(item)
        self.digits, size = 1, _BASE
        while size <= len(self.number):
            self.digits, size = self.digits + 1, size * _BASE
        self.shortest = min(map(len, wins), default=0)
        self.automaton = None
        if wins:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for win, owners in wins.items():
                self.automaton.add_word(self._spell(np.array(win)), (len(win), owners))
            self.automaton.make_automaton()

    def _spell(self, numbers: np.ndarray) -> tuple[int, ...]:
        places = [numbers // _BASE**d % _BASE + d * _BASE for d in range(self.digits)]
        return tuple(np.stack(places, 1).ravel().tolist())

    def scan(self, text: bytes) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, mask of hit words (None without hits), items found."""
        words = normal_words(text)
        n = len(words)
        if self.automaton is None or n < self.shortest:
            return n, None, set()
        numbers = np.fromiter(map(self.number.get, words, itertools.repeat(0)), np.int64, n)
        unknown = np.concatenate([[-1], np.flatnonzero(numbers == 0), [n]])
        edge, found = None, set()
        for i in np.flatnonzero(np.diff(unknown) > self.shortest):
            begin, end = unknown[i] + 1, unknown[i + 1]
            for last, (k, owners) in self.automaton.iter(self._spell(numbers[begin:end])):
                if edge is None:
                    edge = np.zeros(n + 1, np.int64)
                stop = begin + (last + 1) // self.digits
                edge[stop - k] += 1
                edge[stop] -= 1
                found |= owners
        return n, None if edge is None else np.cumsum(edge[:-1]) > 0, found


@functools.lru_cache(maxsize=1)
def _automaton(items: tuple, window: int) -> Automaton:
    """A worker keeps one automaton: passes use one each."""
    return Automaton(items, window)


def char_spans(text: str, mask: np.ndarray) -> list[dict]:
    """Character offsets [begin, end) in the original text of each run of hit words."""
    at = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"begin": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]


def _n_parts(items: DataFrame, max_bytes: int) -> int:
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-size // max_bytes))


def _part(items: DataFrame, n: int, part: int):
    """The items of one of n parts (dealt by hash of item_id, about max_bytes of text) as a broadcast."""
    rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part).collect()
    return items.sparkSession.sparkContext.broadcast(tuple(sorted((r.item_id, r.text.encode()) for r in rows)))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")


_KEYS = ["k1", "k2"]


def _keyed(documents: DataFrame) -> DataFrame:
    """(row, k1, k2, body) of documents: all columns in a struct, 128 bits of hash of the text, and the text."""
    row = F.struct(*(F.col(f"`{x}`") for x in documents.columns)).alias("row")
    return documents.select(row, *(F.xxhash64(F.lit(i), "text").alias(k) for i, k in enumerate(_KEYS)), F.col("text").alias("body"))


def _hits(documents: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """(k1, k2, masks array<binary>, item_ids) of the texts in which windows of any of n parts occur, a pass a part."""
    docs, passes = _keyed(documents).select(*_KEYS, "body").where("body is not null"), []
    for part in range(n):
        held = _part(items, n, part)

        def run(batches, held=held):
            for batch in sliced(batches):
                a = _automaton(held.value, window)
                got = [(i, m, found) for i, (_, m, found) in enumerate(map(a.scan, texts(batch.column(2)))) if m is not None]
                at = pa.array([i for i, _, _ in got], pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array([np.packbits(m).tobytes() for _, m, _ in got], pa.binary()), pa.array([sorted(x) for _, _, x in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*_KEYS, "mask", "item_ids"])

        found = docs.mapInArrow(run, "k1 bigint, k2 bigint, mask binary, item_ids array<string>")
        passes.append(materialize(found.dropDuplicates(_KEYS), "hits"))
        held.destroy()
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    merged = materialize(every.groupBy(*_KEYS).agg(F.collect_list("mask").alias("masks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")), "hits")  # a row a part
    release(*passes)
    return merged


def _row(doc_id, n, mask, item_ids, text: bytes) -> tuple:
    return doc_id, n, 0 if mask is None else int(mask.sum()), item_ids, [] if mask is None else char_spans(text.decode(), mask)


def find_overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """Per document: words, hit words, items with an occurring window and their original spans.

    A benchmark of up to max_bytes is one narrow job: documents are neither shuffled nor sorted. A larger one takes a
    pass for each part of about max_bytes, and one more that puts their hits together.
    """
    items = _items(benchmark)
    n = _n_parts(items, max_bytes)
    names = ["doc_id", "n_words", "n_hit", "item_ids", "spans"]
    if n == 1:
        held = _part(items, 1, 0)

        def scan(batch):
            a, docs = _automaton(held.value, window), texts(batch.column(1))
            rows = [_row(i, k, m, sorted(x), t) for i, t, (k, m, x) in zip(batch.column(0).to_pylist(), docs, map(a.scan, docs))]
            yield dict(zip(names, map(list, zip(*rows)))) if rows else {x: [] for x in names}

        return arrow_map(documents.select("doc_id", "text"), scan, SCHEMA)

    hits = _hits(documents, items, n, window)
    docs = _keyed(documents.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "body", *_KEYS)
    maybe = maybe_in(docs, "k1", hits).join(hits, _KEYS, "left").select("doc_id", "body", "masks", "item_ids")
    never = surely_not_in(docs, "k1", hits).select("doc_id", "body", F.lit(None).cast("array<binary>").alias("masks"), F.lit(None).cast("array<string>").alias("item_ids"))

    def put_together(batch):
        rows = []
        for doc_id, t, masks, found in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            k = len(normal_words(t))
            mask = np.unpackbits(functools.reduce(np.bitwise_or, (np.frombuffer(m, np.uint8) for m in masks)), count=k).astype(bool) if masks else None
            rows.append(_row(doc_id, k, mask, found or [], t))
        yield dict(zip(names, map(list, zip(*rows)))) if rows else {x: [] for x in names}

    return arrow_map(never.unionByName(maybe), put_together, SCHEMA)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """Documents, with all their columns, that hold no benchmark window."""
    items = _items(benchmark)
    n = _n_parts(items, max_bytes)
    if n == 1:
        held, at = _part(items, 1, 0), documents.columns.index("text")

        def run(batches):
            for batch in sliced(batches):
                a = _automaton(held.value, window)
                yield batch.filter(pa.array([a.scan(t)[1] is None for t in texts(batch.column(at))], pa.bool_()))

        return documents.mapInArrow(run, documents.schema)

    hits = _hits(documents, items, n, window)
    docs = _keyed(documents).select("row", *_KEYS)
    maybe = maybe_in(docs, "k1", hits).join(hits, _KEYS, "left_anti")
    return surely_not_in(docs, "k1", hits).unionByName(maybe.select(docs.columns)).select("row.*")
