"""Collocations: frequent phrases scored by how much more often they occur than their parts would let expect.

Texts are cut into pieces at punctuation and pieces into words; a phrase lies within one piece. The first scan makes a
sketch: each task counts its phrases of one to MAX_WORDS words by hash bucket, hands the counts on as packed blocks of
buckets, and the sums of a block leave one bit a bucket: whether its count, an upper bound of each of its phrases',
reaches the least frequency. Buckets grow with the bytes of text up to 2^MAX_BITS, which bounds the broadcast bitmap
(64 MB); a fuller sketch lets more phrases through and changes no result.

The second scan works on shards, a language's next SHARD words in a task: phrases of the shard whose bound reaches the
frequency are its candidates and make up an automaton. In it each word is spelled in digits between delimiters, so that
a match can't begin inside a word, and the end of a piece is a word of no phrase. It runs over the shard once and counts
all matches, overlapping ones included. A task sums its shards' counts while they are few, Spark sums the tasks', and
only sums that reach the frequency are frequent phrases; so counts are exact.

Defined cases: a null text is empty, a null lang is `und`; a repeated row counts each time; a piece without words has no
phrases; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sliced
from .words import WordHashes, texts, window_hashes

LEAST, MAX_WORDS, SHARE, TOP = 10, 3, 50, 2000
#: Words of a shard, phrases whose sums a task holds; as powers of two: blocks of the sketch, bounds of its number of buckets.
SHARD, HELD, BLOCKS, MIN_BITS, MAX_BITS = 200_000, 200_000, 11, 18, 29
_BREAK = b"\xff"  # no byte of UTF-8 text: stands for the end of a piece
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if chr(b) in ".,;:!?\n\v\f\r" else b for b in range(256))
_DIGITS = "".join(map(chr, range(0x100, 0x120)))  # 32 of them
_GAP = " "


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words of a text, with _BREAK wherever a piece ends."""
    return text.translate(_PLAIN).replace(_BREAK, b" \xff ").split()


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words with breaks) of rows (lang, text) in shards of about size words; a longer text is a shard by itself."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in sliced(batches):
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            own = held.setdefault(lang, [])
            before = len(own)
            own += words_of(text)
            own.append(_BREAK)
            total += len(own) - before
            if len(own) >= size:
                yield lang, held.pop(lang)
                total -= len(own)
            elif total >= 2 * size:
                yield from held.items()
                held, total = {}, 0
    yield from held.items()


def _phrases(lang: str, h: np.ndarray, gap: np.uint64, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(begins, buckets) of the phrases of each length of a shard of word hashes."""
    own, out = np.uint64(WordHashes().of([lang.encode()])[0]), []
    at_gap = np.concatenate([[0], np.cumsum(h == gap)])
    for k in range(1, MAX_WORDS + 1):
        if len(h) < k:
            break
        at = np.flatnonzero(at_gap[k:] == at_gap[:-k])
        out.append((at, ((window_hashes(h, k) ^ own)[at] >> np.uint64(64 - bits)).astype(np.uint32)))
    return out


def _size_of(texts_: DataFrame) -> int:
    """Bits of the bucket number: two buckets to three bytes of text or so, between the bounds."""
    size = texts_.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(MAX_BITS, max(MIN_BITS, int(size // 2).bit_length()))  # more than BLOCKS + 3: a block's bits are whole bytes


def _packed(place: np.ndarray, n: np.ndarray, within: int) -> bytes:
    """Sorted places of a block and their counts up to 255: how many places share their high bits, low bits, counts."""
    high = np.bincount(place >> np.uint32(16), minlength=max(1, 1 << (within - 16)) if within > 16 else 1)
    return high.astype(np.uint32).tobytes() + place.astype(np.uint16).tobytes() + n.tobytes()


def _unpacked(packed: bytes, within: int) -> tuple[np.ndarray, np.ndarray]:
    parts = 1 << max(0, within - 16)
    high = np.frombuffer(packed, np.uint32, parts)
    n = int(high.sum())
    low = np.frombuffer(packed, np.uint16, n, 4 * parts).astype(np.int64)
    return low + np.repeat(np.arange(parts) << 16, high), np.frombuffer(packed, np.uint8, n, 4 * parts + 2 * n)


def sketch(corpus: DataFrame, least: int, bits: int) -> DataFrame:
    """(block int, bits binary): a bit for each bucket, set where at least so many phrases of corpus(lang, text) fall in it."""
    within = max(0, bits - BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        gap = hashes.of([_BREAK])[0]
        held: list[np.ndarray] = []
        rows = 0

        def blocks() -> pa.RecordBatch:
            bucket, n = np.unique(np.concatenate(held), return_counts=True)
            block = bucket >> np.uint32(within)
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            stop = np.append(edge[1:], len(block))
            place, n = bucket & np.uint32((1 << within) - 1), np.minimum(n, min(least, 255)).astype(np.uint8)
            packed = [_packed(place[a:b], n[a:b], within) for a, b in zip(edge, stop)]
            return pa.RecordBatch.from_arrays([pa.array(block[edge].astype(np.int32)), pa.array(packed, pa.binary())], names=["block", "packed"])

        for lang, words in _shards(batches, SHARD):
            for _, bucket in _phrases(lang, hashes.of(words), gap, bits):
                held.append(bucket)
                rows += len(bucket)
            if rows >= 8 * SHARD:
                yield blocks()
                held, rows = [], 0
        if rows:
            yield blocks()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << within, np.int64)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now:
                    if now is not None:
                        yield closed()
                    now, total = block, np.zeros(1 << within, np.int64)
                place, n = _unpacked(packed, within)
                total[place] += n  # places are distinct
        if now is not None:
            yield closed()

    parts = corpus.mapInArrow(count, "block int, packed binary").repartition("block").sortWithinPartitions("block")
    return parts.mapInArrow(add, "block int, bits binary")


def _in_sketch(held: bytes, bucket: np.ndarray) -> np.ndarray:
    at = np.frombuffer(held, np.uint8)[bucket >> np.uint32(3)]
    return (at >> (np.uint8(7) - (bucket & np.uint32(7)).astype(np.uint8))) & 1 == 1


def _spelled(ids: np.ndarray, width: int) -> str:
    """Delimited words: a gap before each word's digits, and one at the end."""
    shifts = 5 * np.arange(width - 1, -1, -1)
    chars = np.full((len(ids), width + 1), ord(_GAP), np.uint32)
    chars[:, 1:] = ((ids[:, None] >> shifts) & 31) + ord(_DIGITS[0])
    return chars.tobytes().decode("utf-32-le") + _GAP


def count_shard(lang: str, words: list[bytes], hashes: WordHashes, bits: int, held: bytes) -> tuple[list[bytes], list[int]]:
    """(phrases, occurrences) of a shard's candidates, counted by an automaton over all its words."""
    h = hashes.of(words)
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    n_ids = len(first)
    width = max(1, -(-(n_ids - 1).bit_length() // 5))
    begins, lengths = [], []
    for k, (at, bucket) in enumerate(_phrases(lang, h, hashes.of([_BREAK])[0], bits), 1):
        at = at[_in_sketch(held, bucket)]
        key = ids[at].astype(np.int64)
        for j in range(1, k):
            key = key * n_ids + ids[at + j]
        at = at[np.unique(key, return_index=True)[1]]  # n_ids < 2^21
        begins.append(at)
        lengths.append(np.full(len(at), k))
    begin, length = np.concatenate(begins), np.concatenate(lengths)
    if not len(begin):
        return [], []
    text = _spelled(ids, width)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    step = width + 1
    for i, (b, k) in enumerate(zip(begin.tolist(), length.tolist())):
        automaton.add_word(text[b * step : (b + k) * step + 1], i)
    automaton.make_automaton()
    counts = np.bincount(np.fromiter((i for _, i in automaton.iter(text)), np.int64), minlength=len(begin))
    phrases = [b" ".join(words[b : b + k]) for b, k in zip(begin.tolist(), length.tolist())]
    return phrases, counts.tolist()


def phrase_counts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of one to MAX_WORDS words that occur least times, and (lang, n) words of each lang."""
    corpus = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    bits = _size_of(corpus)
    rows = sketch(corpus, least, bits).toArrow()  # at most 2^MAX_BITS bits
    held = bytearray((1 << bits) // 8)
    for block, own in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()):
        held[block * len(own) : (block + 1) * len(own)] = own
    shared = documents.sparkSession.sparkContext.broadcast(bytes(held))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = WordHashes(), {}
        names = ["lang", "phrase", "words", "f"]

        def out() -> pa.RecordBatch:
            keys, f = list(sums), list(sums.values())
            columns = [pa.array([x for x, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([p.count(b" ") + 1 if p else 0 for _, p in keys], pa.int32()), pa.array(f, pa.int64())], names=names)

        for lang, words in _shards(batches, SHARD):
            sums[lang, b""] = sums.get((lang, b""), 0) + len(words) - words.count(_BREAK)
            for phrase, f in zip(*count_shard(lang, words, hashes, bits, shared.value)):
                sums[lang, phrase] = sums.get((lang, phrase), 0) + f
            if len(sums) >= HELD:
                yield out()
                sums.clear()
        if sums:
            yield out()

    sums = corpus.mapInArrow(scan, "lang string, phrase string, words int, f bigint").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    counts = materialize(sums.where(F.expr(f"words = 0 or f >= {least}")), "phrases")
    return counts.where("words > 0"), counts.where("words = 0").select("lang", F.col("f").alias("n"))


def collocations(documents: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first top phrases by score, then frequency, then phrase.

    A phrase of several words is cut into a first part and the rest; score is floor(10^6 a a / (l r)) of the cut that scores
    lowest (ties: the shortest first part), computed in decimals. A phrase goes if its words lie inside a longer one
    that has share per cent of its frequency.
    """
    counts, totals = phrase_counts(documents, least)
    many = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    part = lambda begin, n: F.array_join(F.slice(w, begin, n), " ")
    cuts = many.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    # parts occur at least as often as the whole, so their counts are there
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = {x: F.col(x).cast("decimal(16,0)") for x in "alr"}
    cuts = cuts.withColumn("top", wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", wide["l"] * wide["r"])
    cuts = cuts.withColumn("score", F.expr("top div below"))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = many.where("words > 2").select("lang", "words", F.col("a").alias("longer"), w.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inside = inside.select("lang", "longer", "w", "m", F.explode(F.expr("sequence(1, words - m + 1)")).alias("at"))
    inside = inside.select("lang", F.expr("array_join(slice(w, at, m), ' ')").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {share} * a"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a lang's phrases meet in one task only after most are gone
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
