"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are split by the vocabulary's pattern and each block of documents becomes one row: its distinct
words as byte arrays, and each document as numbers of words. An aggregate() folds ranked merges over each
distinct word once, with ranks looked up in a broadcast map, and the words' ids are put together by
document. Documents aren't shuffled; only the word counts of a bounded sample are. Decoding looks up the
binary piece of each id and concatenates the pieces.

The rank map is keyed by pairs of ids: Spark searches a map value linearly, so it is laid out as two
arrays by row displacement, in one row that is broadcast. The entry of (a, b) is at shift[a] + b and holds its owner
a above the rank, so that an exclusive or with the a that is asked for leaves the rank alone, or more than any rank.

Defined cases: null and empty texts have no ids; repeated rows are encoded each; ids outside the
vocabulary decode to nothing; other columns are ignored; an empty table gives an empty result. The fold takes
time quadratic in a word's length, so an unbroken word over LONG bytes takes the same merges from a heap in the task
that splits its text, in time n log n.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, sliced

#: Rank of a pair that doesn't merge.
NONE = 1 << 17
#: A part of a word in one long: what the rank map has of its merge above (35 bits), then its place in the word (11 bits,
#: enough for words of up to LONG bytes), then its id (17 bits).
_RANK, _ID, _PLACE = 28, (1 << 17) - 1, ((1 << 11) - 1) << 17
_STOP = NONE << _RANK
#: Owner of a slot without entry: no id is as large.
_NOBODY = 1 << 17
#: Bytes from which on a word isn't folded.
LONG = 512
#: UTF-8 bytes of documents in a block (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20
#: Frequent words that are encoded once for all blocks, and the bytes of documents they are counted in.
#: Both only bound the dictionary: every other distinct word is folded in its block.
DICTIONARY_WORDS = 400_000
SAMPLE_BYTES = 64 << 20

#: A block: its documents' ids, and as bytes the end of each among its words, the word numbers, the ids of known words and
#: where each begins; last the words that are to be folded.
BLOCK_SCHEMA = "doc_ids array<bigint>, ends binary, numbers binary, known binary, begins binary, words array<array<bigint>>"


#: What is made of an Arrow batch of (doc_id, ids) in the task that encodes it.
Each = Callable[[pa.RecordBatch], pa.RecordBatch]


class Vocabulary:
    """Ranks of a tiktoken-style file and the pattern that splits text before the merges."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1

    @functools.cached_property
    def pieces(self) -> list[bytes]:
        out = [b""] * self.size
        for piece, rank in self.ranks.items():
            out[rank] = piece
        return out

    def pairs(self) -> dict[int, dict[int, int]]:
        """Left id -> right id -> id of the two together, for every split of every piece."""
        out: dict[int, dict[int, int]] = {}
        get = self.ranks.get
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = get(piece[:i]), get(piece[i:])
                if a is not None and b is not None:
                    out.setdefault(a, {})[b] = rank
        return out

    @functools.cached_property
    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """shift by left id, owner and rank by slot.

        The closing id (size) has a shift too, and slots go on to the largest that can be asked for: no lookup is out of range.
        """
        rows = sorted(self.pairs().items(), key=lambda r: (-len(r[1]), r[0]))
        rights = [np.fromiter(row, np.int64, len(row)) for _, row in rows]
        total = sum(map(len, rights))
        span = 3 * total // 2
        owner = np.full(span + 4 * self.size + (1 << 17), -1, np.int32)
        shift = np.zeros(self.size, np.int64)
        draw = np.random.default_rng(0)
        long = sum(len(b) > 8 for b in rights)
        for (a, _), b in zip(rows[:long], rights):
            start = 0
            while True:  # places where no entry of the row meets another
                taken = np.zeros(1 << 16, bool)
                for x in b:
                    taken |= owner[start + x : start + x + len(taken)] >= 0
                if not taken.all():
                    break
                start += len(taken)
            shift[a] = start + taken.argmin()
            owner[shift[a] + b] = a
        # short rows all at once: those that clash draw again
        left = np.repeat([a for a, _ in rows[long:]], [len(b) for b in rights[long:]])
        right = np.concatenate([np.empty(0, np.int64), *rights[long:]])
        while len(left):
            shift[np.unique(left)] = draw.integers(0, span, len(np.unique(left)))
            slot = shift[left] + right
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            placed = ~np.isin(left, left[~first | (owner[slot] >= 0)])
            owner[slot[placed]] = left[placed]
            left, right = left[~placed], right[~placed]
        rank = np.zeros(len(owner), np.int64)
        for a, row in rows:
            rank[shift[a] + np.fromiter(row, np.int64, len(row))] = list(row.values())
        shift = np.append(shift, shift.max())
        end = int(shift.max()) + self.size + 1
        return shift, np.where(owner[:end] < 0, _NOBODY, owner[:end]), rank[:end]


def _with(state: Column, value: Column, body) -> Column:
    """body(state, x) with value evaluated once; a fold of one step, as transform() copies its results."""
    return F.aggregate(F.array(value), state, body)


def merge_all(word: Column, shift: Column, entry: Column) -> Column:
    """Ids of a word: ranked merges folded over its bytes, the lowest rank first, the leftmost of equals.

    The state is one array of longs, a part each: the rank of its merge with the next part, its place
    in the word and its id. Its least entry is the next merge.
    """

    def merge(a, b):
        return F.shiftleft(F.get(entry, F.get(shift, a) + b).bitwiseXOR(F.shiftleft(a, 17)), _RANK)

    def merged(state, m, p):
        before, after, new = F.get(state, p - 2), F.get(state, p + 1), F.shiftright(m, _RANK)
        left = merge(before.bitwiseAND(_ID), new).bitwiseOR(before.bitwiseAND(_PLACE | _ID))
        both = merge(new, after.bitwiseAND(_ID)).bitwiseOR(m.bitwiseAND(_PLACE)).bitwiseOR(new)
        return F.flatten(F.array(F.slice(state, F.lit(1), p - 2), F.array(left, both), F.slice(state, p + 2, F.size(state))))

    def step(state, _):
        at = lambda s, m: _with(s, F.array_position(s, m).cast("int"), lambda t, p: merged(t, m, p))
        return _with(state, F.array_min(state), lambda s, m: F.when(m >= _STOP, s).otherwise(at(s, m)))

    parts = F.aggregate(F.sequence(F.lit(4), F.size(word)), word, step, lambda s: F.slice(s, F.lit(2), F.size(s) - 2))
    return F.transform(parts, lambda x: x.bitwiseAND(_ID).cast("int"))


def packed_bytes(flat: np.ndarray, ends: np.ndarray, layout) -> tuple[np.ndarray, np.ndarray]:
    """Merge states of words of two bytes or more: flat ids, word i at ends[i]:ends[i+1].

    Each state has a closing part at either end, whose id merges with nothing. Returns the packed
    parts and the words' ends among them.
    """
    shift, owner, rank = layout
    slot = shift[flat[:-1]] + flat[1:]
    merges = np.full(len(flat), NONE, np.int64)
    merges[:-1] = np.where(owner[slot] == flat[:-1], rank[slot], NONE)
    merges[ends[1:] - 1] = NONE
    size = np.diff(ends)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - ends[word]
    states = np.full(len(flat) + 2 * len(size), _STOP | len(shift) - 1, np.int64)
    states[np.arange(len(flat)) + 2 * word + 1] = merges << _RANK | place << 17 | flat
    return states, ends + 2 * np.arange(len(ends))


def merge_long(word: bytes, base: np.ndarray, pairs: dict[int, int]) -> list[int]:
    """Ids of a long word: ranked merges from a heap, the lowest rank first, the leftmost of equals.

    pairs has the id of two ids together under left << 17 | right. A part is at the place of its first byte, linked with
    its neighbours; an entry of the heap whose part has gone or merges otherwise by now is passed over.
    """
    ids = base[np.frombuffer(word, np.uint8)].tolist()
    n, get = len(ids), pairs.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << 40 | i for i, r in enumerate(map(get, (a << 17 | b for a, b in itertools.pairwise(ids)))) if r is not None]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(heapq.heappop(heap), 1 << 40)
        j = after[i]
        if ids[i] < 0 or j == n or get(ids[i] << 17 | ids[j]) != r:
            continue
        ids[i], ids[j] = r, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (new := get(r << 17 | ids[k])) is not None:
                heapq.heappush(heap, new << 40 | i)
        h = before[i]
        if h >= 0 and (new := get(ids[h] << 17 | r)) is not None:
            heapq.heappush(heap, new << 40 | h)
    return [x for x in ids if x >= 0]


@functools.cache
def _members(kind: str) -> str:
    """The characters of a class below U+10000, as ranges for a character set of re."""
    every = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
    return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{kind}+", every))


def _spelled(pattern: str) -> str:
    """The pattern with \\p{L}, \\p{N}, \\s and \\S spelled out for re, as regex understands them."""
    in_set, out = False, []
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        if part in ("\\p{L}", "\\p{N}", "\\s"):
            part = _members(part) if in_set else f"[{_members(part)}]"
        elif part == "\\S" and not in_set:
            part = f"[^{_members(chr(92) + 's')}]"
        elif part[0] == "\\" and part[1:].isalnum():
            raise ValueError(part)
        elif part in "[]":
            in_set = part == "["
        out.append(part)
    return "".join(out)


def _finder(pattern: str):
    """findall of the pattern; texts of ASCII alone, and of characters below U+10000, take it with its classes spelled out."""
    general = regex.compile(pattern).findall
    ascii_ = re.sub(r"\\p\{([LN])\}", lambda m: {"L": "a-zA-Z", "N": "0-9"}[m[1]], pattern)
    if "\\p" in ascii_ or "\\P" in ascii_:
        return general
    ascii_ = re.sub(r"(?<!\[)(?<!\\s)(a-zA-Z|0-9)(?=\+)", r"[\1]", ascii_)
    plain = re.compile(ascii_, re.ASCII).findall
    try:
        short = re.compile(_spelled(pattern)).findall
    except ValueError:  # other classes
        short = general

    def find(text):
        if text.isascii():
            return plain(text)
        return short(text) if len(text.encode("utf-16-le")) == 2 * len(text) else general(text)

    return find


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _dictionary(vocab: Vocabulary, values: np.ndarray, sizes: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """word -> number, ids of all words, where each begins: the vocabulary's own words, and frequent ones given by their ids."""
    own = [(p.decode(), r) for p, r in vocab.ranks.items() if _is_text(p)]
    at = {w: i for i, (w, _) in enumerate(own)}
    begins = np.concatenate([[0], np.cumsum(sizes)])
    if len(sizes):
        pieces = pa.array(vocab.pieces, pa.binary()).take(pa.array(values))  # their bytes lie one after the other
        _, ends, data = pieces.buffers()
        ends = pa.py_buffer(np.frombuffer(ends, np.int32)[begins])
        for i, w in enumerate(pa.StringArray.from_buffers(len(sizes), ends, data).to_pylist(), len(own)):
            at.setdefault(w, i)
    return at, np.concatenate([np.array([r for _, r in own], np.int32), values]), np.concatenate([np.arange(len(own)), len(own) + begins])


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def _blocks(vocab: Vocabulary, block_bytes: int, dictionary=None):
    """Documents as word numbers, and the block's distinct words: known ones as ids, others as bytes.

    Words that are themselves in the vocabulary, or in the dictionary, need no merges any more.
    """
    pattern, layout, ranks = vocab.pattern, vocab.layout, vocab.ranks
    base = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    made: dict = {}

    def block(ids, docs):
        number, flat, sizes = _Numbers(), [], [0]
        for d in docs:
            if d:
                flat.extend(map(number.__getitem__, made["find"](d)))
            sizes.append(len(flat))
        at, values, offsets = made["dictionary"]
        entry = np.fromiter(map(at.get, number, itertools.repeat(-1)), np.int64, len(number))
        if any(len(w) > LONG // 4 for w in number):
            values, offsets = with_long(list(number), entry, values, offsets)
        known, raw = np.flatnonzero(entry >= 0), [w.encode() for w, k in zip(number, entry.tolist()) if k < 0]
        place = np.empty(len(number), np.int32)
        place[known] = np.arange(len(known))
        place[entry < 0] = np.arange(len(known), len(number))
        begin, size = offsets[entry[known]], offsets[entry[known] + 1] - offsets[entry[known]]
        ready = np.cumsum(np.concatenate([[0], size]))
        ready_values = values[np.arange(ready[-1]) + np.repeat(begin - ready[:-1], size)]
        ends = np.cumsum([0, *map(len, raw)])
        states, ends = packed_bytes(base[np.frombuffer(b"".join(raw), np.uint8)], ends, layout) if raw else (np.empty(0, np.int64), ends)
        columns = [
            _outer(pa.array(ids, pa.int64())),
            *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(sizes[1:], np.int64), place[np.fromiter(flat, np.int64, len(flat))], ready_values.astype(np.int32), ready)),
            _outer(_nested(states, ends)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_ids", "ends", "numbers", "known", "begins", "words"])

    def with_long(words, entry, values, offsets):
        """Words of over LONG bytes get their ids here: entries behind the dictionary's."""
        long = [i for i, w in enumerate(words) if entry[i] < 0 and len(w) > LONG // 4 and len(w.encode()) > LONG]
        if long and "pairs" not in made:
            made["pairs"] = {a << 17 | b: r for a, row in vocab.pairs().items() for b, r in row.items()}
        got = [merge_long(words[i].encode(), base, made["pairs"]) for i in long]
        entry[long] = len(offsets) - 1 + np.arange(len(long))
        return np.concatenate([values, *(np.array(x, values.dtype) for x in got)]), np.concatenate([offsets, offsets[-1] + np.cumsum([len(x) for x in got], dtype=offsets.dtype)])

    def run(batches):
        made["find"] = _finder(pattern)
        if not made.get("dictionary"):
            made["dictionary"] = _dictionary(vocab, *(dictionary.value if dictionary else (np.empty(0, np.int32),) * 2))
        for batch in sliced(batches):
            ids, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start, size = 0, 0
            for i, d in enumerate(docs):
                more = len(d or "")
                if i > start and size + more > block_bytes:
                    yield block(ids[start:i], docs[start:i])
                    start, size = i, 0
                size += more
            if start < len(docs):
                yield block(ids[start:], docs[start:])
        made.clear()
        pa.default_memory_pool().release_unused()  # the worker stays, for tasks of another kind too

    return run


def _nested(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _outer(inner: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)


def _assembled(row: dict) -> pa.RecordBatch:
    """(doc_id, ids) of the documents of a block whose words are folded."""
    ends, numbers, known, begins = (np.frombuffer(row[k].as_py(), t) for k, t in (("ends", np.int64), ("numbers", np.int32), ("known", np.int32), ("begins", np.int64)))
    folded = row["folded"].values
    values = np.concatenate([known, folded.flatten().to_numpy()])
    size = np.concatenate([np.diff(begins), folded.value_lengths().to_numpy()]).astype(np.int64)
    start = np.cumsum(size) - size
    own = size[numbers]
    after = np.concatenate([[0], np.cumsum(own)])
    ids = values[np.arange(after[-1]) + np.repeat(start[numbers] - after[:-1], own)]
    return pa.RecordBatch.from_arrays([row["doc_ids"].values, _nested(ids, np.concatenate([[0], after[ends]]), pa.int32())], names=["doc_id", "ids"])


def frequent_words(documents: DataFrame, pattern: str, words: int = DICTIONARY_WORDS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(word) of about so many of the most frequent words of a bounded sample of documents (chosen by hash of their text).

    Of the words of the last count that fits in part, a share goes in by hash.
    """
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sample = documents.where(F.col("text").isNotNull()).select("text")
    if total > sample_bytes:
        sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(sample_bytes / total * (1 << 20)))

    def count(batches):
        find, n = _finder(pattern), Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                n.update(find(text))
        rows = [(w, c) for w, c in n.items() if len(w) > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["word", "n"])

    def whole(batches):  # what the pattern leaves in one piece
        find = _finder(pattern)
        for batch in batches:
            yield batch.filter(pa.array([find(w) == [w] for w in batch.column(0).to_pylist()], pa.bool_()))

    counts = sample.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    least, taken, share = None, 0, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        least, share = r.n, min(1 << 20, (words - taken << 20) // r.words)
        taken += r.words
        if taken >= words:
            break
    part = (F.col("n") == (least or 0)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)
    found = counts.where((F.col("n") > (least or 0)) | part).select("word").mapInArrow(whole, "word string")
    found = materialize(found, "frequent")
    release(counts)
    return found


def rank_map(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """The rank map in one row (shift array<int>, entry array<long>)."""
    shift, owner, rank = vocab.layout
    entry = owner.astype(np.int64) << 17 | rank
    return spark.createDataFrame(pa.table({"shift": _outer(pa.array(shift, pa.int32())), "entry": _outer(pa.array(entry))}))


def _encoded(documents: DataFrame, vocab: Vocabulary, block_bytes: int, each: Each, schema: str, ranks: DataFrame, dictionary=None) -> DataFrame:
    blocks = documents.select("doc_id", "text").mapInArrow(_blocks(vocab, block_bytes, dictionary), BLOCK_SCHEMA)
    words = F.transform("words", lambda w: merge_all(w, F.col("shift"), F.col("entry")))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield each(_assembled({name: batch.column(name)[i] for name in batch.schema.names}))
        pa.default_memory_pool().release_unused()

    folded = blocks.crossJoin(F.broadcast(ranks)).select("doc_ids", "ends", "numbers", "known", "begins", words.alias("folded"))
    return folded.mapInArrow(run, schema)


def encode(documents: DataFrame, vocab: Vocabulary, block_bytes: int = BLOCK_BYTES, dictionary_words: int = DICTIONARY_WORDS, each: Each = lambda batch: batch, schema: str = "doc_id bigint, ids array<int>") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; or what each makes of Arrow batches of these, as the schema says.

    Frequent words are folded once and their ids broadcast (at most dictionary_words entries); the
    other distinct words are folded block by block.
    """
    words = frequent_words(documents, vocab.pattern, dictionary_words)
    listed = words.select(F.xxhash64("word").alias("doc_id"), F.col("word").alias("text")).repartition(32, "doc_id")
    ranks = rank_map(documents.sparkSession, vocab)
    got = _encoded(listed, vocab, block_bytes, lambda batch: batch.select(["ids"]), "ids array<int>", ranks).toArrow().column("ids").combine_chunks()
    values, sizes = got.flatten(), got.value_lengths()
    held = documents.sparkSession.sparkContext.broadcast((values.to_numpy(zero_copy_only=False).astype(np.int32), sizes.to_numpy(zero_copy_only=False).astype(np.int32)))
    release(words)
    return _encoded(documents, vocab, block_bytes, each, schema, ranks, held)


def id_lists(ids: pa.ListArray) -> Iterator[list[int]]:
    """The ids of each list; null ids are -1, a null list has none."""
    flat = ids.flatten().fill_null(-1).to_numpy()
    ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy())
    return (flat[a:b].tolist() for a, b in itertools.pairwise([0, *ends.tolist()]))


def decode_batch(ids: pa.ListArray, vocab: Vocabulary) -> list[bytes]:
    """The bytes of each list of ids: their binary pieces, one after the other."""
    pieces = vocab.pieces
    if pc.all(pc.and_(pc.greater_equal(ids.flatten(), 0), pc.less(ids.flatten(), len(pieces))), min_count=0, skip_nulls=False).as_py():
        piece = pieces.__getitem__
    else:
        piece = lambda i: pieces[i] if 0 <= i < len(pieces) else b""
    return [b"".join(map(piece, x)) for x in id_lists(ids)]


def decode(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, decoded binary) of rows (doc_id, ids); null ids are none."""

    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode_batch(batch.column(1), vocab), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")
