"""N-gram Jaccard self-join of documents with token-combination prefixes.

A document's set holds the hashes of its distinct word shingles; documents link when the Jaccard
similarity of their sets is at least THRESHOLD percent, and the result is each document's component.

Exactness of the candidate search, for sets x and y that link (d = tokens of x that y lacks,
D = tokens in just one of them; d <= |x| / 5 and D <= |x| / 4 at 80 percent):

* Tokens are ordered by how often their hash bucket occurs in the whole corpus, rarest first. The first
  common token comes after at most d others, so it is in the first d + 1 tokens of both.
* If that token is rare (its class: bucket count up to ``rare``), both documents index it by itself.
* If not, they share no rare token. Then each indexes pairs of neighbouring frequent tokens, over a
  prefix extended to D + d + 2: every token that only one of them has parts at most one neighbouring
  pair of common tokens, so at least one pair of the first D + 2 common tokens is left in both.

A bucket of the index is not expanded into pairs: all its sets are verified against one of them at a
time, components are formed, and only sets of one bucket that stay in different components are
compared with each other. No link between different components can be missed, and groups of copies or
near copies of any size cost one comparison per member and bucket. Equal sets are one node from the start.

Defined cases: null and empty texts have no shingles, link with nothing and are their own component;
fewer words than a shingle make one shingle; repeated rows are equal sets; a null doc_id takes part and
gets the smallest id of its component, or null if there is none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, link_buckets, materialize, maybe_in, release, sliced, without_ids
from .words import WordHashes, mix, shingles, texts

SHINGLE = 5
THRESHOLD = 80
#: Least and most buckets, as a power of two, of the corpus-wide frequency table (4 bytes each where it is summed, 2 where
#: broadcast), and the bytes of text for a bucket between them.
FREQUENCY_BITS, BUCKET_BYTES = (20, 22), 2048
#: Tokens are rare up to a bucket count of the mean, so many of its standard deviations, and RARE_FLOOR.
RARE_DEVIATIONS, RARE_FLOOR = 1.5, 4
_SLICE = 1 << 14
#: Longs of a set's parity bitmap.
_SKETCH = 8
_U = np.uint64


def _slots(h: np.ndarray, size: int) -> np.ndarray:
    """Buckets of hashes in a table of so many (a power of two)."""
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


def table_size(documents: DataFrame) -> int:
    """Buckets of the frequency table for a corpus."""
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return 1 << min(max(FREQUENCY_BITS[0], (total // BUCKET_BYTES).bit_length()), FREQUENCY_BITS[1])


def node_of(sh: np.ndarray) -> int:
    """Signed 64-bit identity of a set of shingle hashes."""
    return int((mix(np.bitwise_xor.reduce(mix(sh + np.uint64(len(sh))))[None])).view(np.int64)[0])


def sketch_of(sh: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: two bitmaps differ in at most as many bits as the sets differ in tokens."""
    odd = np.bincount((sh >> _U(48)).astype(np.int64) & (64 * _SKETCH - 1), minlength=64 * _SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _hashed(k: int, lower: bool):
    """text bytes -> sorted distinct shingle hashes, with a word cache per task."""
    hashes = WordHashes()

    def of(text: bytes) -> np.ndarray:
        return shingles(hashes.of((text.lower() if lower else text).split()), k)

    return of


def sets_and_frequencies(documents: DataFrame, size: int, k: int = SHINGLE) -> DataFrame:
    """One pass: (doc_id, n, node) of each document, and each task's bucket counts in slices.

    Equal sets of one task count once, so that copies don't make their tokens look frequent.
    """
    of = _hashed(k, True)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.list_(pa.int64())), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts, seen = np.zeros(size, np.int64), set()
        for batch in sliced(batches):
            sizes, nodes, sketches, slots = [], [], [], []
            for text in texts(batch.column(1)):
                sh = of(text)
                sizes.append(len(sh))
                node = node_of(sh) if len(sh) else None
                nodes.append(node)
                sketches.append(sketch_of(sh))
                if len(sh) and node not in seen:
                    seen.add(node)
                    slots.append(_slots(sh, size))
            if slots:
                counts += np.bincount(np.concatenate(slots), minlength=len(counts))
            none = pa.nulls(batch.num_rows)
            sketch = pa.ListArray.from_arrays(np.arange(0, len(sketches) * _SKETCH + 1, _SKETCH, dtype=np.int32), np.concatenate(sketches))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), sketch, none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        parts = [(i, counts[i * _SLICE : (i + 1) * _SLICE]) for i in range(len(counts) // _SLICE)]
        parts = [(i, p.astype(np.uint32)) for i, p in parts if p.any()]
        none = pa.nulls(len(parts))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64())] * 3 + [none.cast(pa.list_(pa.int64())), pa.array([i for i, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, node bigint, sketch array<bigint>, slice int, counts binary")


def frequency_table(slices: DataFrame, size: int) -> np.ndarray:
    """Summed bucket counts of a table of bounded size; the slices are summed side by side."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(*(c.to_pylist() for c in batch.columns)):
                have = total.setdefault(i, np.zeros(_SLICE, np.int64))
                have += np.frombuffer(raw, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(size, np.int64)
    for r in slices.repartition("slice").mapInArrow(add, "slice int, counts binary").collect():
        out[r.slice * _SLICE : (r.slice + 1) * _SLICE] += np.frombuffer(bytes(r.counts), np.int64)
    return out


def ranks_of(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Bucket counts scaled to 16 bits, and the highest rank of the rare class."""
    mean = max(1.0, counts.mean())
    rank = np.minimum(counts * 256 / mean, 65535).astype(np.uint16)
    return rank, int(min(65535, (counts.mean() + RARE_DEVIATIONS * counts.mean() ** 0.5 + RARE_FLOOR) * 256 / mean))


def prefix_signatures(sh: np.ndarray, rank: np.ndarray, rare: int, threshold: int = THRESHOLD) -> np.ndarray:
    """Index keys of one set: its first rare tokens, and neighbouring pairs of frequent ones if need be.

    Prefixes are one token longer than the first shared key needs, so linked sets share two keys.
    """
    n = len(sh)
    own = rank[_slots(sh, len(rank))]
    order = np.lexsort((sh, own))
    d, both = n * (100 - threshold) // 100, n * (100 - threshold) // threshold
    prefix = order[: d + 2]
    keys = mix(sh[prefix[own[prefix] <= rare]] ^ np.uint64(0x5851F42D4C957F2D))
    n_rare = int((own <= rare).sum())
    if n_rare < d + 2:
        f = sh[order[n_rare:]][: both + d + 3]
        keys = np.concatenate([keys, mix(f[:-1] * np.uint64(0x9E3779B97F4A7C15) + (f[1:] ^ np.uint64(0xC2B2AE3D27D4EB4F)))])
    return keys.view(np.int64)


def signatures(documents: DataFrame, counts: np.ndarray, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(key, node) of every document; equal sets of one task are emitted once."""
    held = documents.sparkSession.sparkContext.broadcast(ranks_of(counts))
    of = _hashed(k, True)

    def run(batches):
        rank, rare = held.value
        seen = set()
        for batch in sliced(batches):
            keys, nodes = [], []
            for text in texts(batch.column(0)):
                sh = of(text)
                if not len(sh) or (node := node_of(sh)) in seen:
                    continue
                seen.add(node)
                keys.append(prefix_signatures(sh, rank, rare, threshold))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return documents.select("text").mapInArrow(run, "key bigint, node bigint")


def _texts(documents: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """nodes (node, doc_id, ...) with a text that has their set: only documents that stand for a node are shingled.

    A set may come more than once, if its document's id or the bitmap's slot isn't its own.
    """
    of = _hashed(k, True)

    def run(batch):
        sets = [of(text) for text in texts(batch.column(1))]
        yield {"node": [node_of(sh) if len(sh) else None for sh in sets], "text": batch.column(1)}

    docs = documents.select("doc_id", "text")
    found = maybe_in(docs.where("doc_id is not null"), "doc_id", nodes).unionByName(docs.where("doc_id is null"))
    return arrow_map(found, run, "node bigint, text string").join(nodes.drop("doc_id"), "node")


def _linked(pairs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(a, b) of the rows (a, b, ta, tb) whose texts' sets reach the threshold; a set is made once for neighbouring rows."""
    of = _hashed(k, True)

    def run(batches):
        last: dict[str, tuple[int, np.ndarray]] = {}

        def made(side: str, node: int, text) -> np.ndarray:
            if side not in last or last[side][0] != node:
                last[side] = node, of(text.as_buffer().to_pybytes())
            return last[side][1]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                one, other = made("a", x, ta[i]), made("b", y, tb[i])
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= threshold * (len(one) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def may_link(x: str, y: str, threshold: int = THRESHOLD) -> str:
    """What holds of the traits of all pairs that reach the threshold: sizes, and bits in which their parity bitmaps differ."""
    differ = " + ".join(f"bit_count({x}.s{i} ^ {y}.s{i})" for i in range(_SKETCH))
    return f"100 * least({x}.n, {y}.n) >= {threshold} * greatest({x}.n, {y}.n) and {100 + threshold} * ({differ}) <= {100 - threshold} * ({x}.n + {y}.n)"


def verify(pairs: DataFrame, documents: DataFrame, traits: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of the pairs whose sets' Jaccard similarity reaches the threshold, exactly.

    Pairs whose traits rule a link out are left out first. The others' texts meet by two joins, one per side; a
    set with very many partners is split over tasks (skew join). Texts are shuffled, as hashes of shingles don't compress.
    """
    x, y = traits.alias("x"), traits.alias("y")
    p = pairs.join(x, F.expr("a = x.node")).join(y, F.expr("b = y.node")).where(may_link("x", "y", threshold))
    p = materialize(p.select("a", "b"), "pairs")
    sides = p.select(F.col("a").alias("node"), F.lit(1).alias("is_a"), F.lit(0).alias("is_b")).union(p.select("b", F.lit(0), F.lit(1)))
    nodes = sides.groupBy("node").agg(F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b")).join(traits.select("node", "doc_id"), "node")
    nodes = materialize(nodes, "nodes")
    held = materialize(_texts(documents, nodes, k), "texts")
    got = p.join(held.where("is_a = 1").select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    got = got.join(held.where("is_b = 1").select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    links = materialize(_linked(got, k, threshold), "links")
    release(p, nodes, held)
    return links


def components(documents: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    if threshold < 75:
        raise ValueError("pairs of neighbouring tokens need a threshold of 75 at least")
    size = table_size(documents)
    first = materialize(sets_and_frequencies(documents, size, k), "shingles")
    counts = frequency_table(first.where("slice is not null").select("slice", "counts"), size)
    info = materialize(first.where("slice is null").select("doc_id", "n", "node", *(F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(_SKETCH))), "info")
    release(first)

    # keys that one set alone has are left out by a count with map-side combine and a bitmap
    keyed = materialize(signatures(documents, counts, k, threshold), "keyed")
    several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    shared = materialize(maybe_in(keyed, "key", several, probes=2), "shared")
    release(keyed)
    held = maybe_in(info.where("node is not null"), "node", shared)
    longs = [F.min(f"s{i}").alias(f"s{i}") for i in range(_SKETCH)]
    traits = materialize(held.groupBy("node").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), *longs), "traits")
    copies = traits.where("copies > 1").select("node", F.col("copies").alias("n"))
    comps = link_buckets(
        shared.distinct(), lambda pairs: verify(pairs, documents, traits, k, threshold), copies, least_keys=2,
        traits=lambda nodes: traits.drop("doc_id", "copies"), may_link=lambda x, y: may_link(x, y, threshold),
    )
    release(shared, traits)

    named = info.select("doc_id", "n", F.col("node").alias("_c")) if comps is None else info.join(comps, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("_c"))
    least = named.where("_c is not null").groupBy("_c").agg(F.min("doc_id").alias("_least"))
    return named.join(least, "_c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_c").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def keep_one(documents: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Documents, with all their columns, without those that have a smaller id in their component.

    Rows with a null id stay; rows that repeat the id of the kept document stay with it.
    """
    removed = components(documents, k, threshold).where("doc_id != component_id").select("doc_id")
    return without_ids(documents, "doc_id", materialize(removed, "removed"))
