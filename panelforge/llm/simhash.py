"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints are leaves of a binary
trie; two nodes of one depth are traversed together, the bits in which their paths differ are counted, and a pair of
nodes over the error budget is dropped with all that lies below it. Fingerprints whose difference is within the budget
agree on one of BUDGET + 1 blocks of bits at least, so there is a trie for each block, rotated to begin with it, in
which the block has no budget: its node pairs at that depth are the nodes with themselves, which makes them cells that
Spark deals out. Inside a task the cells go on level by level, all pairs of a level at once; a pair of single leaves is
settled by counting bits.

A cell of more than CELL leaves is split by Spark first: each of its leaves goes on to the pairs of children, STRIDE
levels deeper, that its part of the budget allows, in as many rounds as it takes. So no task holds more than a cell, and
leaves are distinct: a group of exact copies is one leaf. A task hands on links that connect its leaves, not all pairs
(a leaf and the least of those it is connected with inside a piece of work), and distributed union-find joins them.

Defined cases: a null or empty text has fingerprint zero, linked like any other; every row of the input is a row of the
result; a null doc_id is never a component's id unless all its members have none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, materialize, release
from .words import texts

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Leaves of a cell that is traversed inside a task, levels that Spark descends at a time, node pairs in work at a time.
CELL, STRIDE, AT_ONCE = 20_000, 6, 1 << 20
#: Shingles whose bits are counted at a time.
_PIECE = 1 << 15


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text's k-word shingles, repeats included (fewer words make one, none make zero)."""
    words = text.lower().split()  # bytes: A-Z only, split at space and \t \n \v \f \r
    n = len(words) - min(k, len(words)) + 1 if words else 0
    if not n:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins, stops = (ends - lengths)[:n].tolist(), ends[len(words) - n :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins[at : at + _PIECE], stops[at : at + _PIECE])), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(documents: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp bigint) of every row of documents; fp is the fingerprint's bits."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        fps = np.fromiter((fingerprint(x, k, seed) for x in texts(batch.column(1))), np.uint64, batch.num_rows)
        yield {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    return arrow_map(documents.select("doc_id", "text"), run, f"doc_id {dict(documents.dtypes)['doc_id']}, fp bigint")


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def least_of_each(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indices is connected with by links a-b, itself included."""
    low = np.arange(n)
    while len(a):
        x, y = low[a], low[b]
        far = x != y
        a, b, x, y = a[far], b[far], x[far], y[far]
        if not len(a):
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != (up := low[low])).any():
            low = up
    return low


def traverse(leaves: np.ndarray, u: np.ndarray, v: np.ndarray, depth: int, spent: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j), in pieces, between leaves under the node pairs (u, v) of a depth with so many bits spent.

    leaves are sorted within each node; a node is a row [begin, end) of indices. A pair of a node with itself stands
    for the pairs inside it.
    """
    work = [(depth, u, v, spent)]
    while work:
        depth, u, v, spent = work.pop()
        if len(u) > AT_ONCE:
            work += [(depth, u[i : i + AT_ONCE], v[i : i + AT_ONCE], spent[i : i + AT_ONCE]) for i in range(0, len(u), AT_ONCE)]
            continue
        single = (u[:, 1] - u[:, 0] == 1) & (v[:, 1] - v[:, 0] == 1)
        i, j = u[single, 0], v[single, 0]
        near = (i != j) & (np.bitwise_count(leaves[i] ^ leaves[j]) <= budget)
        if near.any():
            yield i[near], j[near]
        u, v, spent = u[~single], v[~single], spent[~single]
        if depth == 64 or not len(u):
            continue
        bit = np.uint64(1 << (63 - depth))
        ones = np.concatenate([[0], np.cumsum((leaves & bit) != 0)])
        cut_u, cut_v = u[:, 1] - (ones[u[:, 1]] - ones[u[:, 0]]), v[:, 1] - (ones[v[:, 1]] - ones[v[:, 0]])  # zeros come first
        children = lambda x, cut: (np.stack([x[:, 0], cut], 1), np.stack([cut, x[:, 1]], 1))
        (u0, u1), (v0, v1) = children(u, cut_u), children(v, cut_v)
        same = (u[:, 0] == v[:, 0]) & (u[:, 1] == v[:, 1])
        pairs = [(u0, v0, spent), (u1, v1, spent), (u0, v1, spent + 1), (u1[~same], v0[~same], spent[~same] + 1)]
        x, y, d = (np.concatenate(p) for p in zip(*pairs))
        go = (d <= budget) & (x[:, 0] < x[:, 1]) & (y[:, 0] < y[:, 1])
        work.append((depth + 1, x[go], y[go], d[go]))


def _cells(documents_fps: DataFrame, budget: int) -> DataFrame:
    """Leaves (cell, side, leaf, depth, spent) of the tries, one for each block of bits; side 0: a node with itself."""
    blocks = budget + 1
    starts = [64 * i // blocks for i in range(blocks + 1)]
    rotated = lambda s: F.when(F.lit(s == 0), F.col("fp")).otherwise(F.shiftleft("fp", s % 64).bitwiseOR(F.shiftrightunsigned("fp", (64 - s) % 64)))
    tries = F.array(*(F.struct(F.lit(s).alias("turn"), rotated(s).alias("leaf"), F.lit(e - s).alias("depth")) for s, e in zip(starts, starts[1:])))
    leaves = documents_fps.select(F.inline(tries))
    node = F.expr("shiftrightunsigned(leaf, 64 - depth)")
    return leaves.select(F.xxhash64("turn", node).alias("cell"), "turn", "leaf", "depth", F.lit(0).alias("side"), F.lit(0).alias("spent"))


def _descend(cells: DataFrame, budget: int) -> DataFrame:
    """Leaves of cells, dealt to the pairs of children STRIDE levels below that the budget allows."""
    step = F.least(F.lit(STRIDE), F.lit(64) - F.col("depth"))
    child = F.expr(f"shiftrightunsigned(shiftleft(leaf, depth), 64 - least({STRIDE}, 64 - depth))")
    flips = [m for m in range(1 << STRIDE) if m.bit_count() <= budget]
    other = F.explode(F.array(*map(F.lit, flips))).alias("flip")
    met = cells.select("cell", "turn", "leaf", "depth", "side", "spent", step.alias("step"), child.alias("own"), other)
    met = met.where(f"spent + bit_count(flip) <= {budget} and flip < shiftleft(1, step)").withColumn("theirs", F.expr("own ^ flip"))
    # in a node with itself the smaller child comes first, else the child of side 1
    first = F.when(F.col("side") == 0, F.least("own", "theirs")).when(F.col("side") == 1, F.col("own")).otherwise(F.col("theirs"))
    last = F.when(F.col("side") == 0, F.greatest("own", "theirs")).when(F.col("side") == 1, F.col("theirs")).otherwise(F.col("own"))
    side = F.when(F.col("side") != 0, F.col("side")).when(F.col("flip") == 0, 0).when(F.col("own") < F.col("theirs"), 1).otherwise(2)
    return met.select(F.xxhash64("cell", first, last).alias("cell"), "turn", "leaf", (F.col("depth") + F.col("step")).alias("depth"), side.alias("side"), (F.col("spent") + F.expr("bit_count(flip)")).alias("spent"))


def links(fps: DataFrame, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """(a, b) links between distinct fingerprints fps(fp) that connect all within the budget of each other."""
    open_ = materialize(_cells(fps, budget), "trie")
    done = []
    while True:
        sizes = materialize(open_.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth"), F.min("side").alias("low"), F.max("side").alias("high")).where("n > 1 and (low = 0 or low < high)"), "sizes")
        # cells of one leaf or with an empty side have no pairs
        small = materialize(open_.join(sizes.where(f"n <= {cell} or depth = 64").select("cell"), "cell", "left_semi"), "cells")
        done.append(small)
        if sizes.where(f"n > {cell} and depth < 64").isEmpty():
            release(open_, sizes)
            break
        deeper = materialize(_descend(open_.join(sizes.where(f"n > {cell} and depth < 64").select("cell"), "cell", "left_semi"), budget), "trie")
        release(open_, sizes)
        open_ = deeper
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    dealt = every.repartition("cell").sortWithinPartitions("cell", "side", F.expr("leaf ^ (-9223372036854775808L)"))
    names = ["cell", "turn", "leaf", "depth", "side", "spent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_cells(batches, names):
            a, b = _linked(*columns, budget)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    out = materialize(dealt.select(names).mapInArrow(run, "a bigint, b bigint").distinct(), "near")
    release(*done)
    return out


def _whole_cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of whole cells, some AT_ONCE / 16 rows together: a cell is never cut."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        new = [batch.column(n).to_numpy() for n in names]
        held.append(new)
        rows += batch.num_rows
        if rows >= AT_ONCE // 16 and batch.num_rows:
            at = np.flatnonzero(new[0] != new[0][-1])
            if len(at):
                keep = at[-1] + 1
                held[-1] = [x[:keep] for x in new]
                yield [np.concatenate(x) for x in zip(*held)]
                held, rows = [[x[keep:] for x in new]], batch.num_rows - keep
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _linked(cell, turn, leaf, depth, side, spent, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole cells, sorted by cell, side and unsigned leaf: each linked leaf with its component's least."""
    leaves = leaf.view(np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])]))
    node = np.stack([edge, np.append(edge[1:], len(cell))], 1)
    own = side[edge]
    alone, pair = own == 0, np.flatnonzero((own[:-1] == 1) & (own[1:] == 2) & (cell[edge[:-1]] == cell[edge[1:]]))
    u, v = np.concatenate([node[alone], node[pair]]), np.concatenate([node[alone], node[pair + 1]])
    level, so_far = depth[u[:, 0]], spent[u[:, 0]].astype(np.int64)
    low = np.arange(len(leaves))
    for d in np.unique(level):
        of = level == d
        for i, j in traverse(leaves, u[of], v[of], int(d), so_far[of], budget):
            low = least_of_each(len(leaves), np.concatenate([np.arange(len(low)), i]), np.concatenate([low, j]))
    moved = np.flatnonzero(low != np.arange(len(low)))
    a, b, turned = leaves[moved], leaves[low[moved]], turn[moved]
    for t in np.unique(turned):
        of = turned == t
        a[of], b[of] = _rotl(a[of], (64 - int(t)) % 64), _rotl(b[of], (64 - int(t)) % 64)
    return a, b


def components(documents: DataFrame, k: int = SHINGLE, seed: int = SEED, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that a document reaches by fingerprints within the budget."""
    known = materialize(fingerprints(documents, k, seed), "fingerprints")
    distinct = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    near = links(distinct.select("fp"), budget, cell)
    comps = connected_components(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    release(near)
    named = distinct.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of_fp = materialize(named.join(lowest, "component").select("fp", "component_id"), "components")
    release(distinct, comps)
    return known.join(of_fp, "fp").select("doc_id", "fp", "component_id")
