"""Shared building blocks: bounded broadcasts, id bitmaps and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelforge.shared import materialize, release, shared_dir  # noqa: F401  the other modules take them from here

#: Bits in an id bitmap (8 MB when broadcast). A fuller bitmap only lets more rows through.
BITMAP_BITS = 1 << 26
_BUCKET_BITS = 32768
#: Rows of a batch that Python code works on at a time.
SLICE_ROWS = 256


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with fn(batch) yielding dicts of column arrays that follow the DDL schema."""
    fields = list(to_arrow_schema(StructType.fromDDL(schema)))

    def run(batches):
        for piece in sliced(batches):
            for out in fn(piece):
                yield pa.RecordBatch.from_arrays([as_arrow(out[f.name], f.type) for f in fields], names=[f.name for f in fields])

    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most SLICE_ROWS rows: Python objects are made for one piece at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(begin, SLICE_ROWS)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def _slot(column: str, probe: int = 0):
    return F.pmod(F.xxhash64(F.col(column), *([F.lit(probe)] if probe else [])), F.lit(BITMAP_BITS))


def bitmap_rows(ids: DataFrame, column: str, probes: int = 1) -> DataFrame:
    """Bitmap of the hashed values of a column, in rows (bucket, bits array<long>); at most BITMAP_BITS / 8 bytes.

    With several probes a value has a bit for each of as many hashes.
    """
    known = ids.where(F.col(column).isNotNull())
    slots = known.select(_slot(column).alias("slot")) if probes == 1 else known.select(F.explode(F.array(*(_slot(column, i) for i in range(probes)))).alias("slot"))
    raw = slots.groupBy(F.expr(f"cast(slot div {_BUCKET_BITS} as int)").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % _BUCKET_BITS).alias("raw"))
    word = lambda i: F.conv(F.hex(F.substring("raw", 8 * i + 1, F.lit(8))), 16, -10).cast("bigint")
    return raw.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(_BUCKET_BITS // 64 - 1)), word).alias("bits"))


def in_bitmap(df: DataFrame, column: str, bitmap: DataFrame, probe: int = 0) -> DataFrame:
    """df with _pf_maybe: false where the value is surely not in the bitmap (whose size is bounded), by one of its probes."""
    at = df.withColumn("_pf_slot", _slot(column, probe)).withColumn("_pf_bucket", F.expr(f"cast(_pf_slot div {_BUCKET_BITS} as int)"))
    held = F.broadcast(bitmap.select(F.col("bucket").alias("_pf_bucket"), F.col("bits").alias("_pf_bits")))
    # a word holds eight bytes, the first byte highest
    word = f"get(_pf_bits, cast(_pf_slot % {_BUCKET_BITS} div 64 as int))"
    hit = F.expr(f"coalesce(shiftright({word}, cast((_pf_slot % 64) ^ 56 as int)) & 1 = 1, false)")
    return at.join(held, "_pf_bucket", "left").withColumn("_pf_maybe", hit).drop("_pf_slot", "_pf_bucket", "_pf_bits")


def maybe_in(df: DataFrame, column: str, ids: DataFrame, probes: int = 1) -> DataFrame:
    """Rows of df whose value may be among ids' values of the same column; DataFrame operations only.

    More probes let fewer others through: with a share s of the bits set, s to the power of probes of them.
    """
    bitmap = bitmap_rows(ids, column, probes)
    if probes > 1:
        bitmap = materialize(bitmap, "bitmap")
    for probe in range(probes):
        df = in_bitmap(df, column, bitmap, probe).where("_pf_maybe").drop("_pf_maybe")
    return df


def surely_not_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows that maybe_in leaves out."""
    return in_bitmap(df, column, bitmap_rows(ids, column)).where("not _pf_maybe").drop("_pf_maybe")


def without_ids(df: DataFrame, column: str, removed: DataFrame) -> DataFrame:
    """df without the rows whose id is in removed(column); only rows that may go are shuffled. df may have any other columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    packed = df.select(row, F.col(f"`{column}`").alias("id"))  # df's columns stay apart from our own
    gone = removed.select(F.col(column).alias("id"))
    maybe = maybe_in(packed, "id", gone).join(gone.distinct(), "id", "left_anti")
    return surely_not_in(packed, "id", gone).unionByName(maybe.select("row", "id")).select("row.*")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Distributed union-find over edges(src long, dst long): rows (node, component = smallest node).

    Alternates large-star and small-star rounds (each a shuffle with map-side combine); every round
    is written to the shared folder, and rounds go on until the edge set no longer changes (an error if
    it still does after max_rounds; the rounds grow with the logarithm of the longest chain). Null
    ends and self loops are ignored; nodes without an edge don't appear.
    """
    cur = (
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    cur = materialize(cur, "cc")
    before = None
    for _ in range(max_rounds):
        nxt = materialize(_star(_star(cur, large=True), large=False), "cc")
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.col("src").cast("decimal(38,0)")), F.sum(F.col("dst").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(src, dst))")).first()
        release(cur)
        cur = nxt
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = cur.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    out = materialize(cur.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots), "components")
    release(cur)
    return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round: neighbours of each node get linked to the smallest of them.

    large: each node's larger neighbours; else its smaller neighbours and itself. The smallest
    neighbour is an aggregate with map-side combine joined back, so no neighbour list is gathered
    and a node with very many neighbours stays split over tasks (skew join).
    """
    if large:
        both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        low = edges.groupBy("src").agg(F.min("dst").alias("m"))
        down = edges.join(low, "src").where("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        out = down.unionByName(low.select("src", F.col("m").alias("dst")))
    return out.where("src != dst").distinct()


def link_buckets(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], copies: DataFrame, rounds: int = 2, least_keys: int = 1, traits: Callable[[DataFrame], DataFrame] | None = None, may_link: Callable[[str, str], str] | None = None
) -> DataFrame | None:
    """Components (node, component) of buckets (key, node), None if there are no links: every link between components is found.

    verify takes candidate pairs (a, b) with a < b and returns those that link (materialised). In each round every
    bucket is compared with one of its nodes (first the one with most copies in copies(node, n), as near copies
    are nearest to their original, and most buckets; then one drawn by hash), and only nodes that aren't in that
    node's component yet are compared. Buckets that lie in one component are done; those that still have several
    after the rounds are compared across components (pairs that share least_keys keys at least). No bucket is gathered, and nodes of one component are never
    compared with each other again. traits(nodes) gives (node, ...) and may_link(x, y) a SQL condition on them (and
    on x.key) that every link meets in one of its buckets: it drops pairs inside that last join.
    """
    comps = None
    for r in range(rounds + 1):
        if r == 0:
            degree = members.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))
            rank = F.least(F.coalesce("n", F.lit(1)), F.lit(1 << 16)) * 4096 + F.least("keys", F.lit(4095))
            draw = F.shiftrightunsigned(F.xxhash64("node"), 30) - F.shiftleft(rank.cast("bigint"), 34)
            placed = members.join(degree, "node").join(copies, "node", "left").select("key", "node", draw.alias("draw"), F.col("node").alias("c"))
        else:
            placed = members.withColumn("draw", F.xxhash64("node", F.lit(r)))
            placed = placed.withColumn("c", F.col("node")) if comps is None else placed.join(comps, "node", "left").withColumn("c", F.coalesce("component", "node"))
        heads = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("node", "draw").alias("hub"), F.min_by("c", "draw").alias("hub_c"))
        heads = heads.where("low != high").select("key", "hub", "hub_c")
        open_ = materialize(placed.select("key", "node", "c").join(heads, "key"), "open")
        if r:
            release(members)
        members = open_
        if r < rounds:
            met = members.where("c != hub_c").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        else:
            rest = members.select("key", "node", "c")
            own = None
            if traits is not None:
                own = traits(rest.select("node").distinct())
                rest = rest.join(own, "node")
            x, y = rest.alias("x"), rest.alias("y")
            near = F.expr("x.key = y.key and x.c < y.c" + (f" and {may_link('x', 'y')}" if may_link else ""))
            met = x.join(y, near).groupBy(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
            met = met.where(F.col("keys") >= least_keys).select("a", "b")
        met = materialize(met, "met")
        if r == rounds:
            release(own)
        if met.isEmpty():
            release(met)
            break
        links = verify(met)
        release(met)
        if links.isEmpty():
            release(links)
            members = _same(members, members.select("key", "node"))
            continue
        edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        if comps is not None:
            edges = edges.unionByName(comps.select(F.col("node").alias("src"), F.col("component").alias("dst")))
        before, comps = comps, connected_components(edges)
        release(before, links)
        members = _same(members, members.select("key", "node"))
    release(members)
    return comps


def _same(table: DataFrame, view: DataFrame) -> DataFrame:
    """A view of a materialised table that can be released in its place."""
    view._pf_path = table._pf_path
    return view
