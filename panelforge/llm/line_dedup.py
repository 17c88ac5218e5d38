"""Fuzzy line deduplication by MinHash, with DataFrame and SQL functions only.

Lines that are equal are one node from the start. A line's signature holds the BOTTOM smallest hashes of
the windows of its UTF-8 bytes, in an order that puts windows first that begin with one of SAMPLED (the same
order for all lines; only lines with few such windows need the others hashed). Two lines that share two of
these meet in a bucket: every pair of the smallest hashes is a band. Measured recall just over the threshold
is in tests (test_line_recall). Lines of few shingles are found with certainty. Candidates are verified by the
exact Jaccard similarity of all their character shingles, verified links are joined by distributed union-find,
and of each component the first line (by document and line number) stays.

Keys that only one line has are left out by a count with map-side combine and a bitmap; a bucket is compared
with one of its lines at a time, and only lines of one bucket that stay in different components are compared
with each other. Nothing is partitioned by key alone, so a key of very many lines is spread over tasks.

Defined cases: null texts have no lines and stay null; lines without a word are never dropped; lines
shorter than a shingle are one shingle; rows of one doc_id are told apart by the hash of their text, so rows
that repeat both count as one row and are kept alike (each keeps the line that stays); a null doc_id sorts
before all others; other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_rows, in_bitmap, link_buckets, materialize, maybe_in, release

SHINGLE = 5
THRESHOLD = 80
#: Bytes of a signature window, the bytes that windows of first rank begin with, and how many hashes make the bands.
WINDOW = 11
SAMPLED = [b for b in range(256) if b % 8 == 2]
BOTTOM = 6
#: Lines of at most SHORT_TO distinct shingles have bands of these, lines of at least DENSE_FROM characters have bands
#: of signature windows. Lines under DENSE_FROM have under 12 shingles; whatever may link to one has under 14.
SHORT_TO, DENSE_FROM = 15, 11 + SHINGLE
#: Longs of a line's parity bitmap (a power of two).
SKETCH = 16
#: A text with a shingle that comes again in it.
_REPEAT = f"(?s)(?=(.{{{SHINGLE}}})).(?=.*\\1)"
_CLASS = "[" + "".join(f"\\x{b:02x}" for b in SAMPLED) + "]"


def _hashes(data: Column, size: int, step: int, hashed) -> Column:
    """hashed(piece) of all pieces of so many bytes of a binary value, one from every step-th byte on."""
    last = F.octet_length(data) - (size - 1)
    found = F.transform(F.sequence(F.lit(1), last, F.lit(step)), lambda i: hashed(F.substring(data, i, F.lit(size))))
    return F.when(last >= 1, found).otherwise(F.array().cast("array<bigint>"))


def line_shingles(line: Column) -> Column:
    """Hashes of the character shingles of a line, with repeats; a shorter line is its own shingle."""
    wide = F.encode(line, "UTF-32")
    shingles = _let(wide, lambda u: _hashes(u, 4 * SHINGLE, 4, F.xxhash64))
    return F.when(F.length(line) >= SHINGLE, shingles).otherwise(F.array(F.xxhash64(wide)))


def _let(value: Column, body) -> Column:
    """body(x) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _smallest(hashes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, BOTTOM)


def signature(line: Column) -> Column:
    """The BOTTOM smallest ranks of a line's windows: negative for windows of first rank, so that these come first."""
    data = line.cast("binary")
    lead = F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(f"(?s)(?=({_CLASS}.{{{WINDOW - 1}}}))"), F.lit(1))
    rank = lambda x, first: F.when(first, F.shiftrightunsigned(F.xxhash64(x), 1) + F.lit(-(1 << 63))).otherwise(F.shiftrightunsigned(F.xxhash64(x), 1))
    few = _hashes(data, WINDOW, 1, lambda x: _let(F.decode(x, "ISO-8859-1"), lambda t: rank(t, t.rlike(f"(?s)^{_CLASS}"))))
    return _let(_smallest(F.transform(lead, lambda x: rank(x, F.lit(True)))), lambda h: F.when(F.size(h) == BOTTOM, h).otherwise(_smallest(few)))


def _pair_keys(h: Column) -> Column:
    """One key for every two of the smallest hashes."""
    return F.flatten(F.transform(h, lambda x, i: F.transform(F.slice(h, i + 2, F.size(h)), lambda y: F.xxhash64(F.lit(2), x, y))))


def _triple_keys(h: Column) -> Column:
    """One key for every three of the smallest hashes (up to three hashes make one key)."""

    def with_two(x, y, rest):
        return F.transform(rest, lambda z: F.xxhash64(F.lit(3), x, y, z))

    triples = F.flatten(F.transform(h, lambda x, i: F.flatten(F.transform(F.slice(h, i + 2, F.size(h)), lambda y, j: with_two(x, y, F.slice(h, i + j + 3, F.size(h)))))))
    return F.when(F.size(h) <= 3, F.array(F.xxhash64(F.lit(1), h))).otherwise(triples)


def bands(line: Column) -> Column:
    """Bucket keys of a line: hashes of pairs among its smallest shingle hashes, of triples for lines of few shingles.

    Lines of at most SHORT_TO shingles that reach the threshold differ in three at most, so they share a triple.
    """
    none = F.array().cast("array<bigint>")
    dense = _let(signature(line), _pair_keys)
    short = _let(F.array_distinct(line_shingles(line)), lambda sh: F.when(F.size(sh) <= SHORT_TO, _let(_smallest(sh), _triple_keys)).otherwise(none))
    # a longer line of few shingles repeats one within its first SHORT_TO + 1
    few = (F.length(line) < SHORT_TO + SHINGLE) | F.substring(line, 1, SHORT_TO + SHINGLE).rlike(_REPEAT)
    return F.concat(F.when(few, short).otherwise(none), F.when(F.length(line) >= DENSE_FROM, dense).otherwise(none))


def _lines(documents: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line, node) of lines with a word; th tells rows of one doc_id apart."""
    split = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    lines = documents.select("doc_id", F.xxhash64("text").alias("th"), split).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    return lines.withColumn("node", F.xxhash64("line"))


def dropped_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, th, dropped array<int>): the numbers of the lines of each document that don't stay."""
    lines = _lines(documents)
    place = F.struct("doc_id", "th", "line_no")
    again = materialize(lines.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    marked = in_bitmap(lines, "node", bitmap_rows(again, "node"))
    firsts = marked.where("_pf_maybe").groupBy("node").agg(F.min(F.struct("doc_id", "th", "line_no", "line")).alias("first"))
    firsts = materialize(firsts.select("node", "first.*"), "firsts")
    # every distinct line once, at its first place
    once = marked.where("not _pf_maybe").select(firsts.columns).unionByName(firsts)

    keyed = materialize(once.select(F.explode(bands(F.col("line"))).alias("key"), "node"), "keyed")
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = materialize(maybe_in(keyed, "key", several, probes=2), "shared")
    release(keyed)
    nodes = materialize(shared.select("node").distinct(), "nodes")
    texts = materialize(maybe_in(once, "node", nodes).join(nodes, "node").select("node", place.alias("place"), "line"), "texts")
    sets = measured(texts)
    release(nodes)
    comps = link_buckets(shared, lambda pairs: verify(pairs, texts, sets), again, traits=lambda nodes: traits(nodes, texts, sets), may_link=meet_once)
    release(shared, sets)

    # of each component the node with the first place stays, and of that node the first line
    plan = firsts.join(again, "node").select("node", place.alias("keeper"))
    if comps is not None:
        named = comps.join(texts, "node").select("node", "component", "place")
        keepers = named.groupBy("component").agg(F.min("place").alias("keeper"))
        linked = named.join(keepers, "component").select("node", "keeper")
        plan = linked.unionByName(plan.join(linked, "node", "left_anti"))
    plan = materialize(plan, "plan")
    hit = maybe_in(lines, "node", plan).select("node", "doc_id", "th", "line_no").join(plan, "node").where(~F.col("keeper").eqNullSafe(place))
    dropped = materialize(hit.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("dropped")), "dropped")
    release(again, firsts, texts, comps, plan)
    return dropped


def measured(texts: DataFrame) -> DataFrame:
    """(node, n, s0, s1, ...): the number of a line's shingles and their parity bitmap in longs.

    Two bitmaps differ in at most as many bits as the sets differ in shingles.
    """
    x = texts.select("node", F.explode(F.array_distinct(line_shingles(F.col("line")))).alias("x"))
    bit = x.select("node", F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit"), F.expr(f"shiftright(x, 6) & {SKETCH - 1}").alias("at"))
    longs = (F.coalesce(F.bit_xor(F.when(F.col("at") == i, F.col("bit"))), F.lit(0)).alias(f"s{i}") for i in range(SKETCH))
    return materialize(bit.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *longs), "sets")


def traits(nodes: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Measures of the nodes' shingle sets, and the signatures of the lines that have keys of them."""
    dense = F.when(F.length("line") >= DENSE_FROM, signature(F.col("line"))).otherwise(F.array().cast("array<bigint>"))
    own = texts.join(nodes, "node").select("node", dense.alias("sig"))
    return materialize(own.join(sets, "node"), "traits")


def may_link(x: str, y: str) -> str:
    """What holds of the measures of all pairs that reach the threshold."""
    differ = " + ".join(f"bit_count({x}.s{i} ^ {y}.s{i})" for i in range(SKETCH))
    return f"100 * least({x}.n, {y}.n) >= {THRESHOLD} * greatest({x}.n, {y}.n) and {100 + THRESHOLD} * ({differ}) <= {100 - THRESHOLD} * ({x}.n + {y}.n)"


def meet_once(x: str, y: str) -> str:
    """may_link, in the first of the buckets of windows that a pair of dense lines shares; other pairs in each bucket."""
    shared = f"array_intersect({x}.sig, {y}.sig)"
    return f"{may_link(x, y)} and (size({shared}) < 2 or {x}.key = xxhash64(2, {shared}[0], {shared}[1]))"


def verify(pairs: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs of lines whose shingle sets reach the threshold, exactly."""
    x, y = sets.alias("x"), sets.alias("y")  # sizes and parity bitmaps rule most pairs out before any text is shuffled
    p = pairs.join(x, F.expr("a = x.node")).join(y, F.expr("b = y.node")).where(may_link("x", "y")).select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    got = p.join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b")
    common = F.size(F.array_intersect(line_shingles(F.col("la")), line_shingles(F.col("lb"))))
    return materialize(got.where(_let(common, lambda c: 100 * c >= THRESHOLD * (F.col("na") + F.col("nb") - c))).select("a", "b"), "links")


def deduplicate(documents: DataFrame) -> DataFrame:
    """Documents, with all their columns, whose text has lost its dropped lines.

    Only rows that may lose a line are shuffled; the others pass as they are.
    """
    dropped = dropped_lines(documents)
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")  # user columns stay apart from our own
    marked = in_bitmap(documents.select(row, F.xxhash64("text").alias("th")), "th", bitmap_rows(dropped, "th"))
    stay = marked.where("not _pf_maybe").select("row.*")
    may = marked.where("_pf_maybe").select("row", "th", F.col("row.doc_id").alias("own")).alias("l")
    joined = may.join(dropped.alias("r"), F.expr("l.own <=> r.doc_id and l.th = r.th"), "left").select("row", "dropped")
    kept = F.array_join(_let(F.split("row.text", "\n"), lambda lines: _without(lines, F.array_sort(F.col("dropped")))), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(kept)
    return stay.unionByName(joined.select(F.struct(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in documents.columns)).alias("row")).select("row.*"))


def _without(lines: Column, dropped: Column) -> Column:
    """Lines whose number isn't in the sorted array: the pieces between dropped numbers, put together."""

    def piece(d, i):
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1) + 1)
        return F.slice(lines, begin + 1, d - begin)

    ends = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.transform(ends, piece))
