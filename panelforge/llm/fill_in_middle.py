"""Fill-in-middle transformation with DataFrame functions: cuts between tokens, found by a join on token numbers.

A text is a relation of units (document, ordinal, length): its tokens are exploded with their positions and a running
sum over a document's units gives where each ends. Cut requests (document, two ordinals) meet the units by ordinal, the
offsets that they find are aggregated per document, and substrings at these offsets make the output.

Only lengths are exploded, never text. They are dealt by document before they are exploded, so the window, the join and
the aggregation need no further shuffle; a document is one window, which Spark sorts and spills. Documents that stay
plain are neither exploded nor shuffled, the others move their text once, to meet their offsets.

Defined cases: a null text is empty; an empty text, or one with a marker in it, stays plain; a null doc_id draws like the
empty string; rows are told apart by 128 bits of hash of doc_id and text, so repeated rows are cut alike and each is
returned; the columns of the input travel in a struct, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_KEY = ["k1", "k2"]


def draw(doc_id: Column, i: int, seed: int = 42) -> Column:
    """The i-th (from 1) unsigned 32-bit draw of a document: eight hex digits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("bigint")


def form_of(text: Column, doc_id: Column, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> Column:
    """plain, psm or spm: rate per cent of the texts that can be cut are, spm_rate per cent of these suffix first."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (draw(doc_id, 3, seed) % 100 >= rate)
    return F.when(plain, "plain").when(draw(doc_id, 4, seed) % 100 < spm_rate, "spm").otherwise("psm")


def offsets(requests: DataFrame) -> DataFrame:
    """Where units end: (k1, k2, lo_end, hi_end) for requests (k1, k2, lengths array<int>, lo, hi), one per key.

    lo and hi count units from the start; zero units end at 0.
    """
    dealt = requests.repartition(*_KEY)
    units = dealt.select(*_KEY, F.posexplode("lengths").alias("pos", "length"))
    so_far = Window.partitionBy(*_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.select(*_KEY, (F.col("pos") + 1).alias("ordinal"), F.sum("length").over(so_far).alias("end"))
    cuts = requests.select(*_KEY, "lo", "hi").alias("c")
    at = F.expr("c.k1 = u.k1 and c.k2 = u.k2 and u.ordinal in (c.lo, c.hi)")
    found = cuts.join(ends.alias("u"), at, "left").groupBy("c.k1", "c.k2")
    end_of = lambda name: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(name), F.col("end"))), F.lit(0)).alias(f"{name}_end")
    return found.agg(end_of("lo"), end_of("hi"))


def transform(documents: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) of every document; row holds all its columns.

    n counts its tokens; the two lengths are in code points and null where the form is plain.
    """
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    keys = [F.xxhash64(F.lit(i), "doc_id", "text").alias(k) for i, k in enumerate(_KEY)]
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    known = documents.select(row, *keys, text.alias("body"), form_of(text, doc_id, seed, rate, spm_rate).alias("form"))
    none = F.lit(None).cast("bigint")
    plain = known.where("form = 'plain'").select("row", F.regexp_count("body", F.lit(TOKEN)).cast("bigint").alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("body").alias("output"))

    cut = known.where("form != 'plain'")
    lengths = F.transform(F.regexp_extract_all("body", F.lit(TOKEN), F.lit(0)), F.length)
    draws = [F.any_value(draw(F.col("row.doc_id"), i, seed)).alias(f"h{i}") for i in (1, 2)]
    once = cut.groupBy(*_KEY).agg(F.any_value(lengths).alias("lengths"), *draws).withColumn("n", F.size("lengths").cast("bigint"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    requests = materialize(once.select(*_KEY, "lengths", "n", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")), "cuts")
    at = offsets(requests).join(requests.select(*_KEY, "n"), _KEY)

    joined = cut.join(at, _KEY)
    body, lo, hi = F.col("body"), F.col("lo_end").cast("int"), F.col("hi_end").cast("int")
    prefix, middle, suffix = F.substring(body, F.lit(1), lo), F.substring(body, lo + 1, hi - lo), F.substring(body, hi + 1, F.length(body))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).otherwise(spm)
    return plain.unionByName(joined.select("row", "n", "form", lo.cast("bigint").alias("prefix_chars"), (hi - lo).cast("bigint").alias("middle_chars"), output.alias("output")))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = pieces[1], pieces[2], pieces[3]
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
