"""Scalar functions on columns: codes, coercion, buckets, entropy, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_code(x: Column) -> Column:
    """First run of one to six digits, padded to six; null without digits."""
    digits = F.regexp_extract(x.cast("string"), r"(\d{1,6})", 1)
    return F.when(digits != "", F.lpad(digits, 6, "0"))


def exchange_of(code: Column) -> Column:
    """Exchange suffix of a normal code; 920 comes before the rest of 9."""
    return (
        F.when(code.startswith("4") | code.startswith("8") | code.startswith("920"), "BJ")
        .when(code.startswith("5") | code.startswith("6") | code.startswith("9"), "SH")
        .when(code.isNotNull(), "SZ")
    )


def number(x: Column) -> Column:
    """Text as a double; what can't be read, and NaN and infinities, are null."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def bucket(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the right-closed interval between edges that holds x; null outside."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((x > low) & (x <= high), label)
    return out


def period_key(day: Column, period: str) -> Column:
    """Key of a date's month, quarter, year or day."""
    return {
        "month": F.date_format(day, "yyyy-MM"),
        "quarter": F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")),
        "year": F.year(day).cast("string"),
        "day": F.date_format(day, "yyyy-MM-dd"),
    }[period]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def row_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of rows and an order-independent digest of the given columns, by aggregation."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).select("n", F.sha2(F.concat_ws("|", "n", "x", "s"), 256).alias("digest"))


def canonical_json(names: list[str], types: dict[str, str] | None = None) -> Column:
    """JSON of the named columns with sorted keys and no blanks; nulls stay, and NaN (of columns typed double or float) is null."""
    floats = {"double", "float"}
    value = lambda n: F.when(~F.isnan(n), F.col(n)) if (types or {}).get(n) in floats else F.col(n)
    return F.to_json(F.struct(*(value(n).alias(n) for n in sorted(names))), {"ignoreNullFields": "false"})


def lineage_key(names: list[str], types: dict[str, str] | None = None) -> Column:
    """First 32 hex digits of the SHA-256 of the canonical JSON."""
    return F.substring(F.sha2(canonical_json(names, types), 256), 1, 32)
