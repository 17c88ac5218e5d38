"""Tables as Parquet folders: normalised reads, keyed upserts, incremental starts, reports.

An upsert writes a new version of the table next to the old one and then points at it, so a job that
is lost half way leaves the old version whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import exchange_of, normal_code, number

c = F.col


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by order (add enough columns to make it certain)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(c("_k") == 1).drop("_k")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """existing with the columns of incoming's rows put into the rows with the same keys, and incoming's new rows added.

    Columns that incoming lacks keep their values (null in new rows), so rows of keys alone change nothing where the key
    exists. Of incoming rows with one key the first by order counts (by default the largest values); null keys are keys too.
    """
    missing = [k for k in keys if k not in incoming.columns]
    if missing:
        raise ValueError(f"incoming lacks key columns {missing}")
    new = dedupe(incoming, keys, order or [c(x).desc_nulls_last() for x in incoming.columns if x not in keys] or [c(keys[0])])
    old, new = existing.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    same = F.lit(True)
    for k in keys:
        same = same & c(f"o.{k}").eqNullSafe(c(f"n.{k}"))
    both = old.join(new, same, "full_outer")
    value = {x: c(f"o.{x}") for x in existing.columns}
    value |= {x: F.when(c("_new"), c(f"n.{x}")).otherwise(c(f"o.{x}") if x in value else F.lit(None)) for x in incoming.columns}
    return both.select(*(v.alias(x) for x, v in value.items()))


class Table:
    """A versioned Parquet table; path may be in any store that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def version(self) -> str | None:
        """The last version whose write was finished."""
        jvm, fs, root = self._fs()
        if not fs.exists(root):
            return None
        done = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=None)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/{v}") if v else None

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        v = self.version()
        n = int(v[1:9]) + 1 if v else 0
        out = df.write.partitionBy(*partition_by) if partition_by else df.write
        out.parquet(f"{self.path}/v{n:08d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, incoming: DataFrame) -> None:
        have = self.read()
        self.write(incoming if have is None else upsert(have, incoming, self.keys))

    def delete(self, condition: Column) -> tuple[int, int]:
        """Remove rows; returns the number of rows before and after."""
        have = self.read()
        if have is None:
            return 0, 0
        self.write(have.where(~F.coalesce(condition, F.lit(False))))
        return have.count(), self.read().count()


def incremental_start(panel: DataFrame, fallback: Column, lookback: int, end: Column) -> DataFrame:
    """(entity, start): from where each entity is read again: its last date less a look-back."""
    last = panel.groupBy("entity").agg(F.max("trade_date").alias("_last"))
    return last.select("entity", F.least(F.coalesce(F.date_sub("_last", lookback), fallback), end).alias("start"))


def normalise_bars(raw: DataFrame, names: dict[str, str], date_format: str = "yyyyMMdd") -> DataFrame:
    """Vendor rows to bars: renamed, codes and dates read, numbers coerced, one row per key (first source)."""
    df = raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})
    prices = ("open", "high", "low", "close", "volume", "amount")
    get = lambda k: number(c(k)) if k in df.columns else F.lit(None).cast("double")
    day = F.coalesce(F.try_to_timestamp(c("trade_date").cast("string"), F.lit(date_format)), c("trade_date").cast("string").try_cast("timestamp")).cast("date")
    code = normal_code(c("code"))
    rows = df.select(code.alias("entity"), exchange_of(code).alias("exchange"), day.alias("trade_date"), *(get(k).alias(k) for k in prices))
    rows = rows.where("entity is not null and trade_date is not null")
    return dedupe(rows, ["entity", "trade_date"], [c(k).desc_nulls_last() for k in prices])


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small report as one file; df must be an aggregate."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def merge_counters(stored: DataFrame, incoming: DataFrame, keys: list[str], add: list[str], last: list[str], when: str) -> DataFrame:
    """Counters after a batch: those in add are summed, those in last come from the row with the latest when.

    One aggregation over both; many incoming rows of one key are combined before the shuffle. Of rows with the
    same when, the largest values count.
    """
    rows = stored.select(*keys, when, *add, *last).unionByName(incoming.select(*keys, when, *add, *last))
    newest = F.max(F.struct(when, *last))
    out = rows.groupBy(*keys).agg(*(F.sum(F.coalesce(x, F.lit(0))).alias(x) for x in add), newest.alias("_n"))
    return out.select(*keys, c(f"_n.{when}").alias(when), *add, *(c(f"_n.{x}").alias(x) for x in last))
