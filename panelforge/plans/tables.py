"""Panels over the driver's tables: trades are line items, entities are regions or nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.panel import bars
from panelforge.shared import materialize

c = F.col
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a price of moderate spread, their supplier's nation and region (joined by size)."""
    items = table(spark, sf_dir, "lineitem").select(*ORDER, "l_shipdate", "l_quantity", (50 + c("l_extendedprice") / 1000).alias("price"))
    where = (
        table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("n_nationkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", c("n_regionkey").alias("r_regionkey")), "n_nationkey")
        .join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")
    )
    return items.join(where.select("l_suppkey", "n_name", "r_name"), "l_suppkey")


def panel(spark: SparkSession, sf_dir: str, level: str = "r_name") -> DataFrame:
    """Daily bars, written: line items are read once, however often a query uses them. Bars are counted by calendar and entities."""
    return materialize(bars(ticks(spark, sf_dir), level, "l_shipdate", "price", "l_quantity", ORDER), "bars")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation bars with their region as sector."""
    sector = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_name").alias("entity"), c("r_name").alias("sector"))
    return panel(spark, sf_dir, "n_name").join(sector, "entity")


def states(features: DataFrame) -> DataFrame:
    """A label per row by rule: up and down by a fifth over 20 rows, else flat; no label without it."""
    label = F.when(c("ret_20d") > 0.2, "up").when(c("ret_20d") < -0.2, "down").when(c("ret_20d").isNotNull(), "flat")
    return features.select("entity", "trade_date", "close", "ret_20d", label.alias("label")).where("label is not null")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and no negative zero), for results that are compared across engines."""
    return df.select(*((F.round(c(n), digits) + 0.0).alias(n) if t == "double" else c(n) for n, t in df.dtypes))
