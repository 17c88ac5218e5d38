"""Exact quantiles of large groups without a buffer that holds a group's values.

An order statistic is found by narrowing an interval of values: a round counts the values of the interval in BINS parts of
equal width, with map-side combine, and keeps the smallest and largest value of the part that has the wanted rank. An
interval ends as one value; a billion values take three or four rounds. Only a row a part, column and rank is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.shared import materialize, release

c = F.col
BINS = 1024


def quantiles(df: DataFrame, columns: list[str], qs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., a column for each of columns: array of its quantiles qs), interpolated between neighbours; nulls and NaN don't count.

    A column without values has null. Without by there is one row.
    """
    by = by or []
    named = F.explode(F.array(*(F.struct(F.lit(x).alias("column"), c(x).cast("double").alias("v")) for x in columns))).alias("cv")
    values = materialize(df.select(*by, named).select(*by, "cv.*").where("v is not null and not isnan(v)").withColumn("v", c("v") + 0.0), "values")
    keys = [*by, "column"]
    same = [F.expr(f"x.`{k}` <=> y.`{k}`") for k in keys]
    ranges = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    asked = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor((c("n") - 1) * q), F.ceil((c("n") - 1) * q)) for q in qs))))).alias("rank")
    state = materialize(ranges.select(*keys, "n", asked, "a", "b", F.lit(0).cast("bigint").alias("below")), "ranks")
    for _ in range(100):
        open_ = state.where("a < b")
        if open_.isEmpty():
            break
        half = (c("y.b") / 2 - c("y.a") / 2) / BINS  # halves, as b - a may pass the largest double
        part = F.least(F.greatest(F.floor(F.try_divide(c("x.v") / 2 - c("y.a") / 2, half)), F.lit(0)), F.lit(BINS - 1))
        cond = same[0]
        for x in [*same[1:], F.expr("x.v between y.a and y.b")]:
            cond = cond & x
        met = values.alias("x").join(open_.alias("y"), cond).select(*(c(f"y.{k}") for k in keys), "y.n", "y.rank", "y.below", F.coalesce(part, F.when(c("x.v") > c("y.a"), BINS - 1).otherwise(0)).alias("part"), "x.v")
        counts = met.groupBy(*keys, "n", "rank", "below", "part").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("a"), F.max("v").alias("b"))
        over = Window.partitionBy(*keys, "rank").orderBy("part")
        upto = counts.withColumn("upto", c("below") + F.sum("k").over(over))
        found = upto.where("upto > rank and upto - k <= rank").select(*keys, "n", "rank", "a", "b", (c("upto") - c("k")).alias("below"))
        nxt = materialize(state.where("a >= b").unionByName(found), "ranks")
        release(state)
        state = nxt
    at = state.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "a"))).alias("at"))

    def value(q: float):
        pos = (c("n") - 1) * q
        low, high = c("at")[F.floor(pos)], c("at")[F.ceil(pos)]
        return low + (high - low) * (pos - F.floor(pos))

    rows = at.select(*keys, F.array(*(value(q) for q in qs)).alias("q"))
    wide = rows.groupBy(*by).agg(*(F.max(F.when(c("column") == x, c("q"))).alias(x) for x in columns))
    out = materialize(wide, "quantiles")
    release(values, state)
    return out
