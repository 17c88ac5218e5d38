"""Scores, ranks, screens and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.panel import average_rank, in_time, ratio

c = F.col


def latest(df: DataFrame, entity: str = "entity", order: str = "trade_date") -> DataFrame:
    """Each entity's last row, by an aggregate with map-side combine."""
    rest = [x for x in df.columns if x != entity]
    return df.groupBy(entity).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(entity, "_r.*")


def last_rows(df: DataFrame, n: int, entity: str = "entity", order: str = "trade_date") -> DataFrame:
    """Each entity's last n rows."""
    w = Window.partitionBy(entity).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where(c("_k") <= n).drop("_k")


def normalised(x: Column, *partition: str) -> Column:
    """z-score over the frame (or partition), clipped to 3, zero without spread or value."""
    w = Window.partitionBy(*partition)
    z = ratio(x - F.avg(x).over(w), F.stddev_pop(x).over(w))
    return F.coalesce(F.greatest(F.least(z, F.lit(3.0)), F.lit(-3.0)), F.lit(0.0))


def sector_scores(df: DataFrame, *partition: str) -> DataFrame:
    """Composite score of strength, momentum, turnover and risk, with a rule tag; df has the features
    rs_20d, ret_20d, amount_z, vol_20d and the probabilities p_up and p_risk."""
    z = lambda x: normalised(c(x), *partition)
    score = 0.35 * F.coalesce("p_up", F.lit(0.0)) + 0.25 * z("rs_20d") + 0.15 * z("ret_20d") + 0.15 * z("amount_z") - 0.10 * z("vol_20d") - 0.10 * F.coalesce("p_risk", F.lit(0.0))
    return df.withColumn("score", score).withColumn("tag", sector_tag())


def sector_tag() -> Column:
    """First rule that holds; a null counts as zero."""
    v = lambda x: F.coalesce(x, F.lit(0.0))
    return (
        F.when((v("p_risk") >= 0.6) | (v("drawdown") <= -0.15), "risk")
        .when((v("p_up") >= 0.6) & (v("rs_20d") > 0) & (v("amount_z") > 0.5), "leader")
        .when((v("p_up") >= 0.5) & (v("ret_20d") > 0), "trend")
        .when((v("drawdown") < -0.05) & (v("rs_20d") > 0), "repair")
        .otherwise("neutral")
    )


def funnel(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(step, rule, before, after, removed) of ordered predicates, in one pass: each row is counted at
    the first rule that it fails (a null fails)."""
    first = F.lit(len(rules))
    for i, (_, rule) in reversed(list(enumerate(rules))):
        first = F.when(F.coalesce(rule, F.lit(False)), first).otherwise(i)
    counts = df.agg(*(F.count_if(first >= i).alias(f"_{i}") for i in range(len(rules) + 1)))
    steps = F.array(*(F.struct(F.lit(i + 1).cast("bigint").alias("step"), F.lit(name).alias("rule"), c(f"_{i}").alias("before"), c(f"_{i + 1}").alias("after"), (c(f"_{i}") - c(f"_{i + 1}")).alias("removed")) for i, (name, _) in enumerate(rules)))
    return counts.select(F.inline(steps))


def percentile_bands(df: DataFrame, column: str, *partition: str) -> DataFrame:
    """Average-rank percentile of a column and its band (high from .8, elevated from .6, low to .2)."""
    p = average_rank(c(column), *partition) / F.count(column).over(Window.partitionBy(*partition))
    band = F.when(c("pct_rank").isNull(), "unknown").when(c("pct_rank") >= 0.8, "high").when(c("pct_rank") >= 0.6, "elevated").when(c("pct_rank") <= 0.2, "low").otherwise("normal")
    return df.withColumn("pct_rank", p).withColumn("band", band)


def recent_switches(states: DataFrame, limit: int) -> DataFrame:
    """The newest changes of label, ties by entity; a top-k report."""
    before = F.lag("label").over(in_time())
    moved = states.withColumn("from_label", before).where(c("from_label").isNotNull() & (c("from_label") != c("label")))
    return moved.select("entity", "trade_date", "from_label", c("label").alias("to_label")).orderBy(F.desc("trade_date"), "entity").limit(limit)


def as_of_members(members: DataFrame, day: Column) -> DataFrame:
    """Members whose validity holds on a day; an open end is null."""
    return members.where((c("valid_from").isNull() | (c("valid_from") <= day)) & (c("valid_to").isNull() | (c("valid_to") > day)))


def risk_flags(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The names of the rules that hold, as an array, as JSON and as a count; a null doesn't hold."""
    names = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))
    return df.withColumn("flags", names).withColumn("flags_json", F.to_json("flags")).withColumn("n_flags", F.size("flags").cast("bigint"))


def overlay(panel: DataFrame, start: Column) -> DataFrame:
    """Closes from a date on, as percent of each entity's first close there."""
    w = in_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = panel.where(c("trade_date") >= start)
    return rows.select("entity", "trade_date", (100 * ratio(c("close"), F.first("close", ignorenulls=True).over(w))).alias("level"))


def source_summary(df: DataFrame, source: str, keys: list[str], top: int = 20) -> DataFrame:
    """A top-k report: rows per source, with its distinct keys and its repeated rows."""
    n = df.groupBy(source, *keys).count().groupBy(source).agg(F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    return n.withColumn("n_repeats", c("n_rows") - c("n_keys")).orderBy(F.desc("n_rows"), source).limit(top)
