"""Audit of stored targets against prices: every row is made again and compared, in one pass or in micro-batches.

A row breaks a rule or it doesn't, so counts of broken rules add up over any division of the rows; the largest error of a
value is a maximum. Both are what a stream keeps between batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import targets
from panelforge.panel import in_time
from panelforge.shared import materialize

c = F.col
STATUSES = ["labeled", "insufficient_future", "cross_cutoff"]
USAGES = ["eligible", "diagnostic_only"]
VALUES = ["future_mae", "future_mdd", "future_return"]


def truth(panel: DataFrame, horizons: list[int], cutoff: Column) -> DataFrame:
    """(entity, trade_date, horizon, t_start, t_end, t_status, t_<value>...): what each row of targets has to say.

    Written, so that many batches can meet it.
    """
    parts = []
    for h in horizons:
        w = in_time()
        start, end = F.lead("trade_date", 1).over(w), F.lead("trade_date", h).over(w)
        dates = panel.select("entity", "trade_date", start.alias("t_start"), end.alias("t_end"))
        values = targets.path_metrics(panel, h).select("entity", "trade_date", *(c(v).alias(f"t_{v}") for v in VALUES))
        parts.append(dates.join(values, ["entity", "trade_date"]).select("entity", "trade_date", F.lit(h).cast("bigint").alias("horizon"), "t_start", "t_end", *(f"t_{v}" for v in VALUES)))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    status = F.when(c("t_end").isNull(), "insufficient_future").when(c("t_end") > cutoff, "cross_cutoff").otherwise("labeled")
    return materialize(rows.withColumn("t_status", status), "truth")


def broken_rules(stored: DataFrame, known: DataFrame, slices: DataFrame, breaks: DataFrame, cutoff: Column, tolerance: float = 1e-9) -> DataFrame:
    """stored with broken (array of rule names) and err_<value>.

    stored: (entity, trade_date, horizon, threshold, usage, status, start_date, end_date, event, weight, future_...).
    known: truth; slices: (horizon, threshold) that may occur; breaks: (entity) whose rows may not be used.
    """
    allowed = slices.select("horizon", "threshold", F.lit(True).alias("_slice")).distinct()
    bad = breaks.select("entity", F.lit(True).alias("_break")).distinct()
    rows = stored.join(known, ["entity", "trade_date", "horizon"], "left").join(allowed, ["horizon", "threshold"], "left").join(bad, "entity", "left")
    labeled, seen = c("status") == "labeled", c("t_status").isNotNull()
    off = {v: F.abs(c(v) - c(f"t_{v}")) for v in VALUES}
    differs = lambda v: labeled & seen & ((off[v] > tolerance) | (c(v).isNull() != c(f"t_{v}").isNull()))
    event = c("t_future_mae") <= -c("threshold")
    rules = {
        "row_without_price": ~seen, "silent_break_entity": c("_break").isNotNull(), "unknown_slice": c("_slice").isNull(), "unknown_usage": ~F.coalesce(c("usage").isin(USAGES), F.lit(False)), "unknown_status": ~F.coalesce(c("status").isin(STATUSES), F.lit(False)),
        "wrong_status": seen & c("status").isin(STATUSES) & (c("status") != c("t_status")), "starts_too_early": c("start_date") <= c("trade_date"), "ends_before_start": c("end_date") < c("start_date"), "labeled_past_cutoff": labeled & (c("end_date") > cutoff),
        "wrong_start": labeled & seen & ~c("start_date").eqNullSafe(c("t_start")), "wrong_end": labeled & seen & ~c("end_date").eqNullSafe(c("t_end")), "label_missing": labeled & c("event").isNull(), "label_not_allowed": ~labeled & c("event").isNotNull(),
        "wrong_label": labeled & (c("event") != event), "weight_missing": labeled & ~F.coalesce(c("weight") > 0, F.lit(False)), "weight_not_allowed": ~labeled & (c("weight") > 0), **{f"wrong_{v}": differs(v) for v in VALUES},
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return rows.select(*stored.columns, broken.alias("broken"), *(F.when(labeled & seen, off[v]).alias(f"err_{v}") for v in VALUES))


def counters(audited: DataFrame) -> DataFrame:
    """(check, n, worst): rows that break each rule, all rows (rows), rows that break any (broken_rows), and the largest errors."""
    rule = F.transform("broken", lambda x: F.struct(x.alias("check"), F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("double").alias("worst")))
    size = F.array(
        F.struct(F.lit("rows").alias("check"), F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("double").alias("worst")),
        F.struct(F.lit("broken_rows").alias("check"), (F.size("broken") > 0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("worst")),
        *(F.struct(F.lit(f"error_{v}").alias("check"), c(f"err_{v}").isNotNull().cast("bigint").alias("n"), c(f"err_{v}").alias("worst")) for v in VALUES),
    )
    return added(audited.select(F.inline(F.concat(size, rule))))


def added(parts: DataFrame) -> DataFrame:
    """Counters of parts put together."""
    return parts.groupBy("check").agg(F.sum("n").alias("n"), F.max("worst").alias("worst"))


def duplicates(stored: DataFrame) -> DataFrame:
    """(check, n, worst) of rows that repeat a key; needs all rows together, so a batch doesn't know it."""
    keys = stored.groupBy("entity", "trade_date", "horizon", "threshold").agg(F.count(F.lit(1)).alias("k"))
    return keys.agg(F.lit("repeated_key").alias("check"), F.coalesce(F.sum(c("k") - 1), F.lit(0)).cast("bigint").alias("n"), F.lit(None).cast("double").alias("worst"))
