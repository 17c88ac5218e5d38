"""Portfolio backtests in long form: weights, turnover, daily returns and metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.panel import pct, ratio

c = F.col


def rebalance_events(signals: DataFrame, every: int, top: int) -> DataFrame:
    """(exec_date, entity, weight): on every n-th date the top scores, held equally from the next date.

    The calendar is the distinct dates of signals, which are few.
    """
    w = Window.orderBy("trade_date")
    days = signals.select("trade_date").distinct()
    days = days.select("trade_date", (F.row_number().over(w) - 1).alias("_i"), F.lead("trade_date").over(w).alias("exec_date"))
    days = days.where((c("_i") % every == 0) & c("exec_date").isNotNull())
    ranked = signals.where("score is not null").join(days, "trade_date")
    ranked = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("score"), "entity"))).where(c("_k") <= top)
    return ranked.select("exec_date", "entity", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("exec_date"))).alias("weight"))


def weight_changes(events: DataFrame) -> DataFrame:
    """(exec_date, entity, weight, next_date, change): each event's weights with what came before them.

    Entities that leave get a weight of zero. An entity's previous weight is its last row's, if that is
    of the event just before: no join of consecutive weight sets is needed.
    """
    w = Window.orderBy("exec_date")
    order = events.select("exec_date").distinct().select("exec_date", F.row_number().over(w).alias("_i"), F.lead("exec_date").over(w).alias("next_date"))
    held = events.join(order, "exec_date")
    after = held.where("next_date is not null").select(c("next_date").alias("exec_date"), "entity", F.lit(0.0).alias("weight"))
    rows = held.select("exec_date", "entity", "weight").unionByName(after).groupBy("exec_date", "entity").agg(F.max("weight").alias("weight"))
    rows = rows.join(order, "exec_date")
    e = Window.partitionBy("entity").orderBy("exec_date")
    before = F.when(F.lag("_i").over(e) == c("_i") - 1, F.lag("weight").over(e)).otherwise(0.0)
    return rows.withColumn("change", F.abs(c("weight") - before)).drop("_i")


def _calendar(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Dates with their turnover, the last event before the date (exec_date) and the last one up to it (_any)."""
    turnover = weight_changes(events).groupBy("exec_date").agg(F.sum("change").alias("turnover"))
    days = panel.select("trade_date").distinct().join(turnover.withColumnRenamed("exec_date", "trade_date"), "trade_date", "left")
    past = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(c("turnover").isNotNull(), c("trade_date"))
    return days.select("trade_date", F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.last(mark, ignorenulls=True).over(past).alias("exec_date"), F.last(mark, ignorenulls=True).over(upto).alias("_any"))


def simulate(panel: DataFrame, events: DataFrame, cost: float) -> DataFrame:
    """Daily portfolio returns: close to close on the weights of the last event before the day.

    Weights don't drift, a missing return is zero, and each event costs the sum of weight changes times
    cost on its date. The weights in force on a date are found by an as-of window over the calendar, so
    the panel is joined by equality only.
    """
    days = _calendar(panel, events)
    r = panel.select("entity", "trade_date", F.coalesce(pct(c("close"), 1), F.lit(0.0)).alias("_r"))
    gross = days.join(events, "exec_date").join(r, ["entity", "trade_date"]).groupBy("trade_date").agg(F.sum(c("weight") * c("_r")).alias("gross"))
    out = days.where("_any is not null").join(gross, "trade_date", "left").withColumn("gross", F.coalesce("gross", F.lit(0.0)))
    return out.select("trade_date", "gross", "turnover", (c("gross") - c("turnover") * cost).alias("net"))


def simulate_open(panel: DataFrame, events: DataFrame, cost: float, entry_day: bool = False) -> DataFrame:
    """Daily portfolio returns of trades at the open: overnight on the old weights, cost, then the day.

    The day of an event is held on the old weights too, unless entry_day takes the new ones from its open
    to its close. A missing return is zero; the curve starts at the first event.
    """
    days = _calendar(panel, events)
    gap = ratio(c("open"), F.lag("close").over(Window.partitionBy("entity").orderBy("trade_date"))) - 1
    r = panel.select("entity", "trade_date", F.coalesce(gap, F.lit(0.0)).alias("_gap"), F.coalesce(ratio(c("close"), c("open")) - 1, F.lit(0.0)).alias("_day"))

    def held(on: str, value: str, name: str) -> DataFrame:
        weights = days.select("trade_date", c(on).alias("exec_date")).join(events, "exec_date")
        return weights.join(r, ["entity", "trade_date"]).groupBy("trade_date").agg(F.sum(c("weight") * c(value)).alias(name))

    night, day = held("exec_date", "_gap", "overnight"), held("_any" if entry_day else "exec_date", "_day", "intraday")
    out = days.where("_any is not null").join(night, "trade_date", "left").join(day, "trade_date", "left").na.fill(0.0, ["overnight", "intraday"])
    both = (1 + c("overnight")) * (1 + c("intraday"))
    return out.select("trade_date", "overnight", "intraday", (both - 1).alias("gross"), "turnover", (both * (1 - c("turnover") * cost) - 1).alias("net"))


def nav(curve: DataFrame) -> DataFrame:
    """Net asset value and drawdown from its running maximum."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    out = curve.withColumn("nav", F.product(1 + c("net")).over(w))
    return out.withColumn("drawdown", ratio(c("nav"), F.max("nav").over(w)) - 1)


def metrics(curve: DataFrame, per_year: int = 252) -> DataFrame:
    """Annual return, largest drawdown, Sharpe ratio, Calmar ratio, win rate and turnover of a curve."""
    s = nav(curve).agg(
        F.count(F.lit(1)).alias("n_days"), F.max_by("nav", "trade_date").alias("_nav"), F.min("drawdown").alias("max_drawdown"), F.avg("net").alias("_m"),
        F.stddev_pop("net").alias("_s"), F.avg((c("net") > 0).cast("double")).alias("win_rate"), F.sum("turnover").alias("turnover"),
    )
    annual = F.pow("_nav", per_year / c("n_days")) - 1
    s = s.withColumn("annual_return", annual)
    return s.select("n_days", "annual_return", "max_drawdown", ratio(c("_m") * math.sqrt(per_year), c("_s")).alias("sharpe"), ratio(c("annual_return"), -c("max_drawdown")).alias("calmar"), "win_rate", "turnover")


def cost_grid(curve: DataFrame, costs: list[float]) -> DataFrame:
    """Total and mean net return of one curve at several costs, in one aggregation."""
    grid = F.array(*(F.lit(float(x)) for x in costs))
    rows = curve.select("trade_date", "gross", "turnover", F.explode(grid).alias("cost")).withColumn("net", c("gross") - c("turnover") * c("cost"))
    return rows.groupBy("cost").agg((F.product(1 + c("net")) - 1).alias("total_return"), F.avg("net").alias("mean_net"), F.sum("turnover").alias("turnover"))


def excess_metrics(a: DataFrame, b: DataFrame, per_year: int = 252) -> DataFrame:
    """Mean excess, tracking error, information ratio and paired t of two curves on common dates."""
    x = a.select("trade_date", c("net").alias("_a")).join(b.select("trade_date", c("net").alias("_b")), "trade_date").withColumn("_x", c("_a") - c("_b"))
    s = x.agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"))
    return s.select("n", (c("_m") * per_year).alias("excess"), (c("_s") * math.sqrt(per_year)).alias("tracking_error"), ratio(c("_m") * math.sqrt(per_year), c("_s")).alias("information_ratio"), ratio(c("_m") * F.sqrt(c("n").cast("double")), c("_s")).alias("t_stat"))


def random_events(panel: DataFrame, every: int, top: int, trials: int, seed: int = 42) -> DataFrame:
    """(trial, exec_date, entity, weight): on every n-th date, for each trial, top entities drawn without replacement.

    A draw takes the entities with a close on the date in the order of a digest of seed, trial, date and entity, so it is
    the same on any partitioning. Held equally from the next date.
    """
    w = Window.orderBy("trade_date")  # a row a date
    days = panel.select("trade_date").distinct()
    days = days.select("trade_date", (F.row_number().over(w) - 1).alias("_i"), F.lead("trade_date").over(w).alias("exec_date")).where((c("_i") % every == 0) & c("exec_date").isNotNull())
    there = panel.where("close is not null").select("entity", "trade_date").join(days, "trade_date")
    each = there.select("trade_date", "exec_date", "entity", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), c("trial").cast("string"), c("trade_date").cast("string"), "entity"))
    ranked = each.withColumn("_k", F.row_number().over(Window.partitionBy("trial", "exec_date").orderBy(draw, "entity"))).where(c("_k") <= top)
    return ranked.select("trial", "exec_date", "entity", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("trial", "exec_date"))).alias("weight"))


def simulate_trials(panel: DataFrame, events: DataFrame, cost: float) -> DataFrame:
    """simulate_open for many trials (trial, exec_date, entity, weight) in one pass: daily curves by trial.

    The trials' calendars differ only in which dates have events, so weights meet returns by (entity, date) once.
    """
    order = events.select("trial", "exec_date").distinct()
    t = Window.partitionBy("trial").orderBy("exec_date")
    order = order.select("trial", "exec_date", F.row_number().over(t).alias("_i"), F.lead("exec_date").over(t).alias("next_date"))
    held = events.join(order, ["trial", "exec_date"])
    gone = held.where("next_date is not null").select("trial", c("next_date").alias("exec_date"), "entity", F.lit(0.0).alias("weight"), (c("_i") + 1).alias("_i"))
    rows = held.select("trial", "exec_date", "entity", "weight", "_i").unionByName(gone).groupBy("trial", "exec_date", "entity", "_i").agg(F.max("weight").alias("weight"))
    e = Window.partitionBy("trial", "entity").orderBy("exec_date")
    before = F.when(F.lag("_i").over(e) == c("_i") - 1, F.lag("weight").over(e)).otherwise(0.0)
    turnover = rows.withColumn("_d", F.abs(c("weight") - before)).groupBy("trial", "exec_date").agg(F.sum("_d").alias("turnover"))
    days = panel.select("trade_date").distinct()
    spans = order.select("trial", "exec_date", "next_date")
    # a date's returns are on the weights of the last event before it: the dates after an event up to the next one
    ends = days.agg(F.max("trade_date").alias("_end"))
    span = spans.crossJoin(F.broadcast(ends)).select("trial", "exec_date", F.explode(F.sequence(F.date_add("exec_date", 1), F.greatest(F.coalesce("next_date", "_end"), F.date_add("exec_date", 1)))).alias("trade_date"))  # one row
    span = span.join(days, "trade_date", "left_semi")
    gap = ratio(c("open"), F.lag("close").over(Window.partitionBy("entity").orderBy("trade_date"))) - 1
    r = panel.select("entity", "trade_date", F.coalesce(gap, F.lit(0.0)).alias("_gap"), F.coalesce(ratio(c("close"), c("open")) - 1, F.lit(0.0)).alias("_day"))
    gross = span.join(events, ["trial", "exec_date"]).join(r, ["entity", "trade_date"]).groupBy("trial", "trade_date").agg(F.sum(c("weight") * c("_gap")).alias("_night"), F.sum(c("weight") * c("_day")).alias("_intra"))
    first = order.groupBy("trial").agg(F.min("exec_date").alias("_first"))
    dates = span.select("trial", "trade_date").unionByName(first.select("trial", c("_first").alias("trade_date"))).distinct()
    out = dates.join(gross, ["trial", "trade_date"], "left").join(turnover.withColumnRenamed("exec_date", "trade_date"), ["trial", "trade_date"], "left").na.fill(0.0, ["_night", "_intra", "turnover"])
    both = (1 + c("_night")) * (1 + c("_intra"))
    return out.select("trial", "trade_date", (both - 1).alias("gross"), "turnover", (both * (1 - c("turnover") * cost) - 1).alias("net"))


def trial_metrics(curves: DataFrame, per_year: int = 252) -> DataFrame:
    """metrics of each trial's curve."""
    w = Window.partitionBy("trial").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    n = curves.withColumn("nav", F.product(1 + c("net")).over(w)).withColumn("drawdown", ratio(c("nav"), F.max("nav").over(w)) - 1)
    s = n.groupBy("trial").agg(F.count(F.lit(1)).alias("n_days"), F.max_by("nav", "trade_date").alias("_nav"), F.min("drawdown").alias("max_drawdown"), F.avg("net").alias("_m"), F.stddev_pop("net").alias("_s"), F.sum("turnover").alias("turnover"))
    s = s.withColumn("annual_return", F.pow("_nav", per_year / c("n_days")) - 1)
    return s.select("trial", "n_days", "annual_return", "max_drawdown", ratio(c("_m") * math.sqrt(per_year), c("_s")).alias("sharpe"), ratio(c("annual_return"), -c("max_drawdown")).alias("calmar"), "turnover")


def random_summary(trials: DataFrame, names: tuple[str, ...] = ("annual_return", "max_drawdown", "sharpe", "calmar", "turnover")) -> DataFrame:
    """(metric, mean, median, p75, p90, p95) over the trials, which are few."""
    long = trials.select(F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), c(x).cast("double").alias("v")) for x in names))).alias("m")).select("m.*").where("v is not null")
    q = F.percentile("v", F.array(*map(F.lit, (0.5, 0.75, 0.9, 0.95))))
    got = long.groupBy("metric").agg(F.avg("v").alias("mean"), q.alias("_q"))
    return got.select("metric", "mean", *(c("_q")[i].alias(x) for i, x in enumerate(("median", "p75", "p90", "p95"))))
