"""Forward targets with explicit censoring, and purged validation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.panel import in_time, pct, ratio

c = F.col


def tradable_forward_returns(panel: DataFrame, horizons: list[int]) -> DataFrame:
    """Return from the next row's open to the close h rows ahead; null without a positive entry."""
    w = in_time()
    entry = F.lead("open").over(w)
    entry = F.when(entry > 0, entry)
    cols = [(ratio(F.lead("close", h).over(w), entry) - 1).alias(f"fwd_{h}") for h in horizons]
    return panel.select("entity", "trade_date", F.lead("trade_date").over(w).alias("exec_date"), *(F.lead("trade_date", h).over(w).alias(f"exit_date_{h}") for h in horizons), *cols)


def next_open_returns(panel: DataFrame) -> DataFrame:
    """Return from the next row's open to the open after it."""
    w = in_time()
    return panel.select("entity", "trade_date", (ratio(F.lead("open", 2).over(w), F.lead("open", 1).over(w)) - 1).alias("open_ret"))


def path_metrics(panel: DataFrame, horizon: int) -> DataFrame:
    """Along the next horizon closes: return, worst return, largest fall, volatility and downside.

    Null where the horizon isn't complete, or a price on the path is null or not a positive number. The path of a row is
    an array of horizon + 1 closes.
    """
    from panelforge.operators.features import max_drawdown_of

    path = F.collect_list("close").over(in_time().rowsBetween(0, horizon))
    rows = panel.select("entity", "trade_date", path.alias("p"))
    rows = rows.withColumn("_ok", (F.size("p") == horizon + 1) & F.forall("p", lambda x: (x > 0) & (x < float("inf"))))
    rel = F.transform(F.slice("p", 2, horizon), lambda x: ratio(x, c("p")[0]) - 1)
    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: ratio(F.get("p", i), F.get("p", i - 1)) - 1)
    ok = lambda x: F.when(c("_ok"), x)
    rows = rows.select("entity", "trade_date", "_ok", "p", ok(rel).alias("rel"), ok(steps).alias("steps"))
    losses = F.filter("steps", lambda x: x < 0)
    return rows.select(
        "entity", "trade_date", F.get("rel", F.lit(horizon - 1)).alias("future_return"), F.array_min("rel").alias("future_mae"), ok(max_drawdown_of(c("p"))).alias("future_mdd"),
        population_std(c("steps")).alias("future_vol"), ok(F.when(F.size(losses) > 0, population_std(losses)).otherwise(0.0)).alias("downside_vol"),
    )


def population_std(x: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(a, v):
        n, d = a["n"] + 1, v - a["m"]
        m = a["m"] + d / n
        return F.struct(n.alias("n"), m.alias("m"), (a["s"] + d * (v - m)).alias("s"))

    return F.aggregate(x, start, step, lambda a: F.when(a["n"] > 0, F.sqrt(a["s"] / F.greatest(a["n"], F.lit(1.0)))))


def mae_events(panel: DataFrame, horizons: list[int], thresholds: list[float], cutoff: Column | None = None) -> DataFrame:
    """For each row, horizon and threshold: did the close fall by the threshold, and may that be known?

    Rows whose horizon ends after the cutoff, or isn't complete, have no label but a reason.
    """
    w = in_time()
    parts = []
    for h in horizons:
        low = F.min("close").over(w.rowsBetween(1, h))
        end = F.lead("trade_date", h).over(w)
        parts.append(F.struct(F.lit(h).cast("bigint").alias("horizon"), (ratio(low, c("close")) - 1).alias("mae"), end.alias("end_date")))
    grid = F.array(*(F.lit(t) for t in thresholds))
    rows = panel.select("entity", "trade_date", F.array(*parts).alias("hs"))
    rows = rows.select("entity", "trade_date", F.inline("hs")).select("*", F.explode(grid).alias("threshold"))
    late = c("end_date") > cutoff if cutoff is not None else F.lit(False)
    status = F.when(c("end_date").isNull(), "insufficient_future").when(late, "cross_cutoff").otherwise("labeled")
    return rows.withColumn("status", status).withColumn("event", F.when(c("status") == "labeled", c("mae") <= -c("threshold"))).drop("end_date")


def fold_plan(dates: DataFrame, folds: int, horizon: int, embargo: int) -> DataFrame:
    """(fold, trade_date, role) over distinct dates: train before, validation, purge and embargo.

    Dates are cut into folds + 1 consecutive chunks; chunk k validates fold k. Earlier dates whose
    horizon reaches into it are purged, the embargo dates after it are left out. Dates are few: one
    small window; folds multiply them by a number.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy())
    pos = F.row_number().over(Window.orderBy("trade_date"))
    d = dates.select("trade_date").distinct().select("trade_date", pos.alias("pos"), n.alias("n"))
    size, extra = F.floor(c("n") / (folds + 1)), c("n") % (folds + 1)
    # the first `extra` chunks have one date more
    start = lambda k: F.lit(k) * size + F.least(F.lit(k), extra) + 1
    rows = []
    for k in range(1, folds + 1):
        a, b = start(k), start(k + 1)
        role = F.when(c("pos") < a - horizon, "train").when(c("pos") < a, "purged").when(c("pos") < b, "validation").when(c("pos") < b + embargo, "embargo")
        rows.append(F.struct(F.lit(k).cast("bigint").alias("fold"), role.alias("role")))
    return d.select("trade_date", F.inline(F.array(*rows))).where("role is not null").select("fold", "trade_date", "role")


def overlapping_windows(targets: DataFrame) -> DataFrame:
    """How many earlier windows [start, end] of its entity still run when each one starts.

    A sweep instead of a join of all pairs: the running count of starts less that of ends.
    """
    marks = targets.select("entity", c("start").alias("d"), F.lit(1).alias("k"), F.lit(1).alias("step"), c("start"), c("end")).unionByName(
        targets.select("entity", c("end").alias("d"), F.lit(2).alias("k"), F.lit(-1).alias("step"), c("start"), c("end"))
    )
    w = Window.partitionBy("entity").orderBy("d", "k", "start", "end")
    open_ = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marks.withColumn("overlapping", F.coalesce(open_, F.lit(0))).where("k = 1").select("entity", "start", "end", "overlapping")


def overlaps_any(windows: DataFrame, others: DataFrame) -> DataFrame:
    """Flag windows [start, end] of an entity that overlap any window of others in the same entity.

    As-of form: among others' windows in start order, the largest end so far at or before this end.
    """
    a = windows.select("entity", "start", "end", c("end").alias("at"), F.lit(1).alias("own"), F.lit(None).cast("date").alias("upto"))
    b = others.select("entity", F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), c("start").alias("at"), F.lit(0).alias("own"), c("end").alias("upto"))
    w = Window.partitionBy("entity").orderBy("at", "own").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("reach", F.max("upto").over(w))
    return rows.where("own = 1").select("entity", "start", "end", F.coalesce(c("reach") >= c("start"), F.lit(False)).alias("overlaps"))


def checkpoint_dates(dates: DataFrame, period: str = "MM") -> DataFrame:
    """Last date of each period (MM, QUARTER, YEAR)."""
    return dates.groupBy(F.trunc("trade_date", period).alias("period")).agg(F.max("trade_date").alias("checkpoint"))


def training_window(panel: DataFrame, signal: Column, n_dates: int, least: int) -> DataFrame:
    """Rows of the last n distinct dates up to a signal date, of entities with enough of them."""
    upto = panel.where(c("trade_date") <= signal)
    dates = upto.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n_dates)
    rows = upto.join(dates, "trade_date", "left_semi")
    enough = rows.groupBy("entity").count().where(c("count") >= least)
    return rows.join(enough.select("entity"), "entity", "left_semi")


def scaled_thresholds(panel: DataFrame, horizons: list[int], factors: list[float], low: float = 0.02, high: float = 0.15) -> DataFrame:
    """Event thresholds from volatility: sigma times root of the horizon times a factor, clamped."""
    from panelforge.panel import rolling

    r = panel.withColumn("_r", pct(c("close"), 1)).select("entity", "trade_date", rolling(F.stddev_pop, c("_r"), 20, 10).alias("sigma"))
    grid = F.array(*(F.struct(F.lit(h).cast("bigint").alias("horizon"), F.lit(float(k)).alias("factor")) for h in horizons for k in factors))
    raw = c("sigma") * F.sqrt(c("horizon").cast("double")) * c("factor")
    return r.select("entity", "trade_date", "sigma", F.inline(grid)).withColumn("threshold", F.when(raw.isNotNull(), F.greatest(F.least(raw, F.lit(high)), F.lit(low))))


def forward_frame(panel: DataFrame, horizons: list[int]) -> DataFrame:
    """Per row: return over the next h rows, its excess over the equal-weight market's next h dates, worst close on the way."""
    w, days = in_time(), Window.orderBy("trade_date")
    market = panel.select("trade_date", pct(c("close"), 1).alias("_r")).groupBy("trade_date").agg(F.avg("_r").alias("_m"))
    ahead = lambda h: days.rowsBetween(1, h)
    market = market.select("trade_date", *(F.when(F.count("_m").over(ahead(h)) == h, F.product(1 + c("_m")).over(ahead(h)) - 1).alias(f"_b{h}") for h in horizons))
    rows = panel.select(
        "entity", "trade_date",
        *(x for h in horizons for x in ((ratio(F.lead("close", h).over(w), c("close")) - 1).alias(f"fwd_ret_{h}"), (ratio(F.min("close").over(w.rowsBetween(1, h)), c("close")) - 1).alias(f"fwd_mae_{h}"))),
    ).join(market, "trade_date")
    return rows.select("entity", "trade_date", *(x for h in horizons for x in (c(f"fwd_ret_{h}"), (c(f"fwd_ret_{h}") - c(f"_b{h}")).alias(f"fwd_excess_{h}"), c(f"fwd_mae_{h}"))))
