"""Causal features of panels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.quantiles import quantiles
from panelforge.panel import average_rank, in_time, islands, pct, ratio, rolling, zscore

c = F.col


def equal_weight_benchmark(panel: DataFrame, n: int = 20) -> DataFrame:
    """(trade_date, benchmark_ret): the entities' mean daily return, compounded over exactly n days.

    Dates are few, so the window over them is one small task after a shuffled aggregation.
    """
    daily = panel.withColumn("_r", pct(c("close"), 1)).groupBy("trade_date").agg(F.avg("_r").alias("_r"))
    w = Window.orderBy("trade_date")
    return daily.select("trade_date", (rolling(F.product, 1 + c("_r"), n, n, w) - 1).alias("benchmark_ret"))


def sector_features(panel: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Returns, volatility, amount z-score, relative strength, drawdown, slope and gaps per entity."""
    ret1 = panel.withColumn("ret_1d", pct(c("close"), 1))
    if benchmark is not None:
        ret1 = ret1.join(benchmark, "trade_date", "left")
    ret20 = pct(c("close"), 20)
    feats = ret1.withColumn("_ma20", rolling(F.avg, c("close"), 20, 10))
    amount_z = zscore(c("amount"), 20, 10)
    prev = F.lag("close").over(in_time())
    return feats.select(
        "entity",
        "trade_date",
        "close",
        "ret_1d",
        pct(c("close"), 5).alias("ret_5d"),
        ret20.alias("ret_20d"),
        (rolling(F.stddev_pop, c("ret_1d"), 20, 10) * math.sqrt(20)).alias("vol_20d"),
        amount_z.alias("amount_z"),
        (ret20 - c("benchmark_ret") if benchmark is not None else ret20).alias("rs_20d"),
        (ratio(c("close"), rolling(F.max, c("close"), 20, 10)) - 1).alias("drawdown"),
        (ratio(c("_ma20"), F.lag("_ma20", 5).over(in_time())) - 1).alias("ma20_slope"),
        (ratio(c("open"), prev) - 1).alias("gap_1d"),
        (ratio(c("close"), c("open")) - 1).alias("intraday"),
    )


def winsorize(df: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.99, least: int = 10) -> DataFrame:
    """Clip columns to their exact quantiles over the whole frame, where there are over least values.

    The quantiles are one row, joined back as such, and found without a buffer of all values.
    """
    counts = df.agg(*(F.count(x).alias(f"_n_{x}") for x in columns))
    bounds = quantiles(df, columns, [lower, upper]).select(*(c(x).alias(f"_q_{x}") for x in columns))
    out = df.crossJoin(F.broadcast(counts)).join(F.broadcast(bounds), how="left")  # one row each; no bounds if no column has a value
    for x in columns:
        clipped = F.greatest(F.least(c(x), c(f"_q_{x}")[1]), c(f"_q_{x}")[0])
        out = out.withColumn(x, F.when(c(x).isNotNull(), F.when(c(f"_n_{x}") > least, clipped).otherwise(c(x))))
    return out.select(df.columns)


def regime_features(panel: DataFrame) -> DataFrame:
    """The wide feature set of the regime model: returns, excess, volatility, drawdown, slope, amount."""
    w = in_time()
    base = panel.withColumn("_r", pct(c("close"), 1))
    daily = base.groupBy("trade_date").agg(F.avg("_r").alias("_m"))
    over = Window.orderBy("trade_date")
    market = daily.select("trade_date", *((rolling(F.product, 1 + c("_m"), n, n, over) - 1).alias(f"_m{n}") for n in (5, 10, 20)))
    base = base.join(market, "trade_date", "left")
    base = base.select("*", *(rolling(F.avg, c("close"), n, max(3, n // 2)).alias(f"_ma{n}") for n in (5, 10, 20)))
    loss = F.when(c("_r") > 0, 0.0).otherwise(c("_r"))
    cols = [pct(c("close"), k).alias(f"ret_{k}") for k in (1, 3, 5, 10, 20)]
    cols += [(pct(c("close"), n) - c(f"_m{n}")).alias(f"excess_{n}") for n in (5, 10, 20)]
    cols += [(ratio(1 + pct(c("close"), n), 1 + c(f"_m{n}")) - 1).alias(f"rs_{n}") for n in (5, 10, 20)]
    for n in (5, 10, 20):
        mp = max(3, n // 2)
        cols += [
            (rolling(F.stddev_pop, c("_r"), n, mp) * math.sqrt(n)).alias(f"vol_{n}"),
            (ratio(c("close"), rolling(F.max, c("close"), n, mp)) - 1).alias(f"drawdown_{n}"),
            (ratio(c(f"_ma{n}"), F.lag(f"_ma{n}", max(1, n // 4)).over(w)) - 1).alias(f"slope_{n}"),
            zscore(c("amount"), n, mp).alias(f"amount_z_{n}"),
        ]
    cols += [(rolling(F.stddev_pop, loss, n, 3) * math.sqrt(n)).alias(f"downside_{n}") for n in (5, 10)]
    return base.select("entity", "trade_date", *cols)


def member_features(members: DataFrame, sector: DataFrame, market: DataFrame) -> DataFrame:
    """Features of members against their sector (entity, trade_date, close) and the market (trade_date, close).

    members has a column sector that names the sector's entity. Dates are aligned by equality.
    """
    w = in_time()
    own = members.select(
        "entity", "sector", "trade_date", "close",
        pct(c("close"), 20).alias("ret_20d"), zscore(c("amount"), 20, 10).alias("amount_z"),
        (ratio(c("close"), rolling(F.max, c("close"), 20, 10)) - 1).alias("drawdown"), rolling(F.avg, c("close"), 20, 10).alias("ma20"),
    ).withColumn("slope", ratio(c("ma20"), F.lag("ma20", 5).over(w)) - 1)
    sec = sector.select(c("entity").alias("sector"), "trade_date", pct(c("close"), 20).alias("_sec"))
    mkt = market.select("trade_date", pct(c("close"), 20, Window.orderBy("trade_date")).alias("_mkt"))
    joined = own.join(sec, ["sector", "trade_date"], "left").join(mkt, "trade_date", "left")
    trend = (F.coalesce(c("close") > c("ma20"), F.lit(False)).cast("double") + F.coalesce(c("slope") > 0, F.lit(False)).cast("double")) / 2
    return joined.select("entity", "trade_date", "ret_20d", (c("ret_20d") - c("_sec")).alias("rs_sector"), (c("ret_20d") - c("_mkt")).alias("rs_market"), "amount_z", "drawdown", "slope", trend.alias("trend_quality"))


def limit_flags(panel: DataFrame, limit: float = 0.098) -> DataFrame:
    """Limit-up and -down days, one-price limits, suspensions, and how many limit-ups in a row so far."""
    r = pct(c("close"), 1)
    flat = (c("open") == c("high")) & (c("high") == c("low")) & (c("low") == c("close"))
    flags = panel.select(
        "entity", "trade_date",
        F.coalesce(r >= limit, F.lit(False)).alias("limit_up"), F.coalesce(r <= -limit, F.lit(False)).alias("limit_down"),
        F.coalesce(flat & (F.abs(r) >= limit), F.lit(False)).alias("one_price"),
        (c("close").isNull() | (F.coalesce(c("volume"), F.lit(0.0)) <= 0)).alias("suspended"),
    )
    w = in_time("entity", "segment")
    run = F.when(c("limit_up"), F.row_number().over(w)).otherwise(0).cast("bigint")
    return islands(flags, "limit_up").withColumn("limit_up_run", run).drop("segment")


def market_features(panel: DataFrame, names: list[str]) -> DataFrame:
    """One row per date: return and volatility of the named indices side by side, and their dispersion."""
    f = panel.where(c("entity").isin(names)).select("entity", "trade_date", pct(c("close"), 20).alias("ret"), pct(c("close"), 1).alias("_r"))
    f = f.withColumn("vol", rolling(F.stddev_pop, c("_r"), 20, 10) * math.sqrt(20))
    wide = f.groupBy("trade_date").pivot("entity", names).agg(F.max("ret").alias("ret"), F.max("vol").alias("vol"))
    spread = f.groupBy("trade_date").agg(F.stddev_pop("ret").alias("dispersion"))
    out = wide.join(spread, "trade_date")
    return out.withColumn("first_vs_last", c(f"{names[0]}_ret") - c(f"{names[-1]}_ret"))


def price_baselines(panel: DataFrame) -> DataFrame:
    """Range-based and return-based volatilities and rolling maximum drawdown."""
    w = in_time()
    r = panel.withColumn("_r", pct(c("close"), 1))
    valid = (c("open") > 0) & (c("low") > 0) & (c("close") > 0) & (c("high") > 0)
    log = lambda a, b: F.log(ratio(c(a), c(b)))
    hl, co = log("high", "low"), log("close", "open")
    sources = {
        "parkinson": hl * hl / (4 * math.log(2)),
        "garman_klass": F.greatest(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, F.lit(0.0)),
        "rogers_satchell": F.greatest(log("high", "close") * log("high", "open") + log("low", "close") * log("low", "open"), F.lit(0.0)),
    }
    r = r.select("*", *(F.when(valid, x).alias(f"_{k}") for k, x in sources.items()))
    loss = F.when(c("_r") > 0, 0.0).otherwise(c("_r"))
    return r.select(
        "entity", "trade_date",
        rolling(F.stddev_pop, c("_r"), 20, 5).alias("vol_20"), rolling(F.stddev_pop, c("_r"), 60, 10).alias("vol_60"),
        rolling(F.stddev_pop, loss, 20, 5).alias("downside_20"),
        *(F.sqrt(rolling(F.avg, c(f"_{k}"), 20, 5)).alias(k) for k in sources),
        rolling(F.avg, ratio(c("high") - c("low"), c("close")), 20, 5).alias("range_ratio"),
        (ratio(c("close"), rolling(F.max, c("high"), 60, 10)) - 1).alias("from_high"),
        max_drawdown_of(F.collect_list("close").over(w.rowsBetween(-19, 0))).alias("max_drawdown_20"),
    )


def max_drawdown_of(path: Column) -> Column:
    """Largest fall from a running maximum along an array of prices, as a number from 0."""
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(s, x):
        peak = F.greatest(s["peak"], x)
        return F.struct(peak.alias("peak"), F.greatest(s["worst"], F.coalesce(1 - ratio(x, peak), F.lit(0.0))).alias("worst"))

    return F.aggregate(path, start, step, lambda s: s["worst"])


def ewma_volatility(panel: DataFrame, span: int = 20, min_periods: int = 5, memory: int = 200) -> DataFrame:
    """Root of the exponentially weighted mean square return (adjust=False).

    The recursion is folded over the last memory rows, where older weights are below 1e-8 at span 20.
    """
    alpha = 2 / (span + 1)
    sq = panel.withColumn("_r", pct(c("close"), 1))
    hist = F.collect_list(c("_r") * c("_r")).over(in_time().rowsBetween(-(memory - 1), 0))
    fold = F.aggregate(F.slice(hist, 2, memory), hist[0], lambda s, x: (1 - alpha) * s + alpha * x)
    return sq.select("entity", "trade_date", F.when(F.size(hist) >= min_periods, F.sqrt(fold)).alias("ewma_vol"))


def shifted(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as of the row before, with the date they are of."""
    w = in_time()
    return features.select("entity", "trade_date", F.lag("trade_date").over(w).alias("asof_date"), *(F.lag(x).over(w).alias(x) for x in columns))


def causal_zscore(df: DataFrame, column: str, n: int = 60, min_periods: int = 20, entity: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Distance of each value from the mean of the n rows before it, in their deviations."""
    w = in_time(*entity) if entity else Window.orderBy("trade_date")
    x = c(column)
    spread = rolling(F.stddev_pop, x, n, min_periods, w, skip=1)
    return df.withColumn("z", ratio(x - rolling(F.avg, x, n, min_periods, w, skip=1), F.when(spread > 0, spread)))


def range_reliability(panel: DataFrame, least: float = 0.95) -> DataFrame:
    """Share of rows per entity whose prices are consistent, and whether range estimators may be used."""
    from panelforge.operators.quality import consistent

    return panel.groupBy("entity").agg(F.avg(consistent().cast("double")).alias("valid_rate")).withColumn("usable", c("valid_rate") >= least)


def signal_baseline(panel: DataFrame, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Per entity, over its last n returns: volatility, downside deviation and share, share of falling days; volatility's rank.

    Rows without a close don't count. A volatility needs min(10, n) returns; volatility_rank is the average
    rank of the first window's, as a share of the entities that have one.
    """
    rows = panel.where(c("close").isNotNull()).withColumn("_r", pct(c("close"), 1))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("trade_date")))).where(c("_k") <= max(windows))
    aggs = [F.max("trade_date").alias("trade_date")]
    for n in windows:
        x = F.when(c("_k") <= n, c("_r"))
        fall = F.least(x, F.lit(0.0))
        aggs += [
            F.when(F.count(x) >= max(2, min(10, n)), F.stddev_pop(x) * math.sqrt(n)).alias(f"vol_{n}"), F.sqrt(F.avg(F.when(x.isNotNull(), fall * fall))).alias(f"downside_{n}"),
            ratio(F.sqrt(F.avg(F.when(x.isNotNull(), fall * fall))), F.stddev_pop(x)).alias(f"downside_share_{n}"), F.avg((x < 0).cast("double")).alias(f"falling_share_{n}"),
        ]
    out = rows.groupBy("entity").agg(*aggs)
    first = c(f"vol_{windows[0]}")
    return out.withColumn("volatility_rank", average_rank(first) / F.count(first).over(Window.partitionBy()))


def usable_columns(features: DataFrame, suffixes: tuple[str, ...], least: int = 20) -> DataFrame:
    """(column, n) of the columns with one of the endings and at least so many values, in one aggregation."""
    names = [x for x in features.columns if x.endswith(suffixes)]
    counts = features.agg(*(F.count(x).alias(x) for x in names))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(x).alias("column"), c(x).alias("n")) for x in names))).alias("_x")).select("_x.*")
    return rows.where(c("n") >= least)


def outer_by_date(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Frames of one row a date side by side: every date of any of them, null where a frame lacks it."""
    for other in others:
        first = first.join(other, "trade_date", "full")
    return first
