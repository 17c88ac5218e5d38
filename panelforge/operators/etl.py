"""Ingestion, price re-basing and aggregation of members into indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.panel import in_time, pct, ratio, rolling, zscore

c = F.col


def reference_factors(factors: DataFrame, end: Column | None = None) -> DataFrame:
    """(entity, ref_factor): each entity's latest positive adjustment factor up to end."""
    ok = factors.where(c("adj_factor") > 0)
    if end is not None:
        ok = ok.where(c("trade_date") <= end)
    return ok.groupBy("entity").agg(F.max_by("adj_factor", "trade_date").alias("ref_factor"))


def missing_factors(selected: DataFrame, factors: DataFrame) -> DataFrame:
    """Selected entities without a usable factor."""
    return selected.select("entity").distinct().join(reference_factors(factors), "entity", "left_anti")


def adjust_prices(daily: DataFrame, factors: DataFrame, reference: DataFrame, basic: DataFrame | None = None) -> DataFrame:
    """Prices times factor over reference factor, high and low repaired to contain open and close.

    Rows without a factor or a reference drop out. A null price leaves high and low null: greatest and
    least would skip it.
    """
    known = F.coalesce(c("open").isNotNull() & c("high").isNotNull() & c("low").isNotNull() & c("close").isNotNull(), F.lit(False))
    fixed = daily.join(factors, ["entity", "trade_date"]).join(reference, "entity")
    if basic is not None:
        fixed = fixed.join(basic, ["entity", "trade_date"], "left")
    scale = ratio(c("adj_factor"), c("ref_factor"))
    high = F.when(known, F.greatest("open", "high", "low", "close"))
    low = F.when(known, F.least("open", "high", "low", "close"))
    more = [c(x) for x in (basic.columns if basic is not None else []) if x not in ("entity", "trade_date")]
    return fixed.select(
        "entity", "trade_date", (c("open") * scale).alias("open"), (high * scale).alias("high"), (low * scale).alias("low"),
        (c("close") * scale).alias("close"), "volume", "amount", F.coalesce((high != c("high")) | (low != c("low")), F.lit(False)).alias("repaired"), *more,
    )


def changed_factors(old: DataFrame, new: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Per entity: first date whose factor changed, factors there, number of changes, last date checked."""
    o, n = old.withColumnRenamed("adj_factor", "old"), new.withColumnRenamed("adj_factor", "new")
    both = o.join(n, ["entity", "trade_date"])
    changed = F.abs(c("new") - c("old")) > tolerance
    when = F.when(changed, c("trade_date"))
    out = both.groupBy("entity").agg(
        F.min(when).alias("first_changed"), F.min_by("old", when).alias("old_factor"), F.min_by("new", when).alias("new_factor"),
        F.count_if(changed).alias("n_changed"), F.max("trade_date").alias("last_checked"),
    )
    return out.where(c("n_changed") > 0)


def rebuild_plan(changed: DataFrame, local: DataFrame, buffer_days: int = 30) -> DataFrame:
    """From when each changed entity is rebuilt: the earlier of its first local row and the change less a buffer."""
    first = local.groupBy("entity").agg(F.min("trade_date").alias("_first"))
    return changed.join(first, "entity", "left").select("entity", F.least("_first", F.date_sub("first_changed", buffer_days)).alias("rebuild_from"))


def market_breadth(panel: DataFrame, limit: float = 0.098, full: int = 2500) -> DataFrame:
    """Per date: advancing and declining entities, limit moves, share above the mean, turnover z-score, level."""
    r = pct(c("close"), 1)
    rows = panel.select("trade_date", "entity", "amount", "close", r.alias("_r"), rolling(F.avg, c("close"), 20, 10).alias("_ma"))
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    day = rows.groupBy("trade_date").agg(
        n(c("_r") > 0).alias("up"), n(c("_r") < 0).alias("down"), n(c("_r") == 0).alias("unchanged"),
        n(c("_r") >= limit).alias("limit_up"), n(c("_r") <= -limit).alias("limit_down"),
        n(c("close") > c("_ma")).alias("_above"), F.count("_ma").alias("_ma_n"), F.count("_r").alias("valid"),
        F.count_distinct("entity").alias("entities"), F.sum("amount").alias("amount"),
    )
    level = F.when((c("entities") >= full) & (c("valid") >= 0.8 * c("entities")), "full").when(c("valid") >= 0.4 * c("entities"), "partial").otherwise("insufficient")
    return day.select(
        "trade_date", "up", "down", "unchanged", "limit_up", "limit_down", "entities",
        ratio(c("up").cast("double"), c("valid")).alias("up_ratio"), ratio(c("_above").cast("double"), c("_ma_n")).alias("above_ma20_ratio"),
        zscore(c("amount"), 20, 10, Window.orderBy("trade_date")).alias("amount_z"), level.alias("level"),
    )


def index_from_members(members: DataFrame, base: float = 1000.0) -> DataFrame:
    """Equal-weight index per sector of member bars (sector, entity, trade_date, open, high, low, close).

    A member's first row counts with a return of zero. Returns chain by summed logarithms.
    """
    w = in_time("sector", "entity")
    prev = F.lag("close").over(w)
    cols = {k: F.coalesce(ratio(c(k), prev) - 1, F.lit(0.0)) for k in ("open", "high", "low", "close")}
    day = members.select("sector", "trade_date", "volume", "amount", *(x.alias(k) for k, x in cols.items()))
    day = day.groupBy("sector", "trade_date").agg(*(F.avg(k).alias(f"_{k}") for k in cols), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("members"))
    t = in_time("sector")
    level = F.exp(F.sum(F.log(F.greatest(1 + c("_close"), F.lit(1e-6)))).over(t.rowsBetween(Window.unboundedPreceding, 0))) * base
    day = day.withColumn("close", level).withColumn("_prev", F.coalesce(F.lag("close").over(t), F.lit(base)))
    price = {k: c("_prev") * (1 + c(f"_{k}")) for k in ("open", "high", "low")}
    day = day.select("sector", "trade_date", "close", "volume", "amount", "members", *(x.alias(k) for k, x in price.items()))
    return day.withColumn("high", F.greatest("open", "high", "low", "close")).withColumn("low", F.least("open", "high", "low", "close"))


def basket_index(members: DataFrame, closes: DataFrame, policy: str = "fixed", base: float = 1000.0, low_coverage: float = 0.5) -> DataFrame:
    """Index of weighted members (entity, weight); policy for members without a return on a date:

    ``fixed`` counts them as zero at full weight, ``dynamic`` renormalises over those that have one.
    Negative weights count as zero; if all are zero the weights are equal. The first return is zero.
    """
    if policy not in ("fixed", "dynamic"):
        raise ValueError(f"unknown policy {policy}")
    m = members.select("entity", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    total = m.agg(F.sum("weight").alias("_sum"), F.count(F.lit(1)).alias("_n"))  # one row
    m = m.crossJoin(F.broadcast(total)).select("entity", F.when(c("_sum") > 0, c("weight")).otherwise(1.0).alias("weight"), F.when(c("_sum") > 0, c("_sum")).otherwise(c("_n").cast("double")).alias("_all"), "_n")
    r = closes.join(m, "entity").withColumn("_r", pct(c("close"), 1))
    day = r.groupBy("trade_date").agg(
        F.sum(c("_r") * c("weight")).alias("_wr"), F.sum(F.when(c("_r").isNotNull(), c("weight"))).alias("_w"), F.first("_all").alias("_all"),
        F.count("close").alias("n_members"), F.first("_n").alias("_n"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    )
    w = Window.orderBy("trade_date")
    ret = F.coalesce(ratio(c("_wr"), c("_all") if policy == "fixed" else c("_w")), F.lit(0.0))
    ret = F.when(F.row_number().over(w) == 1, 0.0).otherwise(ret)
    day = day.withColumn("ret", ret).withColumn("coverage", c("n_members") / c("_n"))
    close = base * F.product(1 + c("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return day.select("trade_date", "ret", close.alias("close"), "volume", "amount", "coverage", (c("coverage") < low_coverage).alias("low_coverage"))


def sector_like(basket: DataFrame, name: str) -> DataFrame:
    """A basket's closes as bars: open is the previous close, high and low span the two."""
    opened = F.coalesce(F.lag("close").over(Window.orderBy("trade_date")), c("close"))
    rows = basket.select(F.lit(name).alias("entity"), "trade_date", opened.alias("open"), "close", "volume", "amount", (c("ret") * 100).alias("pct_chg"))
    return rows.withColumn("high", F.greatest("open", "close")).withColumn("low", F.least("open", "close"))
