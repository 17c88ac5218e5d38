"""Calibrators of raw scores: rates that back off to coarser groups, shrunken rates, and the choice of a method.

Groups are nested, so one rollup of the training rows holds the rates of all levels, and a row takes the finest level that
has support. Nothing that was decided after the training's end date reaches a rate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import logistic, models
from panelforge.panel import ratio

c = F.col


def _unit(x: Column) -> Column:
    """x within 0 to 1; null stays null (least and greatest pass over nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


def bucket(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first of the intervals (edge, next edge] that holds x, else null."""
    out = F.when(F.lit(False), "")
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((x > low) & (x <= high), label)
    return out


def known_by(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Rows (trade_date, horizon_end, exit_date, y) whose outcome was settled by the cutoff.

    Rows after it, rows whose horizon ends after it and rows with an exit after it go; a null cutoff leaves none.
    """
    late = (c("y") == 1) & c("exit_date").isNotNull() & (c("exit_date") > cutoff)
    return rows.where(F.coalesce((c("trade_date") <= cutoff) & (c("horizon_end") <= cutoff) & ~F.coalesce(late, F.lit(False)), F.lit(False)))


def rates(train: DataFrame, keys: list[str], levels: list[list[str]]) -> list[DataFrame]:
    """Per level (coarsest first; each adds columns to the one before): keys, its columns, n, rate and mean raw score.

    train has y (0 or 1) and raw; rows with either missing don't count. One rollup makes all levels.
    """
    steps, so_far = [], []
    for own in levels:
        new = [x for x in own if x not in so_far]
        steps.append(new)
        so_far += new
    packed = train.where("y is not null and raw is not null").select(*keys, *(F.struct(*s).alias(f"_l{i}") for i, s in enumerate(steps) if s), "y", "raw")
    names = [f"_l{i}" for i, s in enumerate(steps) if s]
    grouped = packed.rollup(*keys, *names).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.avg(c("y").cast("double")).alias("rate"), F.avg("raw").alias("mean_raw"))
    out, depth = [], 0
    for own, new in zip(levels, steps):
        depth += bool(new)
        mine = grouped.where(c("_g") == (1 << (len(names) - depth)) - 1)
        columns = [c(f"_l{j}.{x}").alias(x) for j, s in enumerate(steps) for x in s if x in own]
        out.append(mine.select(*keys, *columns, "n", "rate", "mean_raw"))
    return out


def backed_off(rows: DataFrame, train: DataFrame, keys: list[str], levels: list[list[str]], least: list[int]) -> DataFrame:
    """rows with calibrated, level and n_level: the rate of the finest level that has its least number of training rows.

    Without any the raw score stays; a null raw score stays null. levels and least go from coarse to fine.
    """
    tables = rates(train, keys, levels)
    out = rows
    for i, (own, table) in enumerate(zip(levels, tables)):
        held = table.where(c("n") >= least[i]).select(*(c(x).alias(f"_k_{x}") for x in [*keys, *own]), c("rate").alias(f"_r{i}"), c("n").alias(f"_n{i}"))
        cond = F.lit(True)
        for x in [*keys, *own]:
            cond = cond & c(x).eqNullSafe(c(f"_k_{x}"))
        out = out.join(held, cond, "left").drop(*(f"_k_{x}" for x in [*keys, *own]))
    order = list(range(len(levels)))[::-1]
    value = F.coalesce(*(c(f"_r{i}") for i in order), c("raw"))
    level = F.coalesce(*(F.when(c(f"_r{i}").isNotNull(), F.lit(len(levels) - 1 - i)) for i in order), F.lit(len(levels)))
    n = F.coalesce(*(c(f"_n{i}") for i in order), F.lit(0))
    has = c("raw").isNotNull()
    got = out.select(*rows.columns, F.when(has, _unit(value)).alias("calibrated"), F.when(has, level.cast("bigint")).alias("level"), F.when(has, n.cast("bigint")).alias("n_level"))
    return got


def exit_calibrator(rows: DataFrame, cutoff: Column, keys: list[str], levels: list[list[str]], least: int = 50) -> DataFrame:
    """rows with calibrated exit rates learnt from what was settled by the cutoff, and their status.

    Levels go from coarse (support of one row) over middle ones (half of least, five at least) to the finest (least). If
    nothing was settled, or the cutoff is null, no row is calibrated (status invalid).
    """
    train = known_by(rows, cutoff)
    support = [1, *[max(5, least // 2)] * (len(levels) - 2), least]
    got = backed_off(rows, train, keys, levels, support)
    any_ = train.where("y is not null and raw is not null").agg(F.count(F.lit(1)).alias("_train"))
    usable = c("_train") > 0
    value = F.when(usable, c("calibrated"))
    status = F.when(~usable, "invalid").when(value.isNotNull(), "usable_probability").otherwise("unavailable")
    return got.crossJoin(F.broadcast(any_)).select(*rows.columns, value.alias("calibrated"), F.when(usable, c("level")).alias("level"), F.when(usable, c("n_level")).alias("n_level"), status.alias("probability_status"))  # one row


def time_split(rows: DataFrame, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """rows with y and raw, with split: train, validation or test by shares of their distinct dates."""
    eligible = rows.where("y is not null and raw is not null")
    days = eligible.select("trade_date").distinct()
    w = Window.orderBy("trade_date")  # a row a date
    days = days.select("trade_date", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    first = F.greatest(F.lit(1), F.least(c("n"), F.floor(c("n") * shares[0])))
    second = F.greatest(first + 1, F.least(c("n"), F.floor(c("n") * F.lit(shares[0] + shares[1]))))
    return eligible.join(days.select("trade_date", F.when(c("i") <= first, "train").when(c("i") <= second, "validation").otherwise("test").alias("split")), "trade_date")


def shrunken(rows: DataFrame, train: DataFrame, keys: list[str], state: list[str], fine: list[str], alpha: float = 100.0, least: int = 1) -> DataFrame:
    """rows with calibrated: (n p_bucket + alpha p_state) / (n + alpha) where the bucket has least rows.

    Else the state's rate, else that of the keys, else the raw score.
    """
    coarse, middle, finest = rates(train, keys, [[], state, [*state, *fine]])
    out = rows
    for name, own, table in (("g", [], coarse), ("s", state, middle), ("b", [*state, *fine], finest.where(c("n") >= max(1, least)))):
        held = table.select(*(c(x).alias(f"_k_{x}") for x in [*keys, *own]), c("rate").alias(f"_r_{name}"), c("n").alias(f"_n_{name}"))
        cond = F.lit(True)
        for x in [*keys, *own]:
            cond = cond & c(x).eqNullSafe(c(f"_k_{x}"))
        out = out.join(held, cond, "left").drop(*(f"_k_{x}" for x in [*keys, *own]))
    base = F.coalesce("_r_s", "_r_g", "raw")
    value = F.coalesce((c("_n_b") * c("_r_b") + alpha * base) / (c("_n_b") + alpha), base)
    return out.select(*rows.columns, _unit(value).alias("calibrated"))


def platt(rows: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """rows (in_train, y, raw) with calibrated: a logistic curve of the raw score per group; null without enough of a class."""
    known = rows.where("raw is not null and not isnan(raw)")
    distinct = known.where("in_train and y is not null").groupBy(*by).agg(F.min("raw").alias("_a"), F.max("raw").alias("_b"))
    ready = logistic.prepared(known, ["raw"], by, date_weights=False, balanced=False, scale=False)
    fitted = logistic.fit(ready, 1, by, least=least).join(distinct.where("_a < _b").select(*by), by)
    return logistic.score(ready, fitted, by).withColumnRenamed("p", "calibrated").drop("_x", "_w")


def isotonic(rows: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """rows (in_train, y, raw) with calibrated by an isotonic curve per group, straight between its points, flat outside.

    Equal scores are pooled on Spark first. Null where a class has under least rows or all scores are equal.
    """
    key = F.to_json(F.struct(*by))
    known = rows.where("raw is not null and not isnan(raw)").withColumn("_key", key)
    pooled = known.where("in_train and y is not null").groupBy("_key", c("raw").alias("x")).agg(F.avg(c("y").cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    sizes = known.where("in_train and y is not null").groupBy("_key").agg(F.count_if(c("y") == 1).alias("p"), F.count_if(c("y") == 0).alias("n"), F.min("raw").alias("a"), F.max("raw").alias("b"))
    able = sizes.where((c("p") >= least) & (c("n") >= least) & (c("a") < c("b"))).select("_key")

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x = pdf["x"].to_numpy()
        tops = models.isotonic(x, pdf["y"].to_numpy(), pdf["w"].to_numpy())
        ends = np.searchsorted(x, [t for t, _ in tops])
        begins = np.concatenate([[0], ends[:-1] + 1])
        points = sorted({(float(x[i]), v) for a, b, (_, v) in zip(begins, ends, tops) for i in (a, b)})
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "points": [[{"x": a, "v": v} for a, v in points]]})

    curves = pooled.join(able, "_key").groupBy("_key").applyInPandas(curve, "_key string, points array<struct<x:double,v:double>>")
    at = known.join(curves, "_key", "left")
    low = F.try_element_at(F.filter("points", lambda p: p["x"] <= c("raw")), F.lit(-1))
    high = F.try_element_at(F.filter("points", lambda p: p["x"] >= c("raw")), F.lit(1))
    mid = at.withColumn("_low", low).withColumn("_high", high)
    line = c("_low.v") + F.coalesce(ratio((c("raw") - c("_low.x")) * (c("_high.v") - c("_low.v")), c("_high.x") - c("_low.x")), F.lit(0.0))
    value = F.when(c("_low").isNull(), c("_high.v")).when(c("_high").isNull(), c("_low.v")).otherwise(line)
    return mid.withColumn("calibrated", _unit(value)).drop("_key", "points", "_low", "_high")


def chosen(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., method, n, brier, rank): methods (column method) by the Brier score of calibrated on rows that weren't trained on."""
    scored = rows.where("not in_train and y is not null and calibrated is not null")
    e = (c("calibrated") - c("y")) * (c("calibrated") - c("y"))
    table = scored.groupBy(*by, "method").agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("brier"))
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("brier", "method")).cast("bigint"))
