"""Logistic models of many groups (folds, horizons) in one job, fitted on training rows only.

Medians, means, deviations, date counts and class counts come from training rows by aggregation. A round sums gradients
and curvatures per group over the training rows, a narrow pass and an aggregation; the driver holds (columns + 1)^2
numbers a group and takes a Newton step, halved while it would raise the loss. It ends at the penalised optimum, so the
coefficients don't depend on step sizes or on the number of rounds. Rows that aren't for training are only scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.quantiles import quantiles
from panelforge.shared import materialize, release

c = F.col


def one_hot(rows: DataFrame, columns: list[str], least: int = 1) -> tuple[DataFrame, list[str]]:
    """rows with a 0/1 column for each value of columns that training rows have least times; and the columns' names.

    A value that isn't among them has zeros everywhere. Values are few by nature (labels, buckets); they are read to the driver.
    """
    names = []
    for x in columns:
        values = sorted(r[0] for r in rows.where("in_train").groupBy(c(x).cast("string").alias("v")).count().where(c("v").isNotNull() & (c("count") >= least)).collect())
        for v in values:
            names.append(f"{x}={v}")
            rows = rows.withColumn(f"{x}={v}", F.coalesce((c(x).cast("string") == v).cast("double"), F.lit(0.0)))
    return rows, names


def prepared(rows: DataFrame, features: list[str], by: list[str], date_weights: bool = True, balanced: bool = True, scale: bool = True) -> DataFrame:
    """rows with _x (features, imputed by the training median and standardised) and _w (weight in training, else null).

    rows have in_train and y (0, 1 or null); training rows without y have no weight. A date's training rows weigh one
    together, then each class half of all rows. A feature without training values is 0 everywhere.
    """
    train = rows.where("in_train and y is not null")
    known = lambda x: F.when(c(f"`{x}`").isNotNull() & ~F.isnan(c(f"`{x}`").cast("double")), c(f"`{x}`").cast("double"))
    plain = rows.select(*rows.columns, F.array(*(known(x) for x in features)).alias("_x"))
    if scale:
        named = [f"f{i}" for i in range(len(features))]
        flat = train.select(*by, *(known(x).alias(n) for x, n in zip(features, named)))
        medians = quantiles(flat, named, [0.5], by)
        fill = [F.coalesce(c(n)[0], F.lit(0.0)).alias(n) for n in named]
        middle = train.select(*by).distinct().join(medians, by, "left").select(*by, F.array(*fill).alias("median"))
        filled = plain.join(middle, by, "left").withColumn("_x", F.zip_with("_x", F.coalesce("median", F.array_repeat(F.lit(0.0), len(features))), lambda v, m: F.coalesce(v, m))).drop("median")
        at = filled.where("in_train and y is not null")
        moments = at.groupBy(*by).agg(F.array(*(F.struct(F.avg(c("_x")[i]).alias("m"), F.stddev_pop(c("_x")[i]).alias("s")) for i in range(len(features)))).alias("scale"))
        z = F.zip_with("_x", "scale", lambda v, s: (v - s["m"]) / F.when(s["s"] > 1e-12, s["s"]).otherwise(1.0))
        plain = filled.join(moments, by, "left").withColumn("_x", z).drop("scale")
    weight = F.lit(1.0)
    if date_weights:
        days = train.groupBy(*by, "trade_date").agg(F.count(F.lit(1)).alias("_n"))
        plain = plain.join(days, [*by, "trade_date"], "left")
        weight = weight / c("_n")
    if balanced:
        sizes = train.groupBy(*by).agg(F.struct(F.count_if(c("y") == 0).alias("n0"), F.count_if(c("y") == 1).alias("n1")).alias("_c"))
        plain = plain.join(sizes, by, "left")
        weight = weight * (c("_c.n0") + c("_c.n1")) / (2 * F.when(c("y") == 1, c("_c.n1")).otherwise(c("_c.n0")))
    return plain.withColumn("_w", F.when(c("in_train") & c("y").isNotNull(), weight)).drop("_n", "_c")


def fit(rows: DataFrame, d: int, by: list[str], l2: float = 1.0, least: int = 2, rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """(by..., status, n_positive, n_negative, rounds, intercept, coefficients) of prepared rows, a row for each group.

    Minimises sum of _w log-loss + l2 / 2 |coefficients|^2. status: fitted, max_rounds, or insufficient_positive_events,
    insufficient_negative_events (under least rows of a class in training; no coefficients then).
    """
    spark = rows.sparkSession
    counts = rows.groupBy(*by).agg(F.count_if(c("_w").isNotNull() & (c("y") == 1)).alias("n_positive"), F.count_if(c("_w").isNotNull() & (c("y") == 0)).alias("n_negative"))
    groups = materialize(counts.withColumn("model", F.row_number().over(Window.orderBy(*by)) - 1), "groups")  # a row a group
    table = groups.select("model", "n_positive", "n_negative").toPandas().sort_values("model")
    train = materialize(rows.where("_w is not null").join(groups.select(*by, "model"), by).select("model", c("y").cast("double").alias("y"), "_w", "_x"), "train")
    enough = (table["n_positive"].to_numpy() >= least) & (table["n_negative"].to_numpy() >= least)
    k, beta, step = d + 1, np.zeros((len(table), d + 1)), np.zeros((len(table), d + 1))
    loss, used, open_ = np.full(len(table), np.inf), np.zeros(len(table), int), enough.copy()
    ridge = np.diag([0.0] + [l2] * d)
    for _ in range(rounds):
        if not open_.any():
            break
        trial, live = beta + step, open_.copy()

        def run(batches: Iterator[pa.RecordBatch], trial: np.ndarray = trial, live: np.ndarray = live) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                model, y, w = (batch.column(i).to_numpy() for i in range(3))
                x = np.concatenate([np.ones((len(y), 1)), batch.column(3).flatten().to_numpy().reshape(len(y), -1)], 1) if len(y) else np.empty((0, k))
                for m in np.unique(model[live[model]]):
                    own = model == m
                    a, t, s = x[own], y[own], w[own]
                    eta = a @ trial[m]
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    parts = np.concatenate([[(s * (np.logaddexp(0, eta) - t * eta)).sum()], a.T @ (s * (p - t)), ((a * (s * p * (1 - p))[:, None]).T @ a).ravel()])
                    sums[m] = sums[m] + parts if m in sums else parts
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["model", "s"])

        parts = train.mapInArrow(run, "model int, s array<double>")
        got = parts.select("model", F.posexplode("s").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v")).toPandas()
        sums = np.zeros((len(table), 1 + k + k * k))
        sums[got["model"].to_numpy(), got["i"].to_numpy()] = got["v"].to_numpy()
        for m in np.flatnonzero(live):
            now = sums[m, 0] + 0.5 * l2 * (trial[m, 1:] ** 2).sum()
            used[m] += 1
            if now > loss[m] + 1e-12 * max(1.0, abs(loss[m])) and np.abs(step[m]).max() > 1e-12:
                step[m] /= 2
                continue
            beta[m], loss[m] = trial[m], now
            gradient = sums[m, 1 : 1 + k] + ridge @ beta[m]
            if np.abs(gradient).max() < tol * max(1.0, abs(now)):
                open_[m] = False
                continue
            step[m] = -np.linalg.lstsq(sums[m, 1 + k :].reshape(k, k) + ridge, gradient, rcond=1e-12)[0]
    status = np.where(table["n_positive"] < least, "insufficient_positive_events", np.where(table["n_negative"] < least, "insufficient_negative_events", np.where(open_, "max_rounds", "fitted")))
    found = [(int(m), str(status[m]), int(used[m]), float(beta[m, 0]) if enough[m] else None, beta[m, 1:].tolist() if enough[m] else None) for m in range(len(table))]
    models = spark.createDataFrame(found, "model int, status string, rounds int, intercept double, coefficients array<double>")
    out = materialize(groups.join(models, "model").select(*by, "status", "n_positive", "n_negative", "rounds", "intercept", "coefficients"), "logistic")
    release(groups, train)
    return out


def score(rows: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """prepared rows with p, the models' probability; null where the group has no model."""
    eta = c("intercept") + F.aggregate(F.zip_with("_x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(models.select(*by, "intercept", "coefficients"), by, "left").withColumn("p", 1 / (1 + F.exp(-eta))).drop("intercept", "coefficients")


def by_fold(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows for each fold of a plan (fold, trade_date, role) in which they are for training or validation, with in_train."""
    roles = plan.where("role in ('train', 'validation')").select("fold", "trade_date", (c("role") == "train").alias("in_train"))
    return rows.join(roles, "trade_date")


def hazard(rows: DataFrame, features: list[str], categories: list[str], plan: DataFrame, by: list[str], l2: float = 1.0, date_weights: bool = True, balanced: bool = True, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(models, scored): chance of an event per fold and by, from models that saw the fold's training dates only.

    rows: (trade_date, y, features, categories, by...). scored has the validation rows with y, p and hazard_status:
    raw_probability_only, excluded_censored (no y) or insufficient_sample.
    """
    keys = ["fold", *by]
    read = materialize(by_fold(rows, plan), "folds")  # what rows come from is read once
    folded, names = one_hot(read, categories)
    ready = materialize(prepared(folded, [*features, *names], keys, date_weights, balanced), "hazard")
    release(read)
    models = fit(ready, len(features) + len(names), keys, l2, least)
    scored = score(ready.where("not in_train"), models, keys)
    status = F.when(c("p").isNull(), "insufficient_sample").when(c("y").isNull(), "excluded_censored").otherwise("raw_probability_only")
    p = F.when(status == "raw_probability_only", c("p"))
    return models, scored.select(*rows.columns, "fold", p.alias("p"), status.alias("hazard_status"))
