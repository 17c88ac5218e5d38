"""State models per entity: training statistics on Spark, recursions in grouped pandas.

Recursions run one entity to a group (an entity's history is a few thousand rows); parameters are small
arrays passed with the function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import state_models
from panelforge.operators.quantiles import quantiles
from panelforge.panel import ratio
from panelforge.shared import release

c = F.col


def preprocessing(train: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(column, low, high, mean, std): clip bounds and, after clipping, the standardisation."""
    q = quantiles(train, columns, [low, high]).first() or dict.fromkeys(columns)
    clip = {x: F.greatest(F.least(c(x), F.lit(q[x][1])), F.lit(q[x][0])) if q[x] else c(x) for x in columns}
    stats = train.select(*(F.when(c(x).isNotNull(), clip[x]).alias(x) for x in columns))
    rows = stats.agg(*(F.struct(F.lit(x).alias("column"), F.lit(q[x][0] if q[x] else None).cast("double").alias("low"), F.lit(q[x][1] if q[x] else None).cast("double").alias("high"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).alias(x) for x in columns))
    return rows.select(F.inline(F.array(*columns)))


def standardise(df: DataFrame, params: DataFrame) -> DataFrame:
    """Columns clipped and standardised by preprocessing's rows (one per column, read to the driver)."""
    for p in params.collect():
        x = F.greatest(F.least(c(p["column"]), F.lit(p["high"])), F.lit(p["low"]))
        df = df.withColumn(p["column"], F.when(c(p["column"]).isNotNull(), ratio(x - p["mean"], F.lit(p["std"]))))
    return df


@dataclass
class GaussianStates:
    """Hidden states with diagonal Gaussian emissions."""

    start: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.mean
        return -0.5 * (np.log(2 * np.pi * self.var) + d**2 / self.var).sum(2)

    def filter(self, x: np.ndarray) -> np.ndarray:
        """Probability of each state given what was seen so far."""
        dens, out, p = self.log_density(x), np.empty((len(x), len(self.start))), self.start
        for t, row in enumerate(dens):
            p = (p if t == 0 else p @ self.transition) * np.exp(row - row.max())
            p = p / p.sum()
            out[t] = p
        return out


def fit_states(panel: DataFrame, columns: list[str], n_states: int, rounds: int = 300, floor: float = 1e-4, tol: float = 1e-2, starts: int = 3) -> tuple[GaussianStates, list[float]]:
    """The best of several starts of expectation-maximisation over all entities, and its log likelihood per round.

    A start ends when a round raises its log likelihood by less than tol; rounds is only a ceiling. Sequences are
    written once and all starts are trained side by side (state_models). Rows with a null are left out.
    """
    seqs = state_models.sequences(panel.withColumn("window", F.lit(0)), columns)
    got = state_models.fit(seqs, len(columns), state_models.Config(n_states=n_states, starts=starts, rounds=rounds, floor=floor, tol=tol))
    release(seqs)
    if not len(got.window):
        raise ValueError("no row without nulls to train on")
    return GaussianStates(got.start[0], got.move[0], got.mean[0], got.var[0]), got.trace[0]


def filtered_states(panel: DataFrame, columns: list[str], model: GaussianStates) -> DataFrame:
    """(entity, trade_date, state, p array): causal state probabilities per entity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date")
        p = model.filter(pdf[columns].to_numpy())
        return pd.DataFrame({"entity": pdf["entity"], "trade_date": pdf["trade_date"], "state": p.argmax(1), "p": list(p)})

    rows = panel.where(" and ".join(f"{x} is not null" for x in columns)).select("entity", "trade_date", *columns)
    return rows.groupBy("entity").applyInPandas(run, "entity string, trade_date date, state int, p array<double>")


def segment_viterbi(dens: np.ndarray, start: np.ndarray, transition: np.ndarray, duration: np.ndarray) -> np.ndarray:
    """Most likely states when stays have their own duration distribution (rows of duration: 1..D).

    Log inputs; the last stay may be cut off. Works on all states and durations of a step at once.
    """
    n, k = dens.shape
    d = duration.shape[1]
    total = np.vstack([np.zeros(k), np.cumsum(dens, 0)])
    tail = np.logaddexp.accumulate(duration[:, ::-1], axis=1)[:, ::-1]  # stays of at least so long
    best = np.full((n + 1, k), -np.inf)
    back = np.zeros((n + 1, k, 2), np.int64)
    enter = np.full((n + 1, k), -np.inf)  # best score of starting a stay at t
    source = np.zeros((n + 1, k), np.int64)
    enter[0] = start
    for t in range(1, n + 1):
        m = min(d, t)
        lens = np.arange(1, m + 1)
        dur = (tail if t == n else duration)[:, :m]
        score = enter[t - lens].T + dur + (total[t] - total[t - lens]).T
        at = score.argmax(1)
        best[t] = score[np.arange(k), at]
        back[t, :, 0] = lens[at]
        step = best[t][:, None] + transition
        source[t] = step.argmax(0)
        enter[t] = step.max(0)
    out, t, s = np.empty(n, np.int64), n, int(best[n].argmax())
    while t > 0:
        length = int(back[t, s, 0])
        out[t - length : t] = s
        t -= length
        s = int(source[t, s]) if t else s
    return out


def exit_probability(pmf: np.ndarray, age: int, horizon: int) -> float | None:
    """Chance that a stay of this age ends within horizon rows; None from the last duration on."""
    tail = pmf[age:].sum() if age < len(pmf) else 0.0
    return float(pmf[age : age + horizon].sum() / tail) if tail > 0 else None


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> list[tuple[float, float]]:
    """Pool adjacent violators: (largest x, value) of each block, a step function."""
    order = np.argsort(x, kind="mergesort")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([float(x[i]), float(y[i]), 1.0 if w is None else float(w[i])])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b, a = blocks.pop(), blocks.pop()
            n = a[2] + b[2]
            blocks.append([b[0], (a[1] * a[2] + b[1] * b[2]) / n, n])
    return [(b[0], b[1]) for b in blocks]


def isotonic_by(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x_max, value): an isotonic step function per key; equal x are pooled first, on Spark."""
    pooled = df.where(c(x).isNotNull() & c(y).isNotNull()).groupBy(key, c(x).cast("double").alias("x")).agg(F.avg(c(y).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = isotonic(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "x_max": [a for a, _ in got], "value": [b for _, b in got]})

    return pooled.groupBy(key).applyInPandas(run, f"{key} string, x_max double, value double")
