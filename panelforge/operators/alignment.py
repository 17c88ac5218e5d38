"""Alignment of two models' states: signature distances, the cheapest assignment, and how far labels have drifted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.decisions import Rules, first_match

c = F.col
DRIFT: Rules = [
    ("distance is null", {"severity": "unknown"}),
    ("ambiguous", {"severity": "medium"}),
    ("not label_kept and distance <= 0.35", {"severity": "high"}),
    ("not label_kept", {"severity": "medium"}),
    ("distance <= 0.05", {"severity": "none"}),
    ("distance <= 0.20", {"severity": "low"}),
    ("distance <= 0.50", {"severity": "medium"}),
    ("true", {"severity": "high"}),
]


def distances(base: DataFrame, other: DataFrame, fields: list[str], logged: list[str]) -> DataFrame:
    """(pair, base_state, base_label, state, label, distance) of all states of two models of one pair.

    base and other: (pair, state, label, fields...). distance is the root mean square, over the fields that both have, of
    the difference relative to the larger absolute value (1 at least); logged fields are compared by log(1 + x). Null
    if no field is common. A pair has a handful of states on either side.
    """
    value = lambda df, x: F.when(df[x].isNotNull(), F.log1p(F.greatest(df[x], F.lit(0.0)))) if x in logged else df[x]
    a = base.select("pair", c("state").alias("base_state"), c("label").alias("base_label"), F.array(*(value(base, x).cast("double") for x in fields)).alias("_a"))
    b = other.select("pair", "state", "label", F.array(*(value(other, x).cast("double") for x in fields)).alias("_b"))
    both = a.join(b, "pair")
    part = F.zip_with("_a", "_b", lambda x, y: (x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)))
    known = F.filter(part, lambda v: v.isNotNull() & ~F.isnan(v))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, v: s + v * v), F.size(known))
    return both.select("pair", "base_state", "base_label", "state", "label", F.sqrt(mean).alias("distance"))


def assignment(costs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of the cheapest assignment of all rows or all columns, whichever are fewer.

    Rows are added one by one along cheapest augmenting paths under potentials, in time rows^2 x columns.
    """
    if costs.shape[0] > costs.shape[1]:
        return sorted((r, k) for k, r in assignment(costs.T))
    n, m = costs.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        slack, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column = row, -1
        while at >= 0:  # until a free column is reached
            reduced = costs[at] - row_price[at] - col_price
            better = ~done & (reduced < slack)
            slack[better], came[better] = reduced[better], column
            column = int(np.where(done, np.inf, slack).argmin())
            by = slack[column]
            row_price[row] += by
            row_price[owner[done]] += by
            col_price[done] -= by
            slack[~done] -= by
            done[column] = True
            at = owner[column]
        while column >= 0:  # hand the columns on along the path
            before = came[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    return sorted((int(r), k) for k, r in enumerate(owner) if r >= 0)


def align(distance: DataFrame, gap: float = 0.05) -> DataFrame:
    """(pair, base_state, base_label, state, label, distance, score, label_kept, ambiguous, severity, method).

    The states of each pair of models are matched at least total distance (a null distance is as far as can be). A
    match is ambiguous if another state is at most gap farther from the base state.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="base_state", columns="state", values="distance")
        costs = table.to_numpy(dtype=float)
        far = 1e6 * (1 + np.nan_to_num(costs, nan=0.0).max())
        found = assignment(np.where(np.isnan(costs), far, costs))
        return pd.DataFrame({"pair": pdf["pair"].iloc[0], "base_state": [table.index[i] for i, _ in found], "state": [table.columns[j] for _, j in found], "method": "assignment" if min(costs.shape) > 1 else "not_enough_states"})

    found = distance.groupBy("pair").applyInPandas(match, "pair string, base_state string, state string, method string")
    order = Window.partitionBy("pair", "base_state").orderBy(c("distance").asc_nulls_last(), "state")
    second = F.max(F.when(c("_k") == 2, c("distance"))).over(Window.partitionBy("pair", "base_state"))
    ranked = distance.withColumn("_k", F.row_number().over(order)).withColumn("_second", second)
    got = found.join(ranked, ["pair", "base_state", "state"])
    got = got.withColumn("label_kept", c("base_label").eqNullSafe(c("label"))).withColumn("ambiguous", F.coalesce(c("_second") - c("distance") <= gap, F.lit(False)))
    return got.select("pair", "base_state", "base_label", "state", "label", "distance", (1 / (1 + c("distance"))).alias("score"), "label_kept", "ambiguous", first_match(DRIFT, "severity").alias("severity"), "method")


def drift_summary(aligned: DataFrame) -> DataFrame:
    """Per pair: matches, labels kept, ambiguous ones, mean distance, and the worst severity."""
    rank = F.create_map(*(F.lit(x) for kv in {"none": 0, "low": 1, "medium": 2, "high": 3, "unknown": 4}.items() for x in kv))
    return aligned.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("label_kept").alias("n_kept"), F.count_if("ambiguous").alias("n_ambiguous"), F.avg("distance").alias("mean_distance"), F.max_by("severity", rank[c("severity")]).alias("worst"),
    )
