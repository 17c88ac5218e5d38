"""Hazard models, calibrators and exit tendencies against small own versions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import calibration, logistic, targets, tendency


def day_(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def rows(spark):
    r, out = np.random.default_rng(4), []
    for i in range(900):
        g = "ab"[i % 2]
        x, y, z = r.normal(), r.exponential() * 50, r.integers(0, 3)
        p = 1 / (1 + np.exp(-(0.8 * x - 0.02 * y + (z == 1) - 0.3)))
        event = int(r.random() < p) if r.random() < 0.95 else None
        day = int(r.integers(0, 60))
        out.append((g, day_(day), float(x) if r.random() < 0.9 else None, float(y), "uvw"[z], event, day < 40))
    return spark.createDataFrame(out, "g string, trade_date date, x double, y_raw double, kind string, y int, in_train boolean").repartition(5)


def own_fit(train, features, l2):
    """The same optimum by a small dense Newton iteration."""
    a = train[features].to_numpy(float)
    a = np.where(np.isnan(a), np.nanmedian(a, 0), a)
    mean, std = a.mean(0), a.std(0)
    a = np.c_[np.ones(len(a)), (a - mean) / np.where(std > 0, std, 1)]
    y = train["y"].to_numpy(float)
    w = 1 / train.groupby("trade_date")["y"].transform("size").to_numpy()
    w = w * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    ridge, b = np.diag([0.0] + [l2] * len(features)), np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a.T * (w * p * (1 - p))) @ a + ridge, a.T @ (w * (p - y)) + ridge @ b)
    return b, mean, std


@pytest.mark.parametrize("l2", [1.0, 1e-4])
def test_coefficients_equal_a_small_solve(rows, l2):
    hot, names = logistic.one_hot(rows, ["kind"])
    features = ["x", "y_raw", *names]
    assert names == ["kind=u", "kind=v", "kind=w"]
    models = {r.g: r for r in logistic.fit(logistic.prepared(hot, features, ["g"]), len(features), ["g"], l2).collect()}
    own = hot.toPandas()
    for g in "ab":
        b, _, _ = own_fit(own[(own.g == g) & own.in_train & own.y.notna()], features, l2)
        assert models[g].status == "fitted"
        assert np.allclose([models[g].intercept, *models[g].coefficients], b, atol=1e-6)


def test_validation_rows_never_reach_the_fit(rows):
    """Models are the same when validation rows are changed beyond recognition."""
    wild = rows.withColumn("x", F.when(F.col("in_train"), F.col("x")).otherwise(1e6)).withColumn("y", F.when(F.col("in_train"), F.col("y")).otherwise(1))
    fits = [logistic.fit(logistic.prepared(r, ["x", "y_raw"], ["g"]), 2, ["g"]).orderBy("g").collect() for r in (rows, wild)]
    for a, b in zip(*fits):
        assert a.intercept == pytest.approx(b.intercept, abs=1e-9) and a.coefficients == pytest.approx(b.coefficients, abs=1e-9)


def test_rows_of_hazards_are_read_once(rows, spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = rows.drop("in_train")
    models, scored = logistic.hazard(plain.mapInArrow(count, plain.schema), ["x", "y_raw"], ["kind"], targets.fold_plan(plain, 2, 3, 3), ["g"])
    assert models.count() == 4 and scored.count() and seen.value == plain.count()


def test_statuses_and_scores(spark):
    data = [("ok", day_(i), float(i % 5), int(i % 5 > 2) if i % 7 else 1 - int(i % 5 > 2), i < 30) for i in range(40)]
    data += [("one", day_(i), float(i), 1, True) for i in range(5)] + [("none", day_(0), None, None, False), ("null", day_(0), None, 1, True), ("null", day_(1), None, 0, True), ("null", day_(1), None, 1, True), ("null", day_(2), None, 0, True)]
    df = spark.createDataFrame(data, "g string, trade_date date, x double, y int, in_train boolean")
    ready = logistic.prepared(df, ["x"], ["g"])
    models = logistic.fit(ready, 1, ["g"])
    got = {r.g: r for r in models.collect()}
    assert {g: r.status for g, r in got.items()} == {"ok": "fitted", "one": "insufficient_negative_events", "none": "insufficient_positive_events", "null": "fitted"}
    assert got["null"].coefficients == [0.0] and got["one"].coefficients is None
    scored = logistic.score(ready, models, ["g"]).where("not in_train").collect()
    assert all((r.p is None) == (r.g == "none") for r in scored) and len(scored) == 11
    assert logistic.fit(logistic.prepared(df.where("false"), ["x"], ["g"]), 1, ["g"]).count() == 0


def test_separable_data_has_an_optimum(spark):
    df = spark.createDataFrame([("g", day_(i), float(i), int(i >= 10), True) for i in range(20)], "g string, trade_date date, x double, y int, in_train boolean")
    got = logistic.fit(logistic.prepared(df, ["x"], ["g"]), 1, ["g"], l2=1e-4).first()
    b, _, _ = own_fit(df.toPandas(), ["x"], 1e-4)
    assert got.status == "fitted" and [got.intercept, *got.coefficients] == pytest.approx(b, rel=1e-4)


# calibration


def test_back_off_takes_the_finest_level_with_support(spark):
    train = [(5, "a", "early", 1)] * 6 + [(5, "a", "late", 0)] * 3 + [(5, "b", "early", 1)] * 2 + [(20, None, "early", 0)] * 4
    t = spark.createDataFrame([(h, x, p, y, 0.5) for h, x, p, y in train] + [(5, "a", "early", None, 0.1), (5, "a", "early", 0, None)], "horizon int, label string, phase string, y int, raw double")
    asked = [(5, "a", "early", 0.9), (5, "a", "late", 0.9), (5, "b", "early", 0.9), (5, "new", "x", 0.9), (20, None, "early", 0.9), (9, "a", "early", 1.2), (5, "a", "early", None)]
    df = spark.createDataFrame(asked, "horizon int, label string, phase string, raw double")
    got = {tuple(r)[:4]: (r.calibrated, r.level, r.n_level) for r in calibration.backed_off(df, t, ["horizon"], [[], ["label"], ["label", "phase"]], [1, 4, 5]).collect()}
    want = [(1.0, 0, 6), (6 / 9, 1, 9), (8 / 11, 2, 11), (8 / 11, 2, 11), (0.0, 1, 4), (1.0, 3, 0), (None, None, None)]
    assert [got[a] for a in asked] == [pytest.approx(w) if w[0] is not None else w for w in want]


def test_nothing_unsettled_is_learnt(spark):
    base = [("2024-01-01", "2024-01-06", None, 0), ("2024-01-01", "2024-01-06", "2024-01-03", 1), ("2024-01-09", "2024-01-14", None, 0), ("2024-01-04", "2024-01-10", None, 0), ("2024-01-02", "2024-01-07", "2024-01-09", 1)]
    df = spark.createDataFrame([(*r, 0.3, "a") for r in base], "trade_date string, horizon_end string, exit_date string, y int, raw double, label string")
    df = df.select(*(F.col(x).cast("date").alias(x) for x in ("trade_date", "horizon_end", "exit_date")), "y", "raw", "label", F.lit(5).alias("horizon"))
    day = F.lit("2024-01-08").cast("date")
    assert calibration.known_by(df, day).count() == 2
    got = calibration.exit_calibrator(df, day, ["horizon"], [[], ["label"]], least=1).collect()
    assert {r.calibrated for r in got} == {0.5} and {r.probability_status for r in got} == {"usable_probability"}
    closed = calibration.exit_calibrator(df, F.lit(None).cast("date"), ["horizon"], [[], ["label"]], least=1).collect()
    assert {(r.calibrated, r.level, r.probability_status) for r in closed} == {(None, None, "invalid")}


def test_shrinkage(spark):
    t = spark.createDataFrame([(5, "a", "1", 1, 0.2)] * 3 + [(5, "a", "2", 0, 0.2)] * 5, "horizon int, label string, age_bucket string, y int, raw double")
    df = spark.createDataFrame([(5, "a", "1", 0.2), (5, "a", "3", 0.2), (5, "b", "1", 0.2), (9, "a", "1", 0.2)], "horizon int, label string, age_bucket string, raw double")
    got = {tuple(r)[:3]: r.calibrated for r in calibration.shrunken(df, t, ["horizon"], ["label"], ["age_bucket"], alpha=10.0).collect()}
    assert got == {(5, "a", "1"): pytest.approx((3 + 10 * 3 / 8) / 13), (5, "a", "3"): pytest.approx(3 / 8), (5, "b", "1"): pytest.approx(3 / 8), (9, "a", "1"): 0.2}


def test_time_split(spark):
    df = spark.createDataFrame([(day_(i), 1 if i % 9 else None, 0.1) for i in range(21) for _ in range(2)], "trade_date date, y int, raw double")
    got = calibration.time_split(df).groupBy("split").agg(F.countDistinct("trade_date").alias("n"), F.min("trade_date").alias("a")).collect()
    assert {r.split: r.n for r in got} == {"train": 10, "validation": 4, "test": 4}
    one = calibration.time_split(df.limit(2).withColumn("y", F.lit(1))).collect()
    assert {r.split for r in one} == {"train"}


def test_platt_and_isotonic(spark):
    r = np.random.default_rng(8)
    data = [(g, float(s), int(r.random() < s**2), i < 200, day_(i)) for g in ("p", "q") for i, s in enumerate(r.random(260).round(2))]
    data += [("flat", 0.5, i % 2, True, day_(0)) for i in range(6)] + [("q", None, 1, True, day_(0)), ("q", 5.0, None, False, day_(0)), ("q", -5.0, None, False, day_(0))]
    df = spark.createDataFrame(data, "g string, raw double, y int, in_train boolean, trade_date date").repartition(4)
    curve = calibration.platt(df, ["g"]).toPandas()
    own = curve[(curve.g == "p") & curve.in_train]
    a, b = np.c_[np.ones(len(own)), own.raw], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag([0, 1.0]), a.T @ (p - own.y) + np.diag([0, 1.0]) @ b)
    assert np.allclose(own.calibrated, 1 / (1 + np.exp(-a @ b)), atol=1e-8) and curve[curve.g == "flat"].calibrated.isna().all()

    steps = calibration.isotonic(df, ["g"]).toPandas()
    for g in ("p", "q"):
        part = steps[steps.g == g]
        train = part[part.in_train].groupby("raw").y.agg(["mean", "size"]).sort_index()
        # the isotonic fit by its min-max formula
        x, y, w = train.index.to_numpy(), train["mean"].to_numpy(), train["size"].to_numpy()
        mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
        fit = [max(min(mean(i, j) for j in range(k, len(x))) for i in range(k + 1)) for k in range(len(x))]
        assert np.allclose(part.calibrated, np.interp(part.raw, x, fit)), g
    assert steps[steps.g == "flat"].calibrated.isna().all()


def test_choice_of_method(spark):
    df = spark.createDataFrame([("a", 1, False, 1.0), ("a", 0, False, 0.0), ("b", 1, False, 0.5), ("b", 0, True, 0.9), ("c", None, False, 0.5)], "method string, y int, in_train boolean, calibrated double").withColumn("h", F.lit(1))
    assert [(r.method, r.n, r.brier) for r in calibration.chosen(df, ["h"]).orderBy("rank").collect()] == [("a", 2, 0.0), ("b", 1, 0.25)]


# tendency


def test_age_percentiles_by_brute_force(spark):
    r = np.random.default_rng(6)
    stays = [("ab"[int(r.integers(0, 2))], int(r.choice([1, 2, 3, 5, 8, 64, 1000, 2_000_000])), day_(int(r.integers(0, 30)))) for _ in range(300)]
    rows = [("abc"[int(r.integers(0, 3))], day_(int(r.integers(-3, 33))), int(r.choice([0, 1, 2, 4, 7, 8, 63, 64, 1023, 3_000_000]))) for _ in range(400)] + [(None, day_(1), 3), ("a", day_(1), None)]
    got = tendency.age_percentiles(spark.createDataFrame(rows, "label string, trade_date date, age bigint"), spark.createDataFrame(stays, "label string, duration bigint, known_from date")).collect()
    found = {(x.label, x.trade_date, x.age): (x.percentile, x.n_stays or 0) for x in got}
    asked = {x for x in rows if None not in x}
    assert set(found) == asked
    for label, day, age in asked:
        known = [d for n, d, f in stays if n == label and f <= day]
        want = sum(d <= age for d in known) / len(known) if known else None
        assert found[label, day, age] == ((pytest.approx(want), len(known)) if known else (None, 0)), (label, day, age)


def test_no_row_meets_the_stays(spark):
    rows = spark.createDataFrame([("a", day_(0), 1)], "label string, trade_date date, age bigint")
    stays = spark.createDataFrame([("a", 2, day_(0))], "label string, duration bigint, known_from date")
    assert "Join" not in tendency.age_percentiles(rows, stays)._jdf.queryExecution().toString()


def test_ended_stays_and_ages(spark):
    s = spark.createDataFrame([("e", day_(i), x) for i, x in enumerate("aabbbc")], "entity string, trade_date date, label string")
    assert sorted(tuple(r) for r in tendency.ended_stays(s).collect()) == [("a", 2, day_(2)), ("b", 3, day_(5))]
    assert [r.age for r in tendency.aged(s).orderBy("trade_date").collect()] == [1, 2, 1, 2, 3, 1]


def test_tendency_groups(spark):
    data = [("a", 1, float(i)) for i in range(11)] + [("b", 1, 0.5)] * 5 + [("c", 1, 0.1), ("c", 1, 0.9), ("a", 1, None)]
    got = tendency.relative_tendency(spark.createDataFrame(data, "label string, horizon int, score double"), ["label", "horizon"]).toPandas()
    a = got[(got.label == "a") & got.score.notna()].sort_values("score")
    assert a.exit_tendency.tolist() == ["low"] * 4 + ["medium"] * 3 + ["high"] * 4
    assert set(got[got.label.isin(["b", "c"])].exit_tendency) == {"medium"} and got[got.score.isna()].exit_tendency.tolist() == ["unavailable"]
    shares = tendency.tendency_shares(spark.createDataFrame(pd.DataFrame({"label": ["a"] * 4, "horizon": [1] * 4, "exit_tendency": ["low", "low", "high", "medium"]}))).collect()
    assert {r.exit_tendency: r.share for r in shares} == {"low": 0.5, "high": 0.25, "medium": 0.25}
