"""Closed-form cases and edges of the panel operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars
from panelforge.operators import backtest, etl, evaluation, features, models, quality, ranking, segments, targets
from panelforge.panel import average_rank, bars, islands, pct
from panelforge.sources import store


def panel(spark, rows):
    return spark.createDataFrame(rows, "entity string, trade_date date, open double, high double, low double, close double, volume double, amount double")


def test_features_closed_form(spark, day):
    """A saw-tooth: two steps of 3 % up, one of 4 % down, amounts that alternate."""
    steps = [0.03, 0.03, -0.04]
    closes = np.cumprod([50.0] + [1 + steps[i % 3] for i in range(32)]).tolist()
    rows = [("saw", day(i), x * 0.99, x * 1.02, x * 0.97, x, 1.0, 700.0 if i % 2 else 900.0) for i, x in enumerate(closes)]
    got = features.sector_features(panel(spark, rows)).toPandas().sort_values("trade_date").iloc[-1]
    assert got.ret_5d == pytest.approx(closes[-1] / closes[-6] - 1) and got.ret_20d == pytest.approx(closes[-1] / closes[-21] - 1)
    last = [steps[i % 3] for i in range(12, 32)]
    assert got.vol_20d == pytest.approx(np.std(last) * math.sqrt(20)) and got.amount_z == pytest.approx(1.0)
    assert got.drawdown == pytest.approx(closes[-1] / max(closes[-20:]) - 1) and got.gap_1d == pytest.approx(0.99 * closes[-1] / closes[-2] - 1) and got.intraday == pytest.approx(1 / 0.99 - 1)


def test_benchmark_is_scale_free(spark, day):
    """Entities with different returns: a level doesn't count, and the benchmark lies between them."""
    up = [("up", day(i), *[80.0 * 1.02**i] * 4, 1.0, 1.0) for i in range(33)]
    down = [("down", day(i), *[3.0 * 0.99**i] * 4, 1.0, 1.0) for i in range(33)]
    scaled = [(e, d, *(1000 * x for x in r[:4]), *r[4:]) for e, d, *r in down]
    one, two = (features.equal_weight_benchmark(panel(spark, up + x)).toPandas().sort_values("trade_date").benchmark_ret for x in (down, scaled))
    assert np.allclose(one.dropna(), two.dropna()) and one.isna().sum() == 20 and np.allclose(one.dropna(), 1.005**20 - 1)


def test_empty_and_null_panels(spark, day):
    empty = panel(spark, [])
    assert features.sector_features(empty).count() == features.limit_flags(empty).count() == segments.state_segments(empty.withColumn("label", F.lit("x"))).count() == 0
    nulls = panel(spark, [("a", day(i), None, None, None, None, None, None) for i in range(3)])
    assert features.sector_features(nulls).where("ret_1d is not null").count() == 0
    assert {r.rule: r.n for r in quality.violations(nulls).collect()}["missing_price"] == 3


def test_zero_prices_give_null_not_an_error(spark, day):
    p = panel(spark, [("a", day(i), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(30)])
    assert features.price_baselines(p).where("parkinson is not null").count() == 0


def test_islands_and_average_rank(spark, day):
    s = spark.createDataFrame([("a", day(i), x) for i, x in enumerate(["A", "A", "B", "B", "B", "A", None, None])], "entity string, trade_date date, label string")
    assert [r.segment for r in islands(s, "label").orderBy("trade_date").collect()] == [1, 1, 2, 2, 2, 3, 4, 4]
    r = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double").select("x", average_rank(F.col("x")).alias("r"))
    assert sorted((x.x or 0, x.r or 0) for x in r.collect()) == [(0, 0), (1.0, 1.0), (2.0, 2.5), (2.0, 2.5)]


def test_dwell_example(spark, day):
    s = spark.createDataFrame([("a", day(i), x, 1.0) for i, x in enumerate("AABBBA")], "entity string, trade_date date, label string, close double")
    got = segments.churn(segments.state_segments(s)).first()
    assert got.dwell_mean == 2 and got.transition_rate == pytest.approx(0.4) and got.single_day_share == pytest.approx(1 / 3) and got.bucket == "excessive"


def test_forward_returns(spark, day):
    """Bought at the next open, sold at the close so many rows on."""
    opens, closes = [20.0, 19.5, 24.0, 21.0, 18.0, 30.0, 33.0], [19.0, 22.0, 23.5, 17.5, 28.0, 31.0, 16.0]
    p = panel(spark, [("q", day(2 * i), o, 0.0, 0.0, x, 1.0, 1.0) for i, (o, x) in enumerate(zip(opens, closes))])
    rows = targets.tradable_forward_returns(p, [2, 4]).orderBy("trade_date").collect()
    assert [r.fwd_2 for r in rows[:5]] == [pytest.approx(closes[i + 2] / opens[i + 1] - 1) for i in range(5)] and [r.fwd_4 for r in rows[:3]] == [pytest.approx(closes[i + 4] / opens[i + 1] - 1) for i in range(3)]
    assert rows[5].fwd_2 is None and rows[3].fwd_4 is None and rows[0].exec_date == day(2)


def test_path_metrics(spark, day):
    p = panel(spark, [("a", day(i), 0.0, 0.0, 0.0, float(x), 1.0, 1.0) for i, x in enumerate([100, 110, 90, 95])])
    got = targets.path_metrics(p, 3).orderBy("trade_date").first()
    assert got.future_return == pytest.approx(-0.05) and got.future_mae == pytest.approx(-0.1) and got.future_mdd == pytest.approx(1 - 90 / 110) and got.downside_vol == pytest.approx(0)


def test_fold_plan_purges_and_embargoes(spark, day):
    d = spark.createDataFrame([(day(i),) for i in range(50)], "trade_date date")
    got = targets.fold_plan(d, 4, 3, 5).toPandas()
    one = got[got.fold == 1].groupby("role").size().to_dict()
    assert one == {"train": 7, "purged": 3, "validation": 10, "embargo": 5}


def test_basket_policies(spark, day):
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "entity string, weight double")
    p = panel(spark, [("a", day(0), *[10.0] * 4, 1.0, 1.0), ("b", day(0), *[10.0] * 4, 1.0, 1.0), ("a", day(1), *[11.0] * 4, 1.0, 1.0)])
    fixed, dynamic = (etl.basket_index(w, p, k).orderBy("trade_date").collect()[1] for k in ("fixed", "dynamic"))
    assert fixed.ret == pytest.approx(0.025) and dynamic.ret == pytest.approx(0.1) and fixed.coverage == 0.5


def test_adjustment_keeps_null_high(spark, day):
    d = spark.createDataFrame([("a", day(0), 10.0, 9.0, 8.0, None, 1.0, 1.0)], "entity string, trade_date date, open double, high double, low double, close double, volume double, amount double")
    f = spark.createDataFrame([("a", day(0), 2.0)], "entity string, trade_date date, adj_factor double")
    got = etl.adjust_prices(d, f, etl.reference_factors(f)).first()
    assert got.high is None and got.close is None and got.open == 10.0
    assert etl.missing_factors(d.union(d.withColumn("entity", F.lit("z"))), f).collect()[0].entity == "z"


def test_upsert_and_table(spark, day, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    assert sorted((r.k or 0, r.v) for r in store.upsert(old, new, ["k"]).collect()) == [(0, "N"), (1, "a"), (2, "B"), (3, "C")]
    with pytest.raises(ValueError):
        store.upsert(old, new, ["missing"])
    t = store.Table(spark, f"file://{tmp_path}/t", ["k"])
    assert t.read() is None
    t.upsert(old)
    t.upsert(new)
    assert t.read().count() == 4 and t.delete(F.col("k") == 3) == (4, 3)


def test_normalised_bars(spark):
    raw = spark.createDataFrame([("000001.SZ", "20240102", "10", "x", None), ("1", "20240102", "9", "8", "7"), ("bad", "20240102", "1", "1", "1")], "ts_code string, trade_date string, open string, close string, vol string")
    got = store.normalise_bars(raw, {"ts_code": "code", "vol": "volume"}).collect()
    assert len(got) == 1 and got[0].entity == "000001" and got[0].exchange == "SZ" and got[0].open == 10.0 and got[0].close is None


def test_scalars(spark):
    df = spark.createDataFrame([("920001",), ("900001",), ("600000",), ("000001",), ("430001",), (None,)], "code string")
    assert [r[0] for r in df.select(scalars.exchange_of(scalars.normal_code(F.col("code")))).collect()] == ["BJ", "SH", "SH", "SZ", "BJ", None]
    a, b = (scalars.row_digest(d, ["code"]).first().digest for d in (df, df.orderBy(F.desc("code"))))
    assert a == b != scalars.row_digest(df.limit(2), ["code"]).first().digest


def test_backtest_costs_and_drift(spark, day):
    closes = {"a": [100, 110, 121], "b": [100, 100, 100]}
    p = panel(spark, [(e, day(i), *[float(x)] * 4, 1.0, 1.0) for e, xs in closes.items() for i, x in enumerate(xs)])
    ev = spark.createDataFrame([(day(0), "a", 1.0), (day(1), "b", 1.0)], "exec_date date, entity string, weight double")
    got = {r.trade_date: r for r in backtest.simulate(p, ev, 0.01).collect()}
    assert got[day(0)].net == pytest.approx(-0.01) and got[day(1)].gross == pytest.approx(0.1) and got[day(1)].turnover == 2.0 and got[day(2)].gross == pytest.approx(0.0)


def test_auc_and_concentration(spark):
    df = spark.createDataFrame([("k", s, y) for s, y in [(0.1, False), (0.4, False), (0.35, True), (0.8, True)]], "key string, s double, y boolean")
    assert evaluation.auc(df, "s", "y", "key").first().auc == pytest.approx(0.75)
    e = spark.createDataFrame([("a",), ("a",), ("b",)], "entity string")
    assert evaluation.concentration(e, "entity").first().hhi == pytest.approx(5 / 9)


def test_segment_viterbi_finds_durations():
    rng = np.random.default_rng(0)
    truth = np.repeat([0, 1, 0, 1], [8, 4, 8, 4])
    x = np.where(truth == 0, 0.0, 3.0) + rng.normal(0, 0.15, len(truth))
    dens = np.stack([-((x - m) ** 2) for m in (0.0, 3.0)], 1)
    dur = np.log(np.full((2, 12), 1 / 12))
    with np.errstate(divide="ignore"):
        got = models.segment_viterbi(dens, np.log([0.5, 0.5]), np.log([[0.0, 1.0], [1.0, 0.0]]), dur)
    assert (got == truth).all()
    assert models.exit_probability(np.array([0.5, 0.5]), 0, 1) == 0.5 and models.exit_probability(np.array([0.5, 0.5]), 2, 1) is None


def test_likelihood_rises(spark, day):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.3, 40) for m in (0, 3, 0)])
    df = spark.createDataFrame(pd.DataFrame({"entity": "a", "trade_date": [day(i) for i in range(120)], "x": x}), "entity string, trade_date date, x double")
    model, trace = models.fit_states(df, ["x"], 2, rounds=5)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    p = np.array(models.filtered_states(df, ["x"], model).orderBy("trade_date").toPandas()["p"].tolist())
    assert np.allclose(p.sum(1), 1)


def test_fit_ends_by_tolerance(spark, day):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.6, 40) for m in (0, 2, 0)])
    df = spark.createDataFrame(pd.DataFrame({"entity": "a", "trade_date": [day(i) for i in range(120)], "x": x}), "entity string, trade_date date, x double")
    _, trace = models.fit_states(df, ["x"], 2)
    gains = np.diff(trace)
    assert 1 < len(trace) < 300 and gains[-1] < 1e-2 and all(gains[:-1] >= 1e-2)


def test_isotonic_is_monotone():
    got = models.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert [v for _, v in got] == [0.0, 0.5, 1.0]


def test_streaming_bars_equal_batch(spark, sf_dir, tmp_path):
    from panelforge.streaming import streams

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streams.window_bars(streams.read_events(spark, f"{tmp_path}/in", batch.schema, 1), "1 day", "60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_t").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select entity, cast(start as date) d, volume, round(amount, 4) a from bars_t").toPandas()
    want = batch.groupBy(F.col("event_type").alias("entity"), F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("volume"), F.round(F.sum("value"), 4).alias("a")).toPandas()
    key = ["entity", "d"]
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))


def test_bars_and_ranking(spark, day):
    t = spark.createDataFrame([("a", day(0), 1, 5.0, 1.0), ("a", day(0), 2, 7.0, 2.0), ("a", day(1), 3, 6.0, 1.0)], "e string, d date, i int, p double, q double")
    got = bars(t, "e", "d", "p", "q", ["i"]).orderBy("trade_date").first()
    assert (got.open, got.close, got.high, got.low, got.volume) == (5.0, 7.0, 7.0, 5.0, 3.0)
    assert ranking.latest(t.select("e", "d", "p"), "e", "d").first().p == 6.0
    assert t.select(pct(F.col("p"), 1, __import__("pyspark").sql.Window.orderBy("i")).alias("r")).count() == 3


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, w double")
    part = store.upsert(old, spark.createDataFrame([(2, 9.0), (3, 3.0), (3, 4.0)], "k int, w double"), ["k"])
    assert part.columns == ["k", "v", "w"] and sorted(map(tuple, part.collect())) == [(1, "a", 1.0), (2, "b", 9.0), (3, None, 4.0)]
    keys = store.upsert(old, spark.createDataFrame([(2,), (4,)], "k int"), ["k"])
    assert sorted(map(tuple, keys.collect())) == [(1, "a", 1.0), (2, "b", 2.0), (4, None, None)]
    assert sorted(map(tuple, store.upsert(old, old.limit(0), ["k"]).collect())) == [(1, "a", 1.0), (2, "b", 2.0)]


def test_path_needs_positive_prices(spark, day):
    closes = [5.0, 6.0, 4.0, 0.0, 5.0, 7.0, float("nan"), 3.0]
    df = spark.createDataFrame([("a", day(i), x) for i, x in enumerate(closes)], "entity string, trade_date date, close double")
    got = [r.future_mae for r in targets.path_metrics(df, 2).orderBy("trade_date").collect()]
    assert [x is None for x in got] == [False, *[True] * 7] and abs(got[0] - (4 / 5 - 1)) < 1e-12


def test_streamed_states_and_upserts(spark, sf_dir, tmp_path):
    from panelforge.streaming import streams

    batch = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    batch.repartition(2).write.parquet(f"{tmp_path}/in")
    events = streams.read_events(spark, f"{tmp_path}/in", batch.schema, 1)
    table = store.Table(spark, f"{tmp_path}/table", ["event_id"])
    q = streams.upsert_sink(events.select("event_id", "value"), table, f"{tmp_path}/cp1")
    q.processAllAvailable()
    q.stop()
    assert table.read().count() == batch.select("event_id").distinct().count()
    model = models.GaussianStates(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.0], [50.0]]), np.array([[100.0], [100.0]]))
    q = streams.filtered_stream(events, "value", model).writeStream.outputMode("append").format("memory").queryName("states_t").option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*), min(state), max(state) from states_t").first()[0] == batch.count()


def test_exit_dataset_by_hand(spark, day):
    labels = ["a", None, "a", "b", "b"]
    s = spark.createDataFrame([("x", day(i), v) for i, v in enumerate(labels)], "entity string, trade_date date, label string")
    got = {r.trade_date: r for r in segments.exit_dataset(s, [2]).collect()}
    assert [got[day(i)].status for i in range(5)] == ["negative", "missing_state", "positive", "censored_by_run_end", "censored_by_run_end"]
    assert got[day(0)].exit_date == day(3) and got[day(0)].next_label == "b" and got[day(1)].next_label is None and got[day(1)].observed_until == day(1)
    cut = {r.trade_date: r.status for r in segments.exit_dataset(s, [2], str(day(2))).collect()}
    assert [cut[day(i)] for i in (0, 2, 3)] == ["negative", "censored_by_cutoff", "censored_by_cutoff"]
    assert segments.exit_dataset(s.limit(0), [2]).count() == 0


def test_warning_episodes_split_at_gaps_and_calm_days(spark, day):
    rows = [(day(0), "watch", "v"), (day(1), "high", "w"), (day(10), "watch", "u"), (day(11), "normal", ""), (day(12), None, ""), (day(13), "elevated", "t")]
    got = evaluation.warning_episodes(spark.createDataFrame(rows, "trade_date date, level string, drivers string")).orderBy("start_date").collect()
    assert [(r.start_date, r.end_date, r.peak, r.first_drivers, r.active) for r in got] == [
        (day(0), day(1), "high", "v", False), (day(10), day(10), "watch", "u", False), (day(13), day(13), "elevated", "t", True),
    ]


def test_open_simulation_by_hand(spark, day):
    rows = [("x", day(0), 10.0, 10.0), ("x", day(1), 10.0, 12.0), ("x", day(2), 15.0, 12.0)]
    p = spark.createDataFrame(rows, "entity string, trade_date date, open double, close double")
    e = spark.createDataFrame([(day(1), "x", 1.0)], "exec_date date, entity string, weight double")
    held = {r.trade_date: r for r in backtest.simulate_open(p, e, 0.01).collect()}
    assert sorted(held) == [day(1), day(2)] and held[day(1)].gross == 0 and abs(held[day(1)].net + 0.01) < 1e-12
    assert abs(held[day(2)].overnight - 0.25) < 1e-12 and abs(held[day(2)].gross) < 1e-12
    entry = {r.trade_date: r for r in backtest.simulate_open(p, e, 0.01, entry_day=True).collect()}
    assert abs(entry[day(1)].net - (1.2 * 0.99 - 1)) < 1e-12
