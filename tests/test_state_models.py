"""Many-model training, stays, walk-forward states and exact quantiles against enumeration and small own versions."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import recursions
from panelforge.operators import state_models as sm
from panelforge.operators.quantiles import quantiles
from panelforge.plans import tables


def unit(r, *shape):
    x = r.random(shape) + 0.1
    return x / x.sum(-1, keepdims=True)


@pytest.mark.parametrize("seed", range(4))
def test_best_stays_by_enumeration(seed):
    r = np.random.default_rng(seed)
    k, longest, steps = 3, 3, 6
    dens, start, move, stay = r.normal(size=(1, steps, k)), unit(r, 1, k), unit(r, 1, k, k), unit(r, 1, k, longest)
    move[:, range(k), range(k)] = 0
    move /= move.sum(2, keepdims=True)
    with np.errstate(divide="ignore"):
        best, age, source = recursions.stays(dens, np.log(start), np.log(move), np.log(stay))
    for n in range(1, steps + 1):  # every prefix's end is in the table

        def paths(left):
            if not left:
                yield []
            for d in range(1, min(longest, left) + 1):
                for rest in paths(left - d):
                    yield [d, *rest]

        def score(lengths, states):
            total, at = math.log(start[0, states[0]]), 0
            for i, (d, s) in enumerate(zip(lengths, states)):
                total += math.log(stay[0, s, d - 1]) + dens[0, at : at + d, s].sum() + (math.log(move[0, states[i - 1], s]) if i else 0)
                at += d
            return total

        want = max((score(p, s), p, s) for p in paths(n) for s in itertools.product(range(k), repeat=len(p)) if all(a != b for a, b in zip(s, s[1:])))
        got = recursions.path_of(best[0], age[0], source[0], n)
        assert best[0, n].max() == pytest.approx(want[0])
        assert [(s, b - a) for s, a, b in got] == list(zip(want[2], want[1]))


def test_expectations_by_enumeration():
    r = np.random.default_rng(1)
    k, steps, lengths = 2, 11, np.array([11, 9, 1])
    dens, start, move = 3 * r.normal(size=(3, steps, k)) - 40, unit(r, 3, k), unit(r, 3, k, k)
    gamma, moves, score = recursions.expected(dens, lengths, start, move)
    alpha, _ = recursions.forward(dens, lengths, start, move)
    for i, n in enumerate(lengths):
        weight = {p: start[i, p[0]] * math.prod(move[i, a, b] for a, b in zip(p, p[1:])) * math.exp(sum(dens[i, t, s] for t, s in enumerate(p))) for p in itertools.product(range(k), repeat=n)}
        total = sum(weight.values())
        assert score[i] == pytest.approx(math.log(total))
        for t in range(steps):
            assert gamma[i, t] == pytest.approx([sum(w for p, w in weight.items() if t < n and p[t] == s) / total for s in range(k)])
        want = [[sum(w * sum(1 for x in zip(p, p[1:]) if x == (a, b)) for p, w in weight.items()) / total for b in range(k)] for a in range(k)]
        assert moves[i] == pytest.approx(np.array(want))
        assert alpha[i, n - 1] == pytest.approx([sum(w for p, w in weight.items() if p[-1] == s) / total for s in range(k)])


@pytest.fixture(scope="module")
def panel(spark):
    """Entities that change between a calm and a wild regime, with gaps and nulls."""
    r, rows = np.random.default_rng(7), []
    for e in range(5):
        s = 0
        for i in range(220):
            s = s if r.random() < 0.93 else 1 - s
            if r.random() < 0.9:
                x, y = r.normal((0, 3)[s], 0.7), r.normal((1, -1)[s], 0.5)
                rows.append((f"e{e}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x) if r.random() < 0.97 else None, float(y)))
    return spark.createDataFrame(rows, "entity string, trade_date date, x double, y double").repartition(3)


def small_em(seqs, k, mean, rounds, floor=1e-4):
    """Plain expectation-maximisation, one sequence and step at a time, from centres."""
    all_x = np.vstack(seqs)
    near = ((all_x[:, None] - mean) ** 2).sum(2).argmin(1)
    mean = np.array([all_x[near == s].mean(0) for s in range(k)])
    var = np.array([np.maximum(all_x[near == s].var(0), floor) for s in range(k)])
    start, move = np.full(k, 1 / k), np.full((k, k), 0.1 / (k - 1))
    move[range(k), range(k)] = 0.9
    scores = []
    for _ in range(rounds):
        first, moves, gammas, ll = np.zeros(k), np.zeros((k, k)), [], 0.0
        for x in seqs:
            b = np.exp(-0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var).sum(2))
            n = len(x)
            alpha, beta = np.zeros((n, k)), np.ones((n, k))
            scale = np.zeros(n)
            for t in range(n):
                a = (start if t == 0 else alpha[t - 1] @ move) * b[t]
                scale[t] = a.sum()
                alpha[t] = a / scale[t]
            for t in range(n - 2, -1, -1):
                beta[t] = move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
                moves += np.outer(alpha[t], b[t + 1] * beta[t + 1] / scale[t + 1]) * move
            gammas.append(alpha * beta)
            first += gammas[-1][0]
            ll += np.log(scale).sum()
        g = np.vstack(gammas)
        mean = (g.T @ all_x) / g.sum(0)[:, None]
        var = np.maximum((g.T @ all_x**2) / g.sum(0)[:, None] - mean**2, floor)
        start, move = first / first.sum(), (moves + 1e-6) / (moves + 1e-6).sum(1, keepdims=True)
        scores.append(ll)
    return mean, scores


def test_mixture_equals_a_small_own_em(panel):
    cfg = sm.Config(n_states=2, starts=1, rounds=6, cluster_rounds=50, tol=-1e9)
    seqs = sm.sequences(panel.withColumn("window", F.lit(0)), ["x", "y"])
    _, centres = sm._first_centres(seqs, 2, cfg)
    got = sm.fit(seqs, 2, cfg)
    own = [np.array(r.x).reshape(-1, 2) for r in seqs.orderBy("entity").collect()]
    all_x, mean = np.vstack(own), centres[0]
    for _ in range(50):  # Lloyd
        near = ((all_x[:, None] - mean) ** 2).sum(2).argmin(1)
        mean = np.array([all_x[near == s].mean(0) for s in range(2)])
    mean, scores = small_em(own, 2, mean, 6)
    assert got.trace[0] == pytest.approx(scores, rel=1e-9) and got.mean[0] == pytest.approx(mean)
    assert all(b >= a - 1e-6 for a, b in zip(scores, scores[1:]))


def test_best_of_several_starts(panel):
    seqs = sm.sequences(panel.withColumn("window", F.lit(0)), ["x", "y"])
    each = [sm.fit(seqs, 2, sm.Config(n_states=3, starts=n, rounds=8)).score[0] for n in (1, 4)]
    assert each[1] >= each[0]


def test_windows_are_trained_side_by_side(panel):
    """A window's model is the one that it gets alone."""
    two = panel.withColumn("window", F.explode(F.array(F.lit(3), F.lit(8)))).where("window = 8 or trade_date < '2024-05-01'")
    cfg = sm.Config(n_states=2, starts=2, rounds=5)
    both = sm.fit(sm.sequences(two, ["x", "y"]), 2, cfg)
    alone = sm.fit(sm.sequences(two.where("window = 8"), ["x", "y"]), 2, cfg)
    assert both.window.tolist() == [3, 8] and both.mean[1] == pytest.approx(alone.mean[0]) and both.score[1] == pytest.approx(alone.score[0])


def test_stays_are_found_and_counted(panel, spark):
    r, rows, truth = np.random.default_rng(3), [], {}
    for e in range(4):
        state, i = e % 2, 0
        while i < 150:
            for _ in range(int(r.choice([4, 5, 6] if state else [10, 11, 12]))):
                rows.append((f"e{e}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(r.normal((0, 4)[state], 0.3))))
                truth[rows[-1][:2]] = state
                i += 1
            state = 1 - state
    seqs = sm.sequences(spark.createDataFrame(rows, "entity string, trade_date date, x double").withColumn("window", F.lit(0)), ["x"])
    m = sm.fit(seqs, 1, sm.Config(kind="stays", n_states=2, starts=2, max_stay=20, smoothing=0.01))
    order = m.mean[0, :, 0].argsort()
    assert m.mean[0, order, 0] == pytest.approx([0, 4], abs=0.1)
    longs, shorts = m.stay[0, order]
    assert longs[9:12].sum() > 0.9 and shorts[3:6].sum() > 0.9 and m.move[0].diagonal().tolist() == [0, 0]
    got = sm.decoded(seqs, m, 1).collect()
    assert all(order.tolist().index(x.state) == truth[x.entity, x.trade_date] for x in got) and len(got) == len(rows)
    # every prefix by itself ends as the table of the whole says
    ends = {(x.entity, x.trade_date): (x.state, x.age) for x in sm.endpoints(seqs, m, 1).collect()}
    for n in (1, 7, 40, 90):
        cut = seqs.withColumn("x", F.slice("x", 1, n)).withColumn("dates", F.slice("dates", 1, n))
        last = {}
        for x in sorted(sm.decoded(cut, m, 1).collect(), key=lambda x: x.trade_date):
            last[x.entity] = x
        assert {e: (x.state, x.age) for e, x in last.items()} == {e: ends[e, x.trade_date] for e, x in last.items()}


def test_windows_against_pandas(panel):
    signals = panel.select(F.col("trade_date").alias("signal_date")).distinct().where("day(signal_date) % 3 = 0")
    got = sm.training_windows(panel, signals, F.date_trunc("month", "signal_date"), 40, 150, 12).orderBy("window").toPandas()
    p = panel.toPandas().sort_values(["entity", "trade_date"])
    days, sig = sorted(p.trade_date.unique()), sorted(signals.toPandas().signal_date)
    want, now = [], None
    for s in sig:
        if now != (s.year, s.month):
            dates = [d for d in days if d <= s][-40:]
            own = p[p.trade_date.isin(dates)].groupby("entity").size()
            if own[own >= 12].sum() >= 150:
                want.append([dates[0], dates[-1], s, s])
                now = (s.year, s.month)
        if want:
            want[-1][3] = s
    assert [list(r)[1:] for r in got.itertuples(index=False)] == want and want[0][2] > sig[0]


def test_nothing_of_the_future_reaches_a_row(panel):
    """Rows until a date are the same whether or not later data exist."""
    cfg, month = sm.Config(n_states=2, starts=2, rounds=6, tol=0.5), F.date_trunc("month", "signal_date")
    trend, risk = F.avg("y"), -F.avg("y")
    cut = dt.date(2024, 5, 20)
    runs = []
    for p in (panel, panel.where(F.col("trade_date") <= F.lit(cut))):
        signals = p.select(F.col("trade_date").alias("signal_date")).distinct()
        states = sm.walk_forward(p, ["x", "y"], signals, month, cfg, trend, risk, window=60, least_rows=100, least_sequence=20)
        stays = sm.walk_forward_stays(p, ["x", "y"], signals, month, sm.Config(kind="stays", n_states=2, starts=1, rounds=5, max_stay=30), [("up", {"y": 1.0}, 1)], [1, 5], window=60)
        runs.append([d.where(F.col("trade_date") <= F.lit(cut)).orderBy("entity", "trade_date").toPandas() for d in (states, stays)])
    for a, b in zip(*runs):
        assert len(a) == len(b) > 200
        for x in a.columns:
            if a[x].dtype == float:
                assert np.allclose(a[x], b[x], rtol=1e-6, atol=1e-9, equal_nan=True), x
            else:
                assert a[x].equals(b[x]), x
    states = runs[0][0]
    assert (states.train_end <= states.trade_date).all() and np.allclose(states[["prob_trend_up", "prob_neutral", "prob_risk_off"]].sum(axis=1), 1) and np.allclose(states[["next_trend_up", "next_neutral", "next_risk_off"]].sum(axis=1), 1)


def test_what_panels_come_from_is_read_once(panel, spark, sf_dir):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    signals, month = panel.select(F.col("trade_date").alias("signal_date")), F.date_trunc("month", "signal_date")
    cfg = sm.Config(kind="stays", n_states=2, starts=1, rounds=1, cluster_rounds=1, max_stay=30)
    stays = sm.walk_forward_stays(panel.mapInArrow(count, panel.schema), ["x", "y"], signals, month, cfg, [("up", {"y": 1.0}, 1)], [1, 5], window=60)
    assert stays.count() and seen.value == panel.count()
    assert not any("lineitem" in f for f in tables.panel(spark, sf_dir).inputFiles())


def test_labels(spark):
    rows = [(0, 0, 1.0, 0.1), (0, 1, -1.0, 0.9), (0, 2, 0.0, 0.0), (1, 0, 5.0, 9.0), (2, 4, None, None), (0, 0, 3.0, 0.1)]
    df = spark.createDataFrame(rows, "window int, state int, a double, b double")
    got = {(r.window, r.state): r.label for r in sm.trend_labels(df, F.avg("a"), F.avg("b") - F.avg("a")).collect()}
    assert got == {(0, 0): "TrendUp", (0, 1): "RiskOff", (0, 2): "Neutral", (1, 0): "TrendUp", (2, 4): "TrendUp"}
    got = {(r.window, r.state): r.label for r in sm.profile_labels(df, [("A", {"a": 1.0}, 1), ("B", {"|a": 1.0, "b": 1.0}, 2), ("C", {"a": -1.0}, 4)]).collect()}
    assert got == {(0, 0): "A", (0, 1): "B", (0, 2): "Neutral", (1, 0): "A", (2, 4): "A"}


def test_episodes(spark, day):
    rows = [("a", day(i), s, f"L{s}", day(0)) for i, s in enumerate([1, 1, 2, 1])] + [("b", day(0), 1, "L1", day(0))]
    got = sm.episodes(spark.createDataFrame(rows, "entity string, trade_date date, state int, label string, train_end date")).orderBy("entity", "episode").collect()
    assert [(r.entity, r.state, r.n_days, r.exit_date, r.next_state, r.left_censored, r.right_censored) for r in got] == [("a", 1, 2, day(2), 2, True, False), ("a", 2, 1, day(3), 1, False, False), ("a", 1, 1, None, None, False, True), ("b", 1, 1, None, None, True, True)]


def test_lifecycle_edges(spark):
    ages = spark.createDataFrame([("p", a) for a in (0, 1, 2, 3, 4, 9)] + [("none", 1)], "label string, age int")
    stays = spark.createDataFrame([("p", [0.5, 0.0, 0.3, 0.2])], "label string, stay array<double>")
    got = {(r.label, r.age): r for r in sm.lifecycle(ages, stays, ["label"], [1, 2]).collect()}
    assert [got["p", a].duration_percentile for a in (0, 1, 2, 3, 4, 9)] == pytest.approx([0, 0.5, 0.5, 0.8, 1, 1])
    assert [got["p", a].p_exit_1 for a in (1, 2, 3)] == pytest.approx([0.5, 0.0, 0.6]) and got["p", 2].p_exit_2 == pytest.approx(0.6) and got["p", 0].p_exit_1 is None is got["p", 4].p_exit_1
    assert [got["p", a].expected_rest for a in (0, 1, 3, 4)] == pytest.approx([0.5 + 0.9 + 0.8, 0.6 + 0.6, 0.4, 0.0])
    assert [got["p", a].tail_status for a in (0, 3, 4)] == ["unavailable", "within_duration_support", "beyond_duration_support"] and got["none", 1].phase == "unknown" and got["none", 1].duration_percentile is None


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact(spark, by):
    r = np.random.default_rng(2)
    parts = {"a": r.normal(size=900), "b": r.standard_cauchy(700) * 1e9, "c": r.integers(0, 4, 500).astype(float), "d": np.array([3.0]), "e": np.r_[1e308, -1e308, 5.0, 5.0], "f": np.nextafter(1.0, [0.0, 2.0, 2.0])}
    rows = [(g, float(v), None if g == "d" else float(-v)) for g, vs in parts.items() for v in vs] + [("a", None, None), (None, 2.0, 1.0), ("a", float("nan"), None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(4)
    qs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {getattr(r, "g", "all"): (r.x, r.y) for r in quantiles(df, ["x", "y"], qs, by).collect()}
    own = pd.DataFrame(rows, columns=["g", "x", "y"])
    for name, part in own.groupby("g", dropna=False) if by else [("all", own)]:
        name = None if name != name else name
        for x, vals in zip(("x", "y"), got[name]):
            v = part[x].dropna().to_numpy()
            assert vals is None if not len(v) else np.allclose(vals, np.quantile(v, qs), rtol=1e-12), (name, x)
    assert quantiles(df.where("false"), ["x"], qs, ["g"]).count() == 0
