"""Decision tables, alignment, lineage, random portfolios and the streamed audit."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import alignment, backtest, decisions, target_audit
from panelforge.plans import catalog_decisions
from panelforge.streaming import streams


@pytest.mark.parametrize("rows, columns", [(1, 1), (3, 3), (6, 6), (4, 6), (6, 3)])
def test_assignment_is_the_best_permutation(rows, columns):
    r = np.random.default_rng(rows * 10 + columns)
    for case in range(25):
        costs = r.random((rows, columns)) if case % 3 else r.integers(0, 3, (rows, columns)).astype(float)
        got = alignment.assignment(costs)
        small, large = min(rows, columns), max(rows, columns)
        wide = costs if rows <= columns else costs.T
        best = min(sum(wide[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == small
        assert sum(costs[a, b] for a, b in got) == pytest.approx(best)


def test_alignment_rows(spark):
    schema = "pair string, state string, label string, a double, b double, dwell double"
    base = spark.createDataFrame([("m", "0", "up", 1.0, 2.0, 10.0), ("m", "1", "down", -1.0, None, 5.0), ("n", "0", "x", None, None, None)], schema)
    other = spark.createDataFrame([("m", "0", "down", -1.0, 7.0, 5.0), ("m", "1", "up", 1.0, 2.1, 10.0), ("m", "2", "flat", 9.0, 9.0, 0.0), ("n", "0", "x", 1.0, None, None)], schema)
    d = alignment.distances(base, other, ["a", "b", "dwell"], ["dwell"])
    got = {(r.pair, r.base_state): r for r in alignment.align(d).collect()}
    assert got["m", "0"].state == "1" and got["m", "0"].severity == "none" and got["m", "0"].label_kept and got["m", "0"].distance == pytest.approx((0.1 / 2.1) / 3**0.5)
    assert got["m", "1"].state == "0" and got["m", "1"].distance == 0 and got["m", "1"].score == 1
    assert got["n", "0"].severity == "unknown" and got["n", "0"].distance is None and got["n", "0"].method == "not_enough_states"
    s = {r.pair: r for r in alignment.drift_summary(alignment.align(d)).collect()}
    assert (s["m"].n, s["m"].n_kept, s["m"].worst, s["n"].worst) == (2, 2, "none", "unknown")


def test_first_rule_counts(spark):
    df = spark.createDataFrame([(1, None), (5, 2), (9, 2)], "x int, y int")
    rules = [("y > 100", {"a": "never"}), ("x > 4 and y = 2", {"a": "both", "b": 1}), ("x > 8", {"a": "late"}), ("true", {"a": "rest", "b": 0})]
    got = {r.x: (r.a, r.b, r.rule) for r in decisions.decide(df, rules).collect()}
    assert got == {1: ("rest", 0, 4), 5: ("both", 1, 2), 9: ("both", 1, 2)}
    why = df.select("x", decisions.reasons([("x > 4", "big"), ("y is null", "none"), ("x > 8", "big"), ("y > 5", "no")]).alias("r"))
    assert {r.x: r.r for r in why.collect()} == {1: ["none"], 5: ["big"], 9: ["big"]}


def evidence(spark, **changes):
    row = {"run": "r", "db_found": True, "run_id_resolved": True, "churn_bucket": "normal", "causal_cache_status": "pass"}
    for x in decisions.INPUTS:
        row |= {f"{x}_availability": "available", f"{x}_readiness": "validated", f"{x}_reasons": []}
    row |= changes
    kinds = {bool: "boolean", str: "string", list: "array<string>"}
    return decisions.readiness(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))).first()


def test_readiness_ladder(spark):
    see = lambda **x: (lambda r: (r.status, r.readiness_status, r.evidence_level, r.display_action))(evidence(spark, **x))
    assert see() == ("pass", "partial", "internal_diagnostic", "warn")
    assert see(causal_cache_status="partial") == ("pass", "research_only", "exploratory", "research_only")
    assert see(label_alignment_reasons=["label_alignment_ambiguity_high"]) == ("pass", "research_only", "exploratory", "research_only")
    assert see(ci_validation_availability="missing") == ("partial", "research_only", "exploratory", "research_only")
    assert see(db_found=False) == ("partial", "blocked", "exploratory", "blocked")
    assert see(causal_cache_reasons=["causal_cache_leakage_violation"], db_found=False) == ("fail", "blocked", "exploratory", "blocked")
    assert see(churn_bucket="excessive", db_found=False) == ("partial", "research_only", "exploratory", "hide_strategy")
    assert see(churn_bucket="excessive", causal_cache_reasons=["evidence_boundary_violation"]) == ("fail", "research_only", "exploratory", "hide_strategy")
    r = evidence(spark, db_found=False, confidence_readiness="partial", confidence_reasons=["a", "a"], churn_dwell_availability="missing")
    assert r.reasons == ["local_db_missing", "a", "confidence_not_strong_enough_for_validated_readiness"] and r.absent == ["churn_dwell"]


def test_hazard_ladder(spark):
    schema = "k string, n int, n_positive int, n_negative int, raw_brier double, calibrated_brier double, baseline_brier double, calibration_status string, baseline_valid boolean, missing_calibration boolean"
    rows = [
        ("usable", 90, 40, 50, 0.2, 0.1, 0.15, "calibration_candidate", True, False), ("no baseline", 90, 40, 50, 0.2, 0.1, None, "calibration_candidate", False, False), ("baseline", 90, 40, 50, 0.2, 0.1, 0.05, "calibration_candidate", True, False),
        ("none", 90, 40, 50, 0.2, None, None, None, True, False), ("worse", 90, 40, 50, 0.2, 0.3, None, "degraded_brier_worse", False, False), ("weak", 90, 40, 50, 0.2, 0.25, None, "calibration_candidate", False, False),
        ("few", 9, 4, 5, 0.2, 0.1, 0.15, "calibration_candidate", True, False), ("one class", 90, 0, 90, 0.2, 0.1, 0.15, "calibration_candidate", True, False), ("missing", 90, 40, 50, None, None, None, None, True, True), ("gone", 90, 40, 50, None, None, None, None, False, True),
    ]
    got = {r.k: r.readiness for r in decisions.hazard_readiness(spark.createDataFrame(rows, schema), 50).collect()}
    assert got == {"usable": "usable_probability", "no baseline": "usable_probability", "baseline": "baseline_only", "none": "baseline_only", "worse": "ordinal_only", "weak": "ordinal_only", "few": "insufficient_sample", "one class": "insufficient_sample", "missing": "baseline_only", "gone": "insufficient_sample"}


def test_method_selection(spark):
    schema = "k string, method string, n bigint, n_positive bigint, brier double, ece double, mce double, monotone boolean, spearman double"
    base = lambda k, n=2000, p=300, ece=0.2, mce=0.3, mono=False, rho=None: (k, "raw", n, p, 0.2, ece, mce, mono, rho)
    rows = [base("good"), ("good", "b", 2000, 300, 0.1, 0.01, 0.1, True, None), ("good", "a", 2000, 300, 0.1, 0.02, 0.1, True, None), base("raw", ece=0.01, mce=0.1, mono=True), ("raw", "a", 2000, 300, 0.199, 0.01, 0.1, True, None)]
    rows += [base("rank", rho=0.4), base("bad"), ("bad", "a", 2000, 300, None, None, None, None, None), base("few", n=10), ("alone", "a", 2000, 300, 0.1, 0.01, 0.1, True, None)]
    got = {r.k: (r.status, r.selected_method, r.selected_brier) for r in decisions.select_method(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert got == {"good": ("usable_probability", "b", 0.1), "raw": ("raw_only", "raw", 0.2), "rank": ("ordinal_only", "raw", 0.2), "bad": ("invalid", "none", None), "few": ("insufficient_sample", "none", None)}


def test_categories_over_folds(spark):
    schema = "s string, method string, usage string, n bigint, n_positive bigint, n_negative bigint, n_blocks bigint, ece double, brier double, auc double, brier_retention double"
    rows = [("ok", "platt", "eligible", 300, 20, 280, 3, 0.02, 0.1, 0.7, 0.01)] * 2 + [("wide", "platt", "eligible", 600, 20, 580, 3, 0.02, 0.1, 0.4, 0.01), ("blocks", "platt", "eligible", 600, 20, 580, 1, 0.02, 0.1, 0.7, 0.01), ("worse", "platt", "eligible", 600, 20, 580, 3, 0.02, 0.1, 0.7, -0.01)]
    rows += [("rank", "platt", "eligible", 200, 5, 195, 3, 0.2, 0.1, 0.7, 0.01), ("id", "identity", "eligible", 600, 20, 580, 3, 0.02, 0.1, 0.7, 0.0), ("few", "platt", "eligible", 50, 5, 45, 3, 0.02, 0.1, 0.7, 0.0), ("diag", "platt", "diagnostic", 600, 20, 580, 3, 0.02, 0.1, 0.7, 0.0)]
    widths = spark.createDataFrame([("wide", "platt", 0.4), ("ok", "platt", 0.1)], "s string, method string, width double")
    got = {r.s: (r.category, r.n_folds, r.n) for r in decisions.calibration_categories(spark.createDataFrame(rows, schema), widths, ["s"]).collect()}
    assert got["ok"] == ("usable_probability_candidate", 2, 600) and got["wide"][0] == "research_only" and got["blocks"][0] == got["worse"][0] == got["rank"][0] == "ordinal_only_candidate"
    assert (got["id"][0], got["few"][0], got["diag"][0]) == ("baseline_only_candidate", "insufficient_data", "research_only")


def test_lineage(spark, day):
    runs = spark.createDataFrame([(i, f"v{i}", f"c{i}", 10) for i in range(7)], "run_id bigint, version string, config string, expected_rows bigint")
    caches = [
        (10, 0, day(0), "z", "z", 3, 0, 0, 0), (11, None, day(0), "v1", "c1", 10, 0, 0, 0), (12, None, day(0), "v2", "c2", 10, 0, 0, 0), (13, None, day(1), "v2", "q", 10, 0, 0, 0), (14, None, day(0), "v3", "q", 9, 1, 0, 0),
        (15, None, day(0), "v4", "c4", 10, 0, 0, 2), (16, 5, day(0), "v5", "c5", 10, 0, 1, 0), (17, 99, day(0), "none", None, 10, 0, 0, 0),
    ]
    c = spark.createDataFrame(caches, "cache_key bigint, parent_run_id bigint, created_at date, version string, config string, n_rows bigint, n_duplicates bigint, n_leaks bigint, n_missing bigint")
    got = {r.run_id: r for r in decisions.link_lineage(runs, c, ["version", "config"]).collect()}
    assert {i: (r.status, r.cache_key) for i, r in got.items()} == {
        0: ("native_link", 10), 1: ("strict_inferred_link", 11), 2: ("ambiguous", 12), 3: ("weak_inferred_candidate", 14), 4: ("requires_regeneration", 15), 5: ("weak_inferred_candidate", 16), 6: ("not_linkable", None),
    }
    assert got[3].reasons == ["strict_metadata_not_fully_matched", "coverage_incomplete", "duplicate_cache_state_keys"] and got[3].confidence == pytest.approx(0.28) and got[2].n_candidates == 2 and got[2].reasons == ["multiple_candidates"]


def _most_rows(plan):
    """Most rows that any step of an executed plan gave out."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    rows = plan.metrics().get("numOutputRows")
    return max([rows.get().value() if rows.isDefined() else 0, *map(_most_rows, inner)])


def test_lineage_makes_no_pairs(spark, day):
    fields, value = ["a", "b", "d"], lambda k, n: None if k % (n + 1) == 0 else k * 7919 % n
    runs = [(i, value(i, 2), value(i + 1, 13), value(i + 2, 40), 5 + i % 3) for i in range(300)]
    caches = [(i, i // 9 if i % 9 == 4 else None, day(i % 5) if i % 8 else None, value(i + 3, 2), value(i, 13), value(i, 40) if i % 2 else None, i % 9 or None, i % 4 // 3, i % 5 // 4, i % 7 // 6) for i in range(1500)]
    r = spark.createDataFrame(runs, "run_id bigint, a bigint, b bigint, d bigint, expected_rows bigint")
    k = spark.createDataFrame(caches, "cache_key bigint, parent_run_id bigint, created_at date, a bigint, b bigint, d bigint, n_rows bigint, n_duplicates bigint, n_leaks bigint, n_missing bigint")
    df = decisions.link_lineage(r, k, fields)
    got = {x.run_id: (x.cache_key, x.n_candidates, x.n_matching) for x in df.collect()}
    for run in runs:
        same = lambda x: sum(u is not None and u == v for u, v in zip(run[1:4], x[3:6]))
        met = [(x[1] == run[0], same(x), x[6] or -1, x[2] or dt.date.min, x[0]) for x in caches if same(x) or x[1] == run[0]]
        best = max(met, default=(None, 0, None, None, None))
        assert got[run[0]] == (best[4], len(met), best[1])
    assert sum(n for _, n, _ in got.values()) > 100_000 and _most_rows(df._jdf.queryExecution().executedPlan()) < 7 * 1500


def test_random_portfolios(spark, day):
    rows = [(f"e{e}", day(i), 10.0 + e + i % 3, 10.5 + e + i % 2) for e in range(6) for i in range(30) if (e, i) != (2, 0)]
    p = spark.createDataFrame(rows, "entity string, trade_date date, open double, close double")
    ev = backtest.random_events(p, 10, 3, 5).cache()
    assert sorted(map(tuple, ev.collect())) == sorted(map(tuple, backtest.random_events(p.repartition(7), 10, 3, 5).collect()))
    per = ev.groupBy("trial", "exec_date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("k"), F.sum("weight").alias("w")).collect()
    assert len(per) == 15 and all((r.n, r.k) == (3, 3) and r.w == pytest.approx(1) for r in per)
    assert "e2" not in {r.entity for r in ev.where(F.col("exec_date") == day(1)).collect()} and len({tuple(sorted(r.entity for r in ev.where(f"trial = {t}").collect())) for t in range(5)}) > 1
    curves = backtest.simulate_trials(p, ev, 0.01).cache()
    for t in range(5):  # each trial's curve is the one that it has alone
        alone = {r.trade_date: (r.gross, r.turnover, r.net) for r in backtest.simulate_open(p, ev.where(f"trial = {t}").drop("trial"), 0.01).collect()}
        got = {r.trade_date: (r.gross, r.turnover, r.net) for r in curves.where(f"trial = {t}").collect()}
        assert set(got) == set(alone) and all(got[d] == pytest.approx(alone[d]) for d in alone)
        m, one = (f.first() for f in (backtest.trial_metrics(curves.where(f"trial = {t}")), backtest.metrics(curves.where(f"trial = {t}").drop("trial"))))
        assert (m.annual_return, m.max_drawdown, m.turnover) == pytest.approx((one.annual_return, one.max_drawdown, one.turnover))
    assert {r.metric for r in backtest.random_summary(backtest.trial_metrics(curves)).collect()} >= {"annual_return", "turnover"}


def test_streamed_audit_goes_on_after_a_stop(spark, sf_dir, tmp_path):
    known, stored = catalog_decisions._stored_targets(spark, sf_dir)
    audit = catalog_decisions.audit_of(spark, known)
    stored.repartition(6).write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    want = sorted((r.check, r.n, round(r.worst or 0, 9)) for r in audit(rows).collect())
    seen = []

    def counted(batch):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("stopped in the middle")
        return audit(batch)

    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.audit_stream(stream(), counted, f"{tmp_path}/out", f"{tmp_path}/cp")
    with pytest.raises(Exception, match="stopped in the middle"):
        q.processAllAvailable()
    q.stop()
    part = sum(r.n for r in streams.audit_counters(spark, f"{tmp_path}/out").where("check = 'rows'").collect())
    assert 0 < part < rows.count()
    q = streams.audit_stream(stream(), counted, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    got = sorted((r.check, r.n, round(r.worst or 0, 9)) for r in streams.audit_counters(spark, f"{tmp_path}/out").collect())
    assert got == want and len(seen) == 7  # the batch that was lost ran again
    again = lambda df: target_audit.duplicates(df).first().n
    assert again(rows.unionByName(rows.where("horizon = 5"))) - again(rows) == rows.where("horizon = 5").count() and target_audit.duplicates(rows.limit(0)).first().n == 0
