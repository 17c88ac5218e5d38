"""Registered queries of decision tables, alignment, lineage and random portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import alignment, backtest, decisions, target_audit, tendency
from panelforge.panel import islands
from panelforge.plans import sql as q
from panelforge.plans.catalog import _states, query
from panelforge.plans.catalog_models import EXITS_SQL, _exits
from panelforge.plans.tables import panel, rounded, table

c = F.col
METRICS_SQL = EXITS_SQL + """,
bk AS (SELECT *, CASE WHEN age <= 3 THEN '1-3' WHEN age <= 7 THEN '4-7' WHEN age <= 14 THEN '8-14' ELSE '15+' END AS age_bucket FROM ex),
lr AS (SELECT label, horizon, avg(y) AS label_rate FROM bk WHERE y IS NOT NULL GROUP BY 1, 2), ar AS (SELECT horizon, age_bucket, avg(y) AS age_rate FROM bk WHERE y IS NOT NULL GROUP BY 1, 2),
mt AS (SELECT label, bk.horizon, bk.age_bucket, count(*) AS n, sum(y) AS n_positive, count(*) - sum(y) AS n_negative, round(avg((raw - y) * (raw - y)), 9) AS raw_brier,
    CASE WHEN count(raw) > 0 THEN round(avg((label_rate - y) * (label_rate - y)), 9) END AS calibrated_brier, round(avg((age_rate - y) * (age_rate - y)), 9) AS baseline_brier, count(raw) = 0 AS missing_calibration, count(*) >= 100 AS baseline_valid
  FROM bk JOIN lr USING (label, horizon) JOIN ar ON ar.horizon = bk.horizon AND ar.age_bucket = bk.age_bucket WHERE y IS NOT NULL GROUP BY 1, 2, 3),
ms AS (SELECT *, CASE WHEN calibrated_brier <= raw_brier THEN 'calibration_candidate' ELSE 'degraded_brier_worse' END AS calibration_status FROM mt)"""


def _metrics(spark, sf_dir):
    """Brier scores of raw, label-rate and age-rate chances by label, horizon and age bucket."""
    t = _exits(spark, sf_dir).where("y is not null").withColumn("age_bucket", tendency.age_bucket(c("age")))
    by_label = t.groupBy("label", "horizon").agg(F.avg("y").alias("label_rate"))
    by_age = t.groupBy("horizon", "age_bucket").agg(F.avg("y").alias("age_rate"))
    rows = t.join(by_label, ["label", "horizon"]).join(by_age, ["horizon", "age_bucket"])
    brier = lambda p: F.round(F.avg((c(p) - c("y")) * (c(p) - c("y"))), 9)
    m = rows.groupBy("label", "horizon", "age_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive"), (F.count(F.lit(1)) - F.sum("y")).alias("n_negative"), brier("raw").alias("raw_brier"), F.when(F.count("raw") > 0, brier("label_rate")).alias("calibrated_brier"),
        brier("age_rate").alias("baseline_brier"), (F.count("raw") == 0).alias("missing_calibration"), (F.count(F.lit(1)) >= 100).alias("baseline_valid"),
    )
    return m.withColumn("calibration_status", F.when(c("calibrated_brier") <= c("raw_brier"), "calibration_candidate").otherwise("degraded_brier_worse"))


@query(q.base(upto="segs") + METRICS_SQL + """
SELECT label, horizon, age_bucket, n, CAST(n_positive AS BIGINT) AS n_positive, round(raw_brier, 6) + 0.0 AS raw_brier, round(calibrated_brier, 6) + 0.0 AS calibrated_brier, round(baseline_brier, 6) + 0.0 AS baseline_brier,
  CASE WHEN missing_calibration AND baseline_valid THEN 'baseline_only' WHEN missing_calibration OR n < 50 OR n_positive <= 0 OR n_negative <= 0 THEN 'insufficient_sample'
    WHEN calibration_status = 'calibration_candidate' AND calibrated_brier <= raw_brier AND calibrated_brier <= baseline_brier THEN 'usable_probability'
    WHEN baseline_valid AND (calibrated_brier IS NULL OR calibration_status = 'degraded_brier_worse' OR calibrated_brier > baseline_brier) THEN 'baseline_only' ELSE 'ordinal_only' END AS readiness,
  CASE WHEN missing_calibration THEN 'missing_horizon_evidence' WHEN n < 50 THEN 'sample_below_minimum' WHEN n_positive <= 0 OR n_negative <= 0 THEN 'one_class_only'
    WHEN calibration_status = 'calibration_candidate' AND calibrated_brier <= raw_brier AND calibrated_brier <= baseline_brier THEN NULL
    WHEN baseline_valid AND (calibration_status = 'degraded_brier_worse' OR calibrated_brier > baseline_brier) THEN 'baseline_stronger' WHEN calibration_status = 'degraded_brier_worse' THEN 'calibrated_brier_worse_than_raw' ELSE 'support_not_strong_enough' END AS reason FROM ms""")
def hazard_readiness(spark, sf_dir):
    got = decisions.hazard_readiness(_metrics(spark, sf_dir), 50)
    return rounded(got.select("label", "horizon", "age_bucket", "n", "n_positive", "raw_brier", "calibrated_brier", "baseline_brier", "readiness", "reason"))


@query(q.base("n_name") + """, e AS (SELECT entity, count(*) AS n, count(DISTINCT year(trade_date)) AS years, CAST(sum(volume) AS BIGINT) % 5 AS v FROM bars GROUP BY 1),
k AS (SELECT entity, years >= 2 AS db_found, n % 13 != 0 AS run_ok, CASE WHEN n % 3 = 0 THEN 'missing' ELSE 'available' END AS conf, CASE v WHEN 0 THEN 'pass' ELSE 'partial' END AS cache, CASE WHEN v = 1 THEN 'excessive' ELSE 'normal' END AS churn, n % 4 = 1 AS leak, n % 5 = 2 AS vague FROM e),
z AS (SELECT *, list_filter([CASE WHEN NOT db_found THEN 'local_db_missing' END, CASE WHEN NOT run_ok THEN 'run_id_unresolved' END, CASE WHEN vague THEN 'label_alignment_ambiguity_high' END, CASE WHEN leak THEN 'causal_cache_leakage_violation' END,
  CASE WHEN conf = 'missing' THEN 'confidence_not_strong_enough_for_validated_readiness' END, CASE WHEN churn = 'excessive' THEN 'churn_dwell_gate_keeps_display_research_only' END], lambda x: x IS NOT NULL) AS r FROM k)
SELECT entity, CASE WHEN leak THEN 'fail' WHEN NOT db_found OR NOT run_ok OR conf = 'missing' THEN 'partial' ELSE 'pass' END AS status,
  CASE WHEN churn = 'excessive' THEN 'research_only' WHEN leak OR NOT db_found OR NOT run_ok THEN 'blocked' WHEN conf = 'missing' OR cache != 'pass' OR vague THEN 'research_only' ELSE 'partial' END AS readiness_status,
  CASE WHEN churn = 'excessive' THEN 'hide_strategy' WHEN leak OR NOT db_found OR NOT run_ok THEN 'blocked' WHEN conf = 'missing' OR cache != 'pass' OR vague THEN 'research_only' ELSE 'warn' END AS display_action,
  CASE WHEN churn != 'excessive' AND NOT leak AND db_found AND run_ok AND conf != 'missing' AND cache = 'pass' AND NOT vague THEN 'internal_diagnostic' ELSE 'exploratory' END AS evidence_level,
  array_to_string(r, ',') AS reasons, CASE WHEN conf = 'missing' THEN 'confidence' ELSE '' END AS absent FROM z""")
def readiness_gate(spark, sf_dir):
    """Readiness of every nation's run; its evidence is made by rule from the counts of its bars."""
    e = panel(spark, sf_dir, "n_name").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.year("trade_date")).alias("years"), (F.sum("volume").cast("bigint") % 5).alias("v"))
    none = F.array().cast("array<string>")
    some = lambda cond, x: F.when(cond, F.array(F.lit(x))).otherwise(none)
    evidence = e.select(
        "entity", (c("years") >= 2).alias("db_found"), (c("n") % 13 != 0).alias("run_id_resolved"), F.when(c("v") == 1, "excessive").otherwise("normal").alias("churn_bucket"), F.when(c("v") == 0, "pass").otherwise("partial").alias("causal_cache_status"),
        F.when(c("n") % 3 == 0, "missing").otherwise("available").alias("confidence_availability"), F.when(c("n") % 3 == 0, "blocked").otherwise("validated").alias("confidence_readiness"), none.alias("confidence_reasons"),
        F.lit("available").alias("label_alignment_availability"), F.lit("validated").alias("label_alignment_readiness"), some(c("n") % 5 == 2, "label_alignment_ambiguity_high").alias("label_alignment_reasons"),
        F.lit("available").alias("churn_dwell_availability"), F.when(c("v") == 1, "blocked").otherwise("validated").alias("churn_dwell_readiness"), none.alias("churn_dwell_reasons"),
        F.lit("available").alias("causal_cache_availability"), F.lit("validated").alias("causal_cache_readiness"), some(c("n") % 4 == 1, "causal_cache_leakage_violation").alias("causal_cache_reasons"),
        F.lit("available").alias("ci_validation_availability"), F.lit("validated").alias("ci_validation_readiness"), none.alias("ci_validation_reasons"),
    )
    got = decisions.readiness(evidence)
    return got.select("entity", "status", "readiness_status", "display_action", "evidence_level", F.array_join("reasons", ",").alias("reasons"), F.array_join("absent", ",").alias("absent"))


CHOICE_SQL = q.base(upto="segs") + METRICS_SQL + """,
me AS (SELECT label, horizon, method, sum(n) AS n, sum(n_positive) AS p, round(sum(n * b) / sum(n), 9) AS brier, round(sum(n * abs(d)) / sum(n), 9) AS ece, round(max(abs(d)), 9) AS mce FROM (
  SELECT label, horizon, n, n_positive, unnest(['raw', 'label_rate', 'age_rate']) AS method, unnest([raw_brier, calibrated_brier, baseline_brier]) AS b, unnest([raw_brier, calibrated_brier, baseline_brier]) - n_positive * n_negative * 1.0 / n / n AS d FROM ms) WHERE b IS NOT NULL GROUP BY 1, 2, 3)"""


def _choices(spark, sf_dir):
    """Per label, horizon and method: Brier score, and its distance from each age bucket's own spread as error."""
    m = _metrics(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), c(x).alias("b")) for n, x in (("raw", "raw_brier"), ("label_rate", "calibrated_brier"), ("age_rate", "baseline_brier"))))).alias("m")
    rows = m.select("label", "horizon", "n", "n_positive", "n_negative", each).select("*", "m.*").where("b is not null").withColumn("d", c("b") - c("n_positive") * c("n_negative") / c("n") / c("n"))
    r9 = lambda x: F.round(x, 9)
    return rows.groupBy("label", "horizon", "method").agg(
        F.sum("n").alias("n"), F.sum("n_positive").alias("n_positive"), r9(F.sum(c("n") * c("b")) / F.sum("n")).alias("brier"), r9(F.sum(c("n") * F.abs("d")) / F.sum("n")).alias("ece"), r9(F.max(F.abs("d"))).alias("mce"),
    )


@query(CHOICE_SQL + """, rw AS (SELECT * FROM me WHERE method = 'raw'), bs AS (SELECT * FROM me WHERE method != 'raw' QUALIFY row_number() OVER (PARTITION BY label, horizon ORDER BY brier, ece, method) = 1),
se AS (SELECT r.label, r.horizon, r.n, r.p, r.brier AS rb, r.ece AS re, b.method AS bm, b.brier AS bb, CASE WHEN r.n < 1000 OR r.p < 100 THEN 'insufficient_sample' WHEN b.brier <= r.brier - 0.0001 AND b.ece <= greatest(r.ece, 0.05) AND b.mce <= 0.15 THEN 'usable_probability'
  WHEN r.ece <= 0.05 AND r.mce <= 0.15 THEN 'raw_only' ELSE 'ordinal_only' END AS status FROM rw r LEFT JOIN bs b ON b.label = r.label AND b.horizon = r.horizon)
SELECT label, horizon, status, CASE status WHEN 'insufficient_sample' THEN 'none' WHEN 'usable_probability' THEN bm ELSE 'raw' END AS selected_method, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS n_positive, round(rb, 6) + 0.0 AS raw_brier, round(re, 6) + 0.0 AS raw_ece,
  round(CASE status WHEN 'insufficient_sample' THEN NULL WHEN 'usable_probability' THEN bb ELSE rb END, 6) + 0.0 AS selected_brier FROM se""")
def method_selection(spark, sf_dir):
    summary = _choices(spark, sf_dir).select("*", F.lit(True).alias("monotone"), F.lit(None).cast("double").alias("spearman"))
    got = decisions.select_method(summary, ["label", "horizon"], {"min_gain": 0.0001})
    return rounded(got.select("label", "horizon", "status", "selected_method", "n", "n_positive", "raw_brier", "raw_ece", "selected_brier"))


@query(q.base(upto="segs") + METRICS_SQL + """,
fo AS (SELECT label, horizon, n, n_positive, n_negative, age_bucket, raw_brier, calibrated_brier, unnest(['identity', 'label_rate']) AS method, unnest([raw_brier, calibrated_brier]) AS b FROM ms),
sl AS (SELECT label, horizon, method, CASE WHEN label = 'flat' THEN 'diagnostic' ELSE 'eligible' END AS usage, count(*) AS n_folds, sum(n) AS n, sum(n_positive) AS p, sum(n_negative) AS m, min(n // 40) AS n_blocks, avg(abs(b - n_positive * n_negative * 1.0 / n / n)) AS ece, avg(b) AS brier, avg(raw_brier - b) AS keep FROM fo GROUP BY 1, 2, 3),
ct AS (SELECT *, n >= 500 AND p >= 10 AND round(ece, 9) <= 0.05 AND brier IS NOT NULL AS us FROM sl)
SELECT label, horizon, method, n_folds, CAST(n AS BIGINT) AS n, n_blocks, round(ece, 6) + 0.0 AS ece, round(brier, 6) + 0.0 AS brier,
  CASE WHEN usage != 'eligible' THEN 'research_only' WHEN n < 100 OR p < 3 OR m <= 0 THEN 'insufficient_data' WHEN method = 'identity' THEN 'baseline_only_candidate' WHEN us AND (n_blocks < 2 OR round(keep, 9) < 0) THEN 'ordinal_only_candidate' WHEN us THEN 'usable_probability_candidate' ELSE 'research_only' END AS category,
  CASE WHEN usage != 'eligible' THEN 'diagnostic_only_target_usage' WHEN n < 100 OR p < 3 OR m <= 0 THEN 'insufficient_evaluation_support' WHEN method = 'identity' THEN 'uncalibrated_reference_not_probability' WHEN us AND n_blocks < 2 THEN 'market_event_block_evidence_below_minimum'
    WHEN us AND round(keep, 9) < 0 THEN 'calibration_worsened_brier_score' WHEN us THEN 'development_calibration_gate_pass' ELSE 'calibration_diagnostics_not_ready' END AS reason FROM ct""")
def calibration_categories(spark, sf_dir):
    """Categories of slices whose folds are age buckets; flat states are diagnostic only."""
    m = _metrics(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), c(x).alias("brier")) for n, x in (("identity", "raw_brier"), ("label_rate", "calibrated_brier"))))).alias("m")
    folds = m.select("label", "horizon", "n", "n_positive", "n_negative", "raw_brier", each).select("*", "m.*")
    folds = folds.select(
        "label", "horizon", "method", F.when(c("label") == "flat", "diagnostic").otherwise("eligible").alias("usage"), "n", "n_positive", "n_negative", F.expr("n div 40").alias("n_blocks"),
        F.abs(c("brier") - c("n_positive") * c("n_negative") / c("n") / c("n")).alias("ece"), "brier", F.lit(None).cast("double").alias("auc"), (c("raw_brier") - c("brier")).alias("brier_retention"),
    )
    widths = folds.select("label", "horizon", "method", F.lit(None).cast("double").alias("width")).limit(0)
    got = decisions.calibration_categories(folds, widths, ["label", "horizon"])
    return rounded(got.select("label", "horizon", "method", "n_folds", "n", "n_blocks", "ece", "brier", "category", "reason"))


FIELDS = ["version", "config", "scope"]


@query("""WITH runs AS (SELECT s_suppkey AS run_id, s_suppkey % 97 AS version, s_nationkey * 40 + s_suppkey % 40 AS config, s_suppkey // 3 AS scope, 5 + s_suppkey % 4 AS expected_rows FROM supplier),
caches AS (SELECT c_custkey AS cache_key, CASE WHEN c_custkey % 60 = 7 THEN c_custkey // 60 END AS parent, DATE '2020-01-01' + CAST(c_custkey % 300 AS INTEGER) AS created_at, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 97 END AS version, c_nationkey * 40 + c_custkey % 40 AS config, CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 3 END AS scope,
  c_custkey % 11 AS n_rows, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS n_duplicates, CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS n_leaks, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 0 END AS n_missing FROM customer),
x AS (SELECT r.run_id, k.*, expected_rows, coalesce(CAST(r.version = k.version AS INTEGER), 0) + coalesce(CAST(r.config = k.config AS INTEGER), 0) + coalesce(CAST(r.scope = k.scope AS INTEGER), 0) AS m, coalesce(k.parent = r.run_id, false) AS native FROM runs r, caches k),
y AS (SELECT *, n_rows * 1.0 / expected_rows AS cov, list_filter([CASE WHEN m < 3 THEN 'strict_metadata_not_fully_matched' END, CASE WHEN n_rows * 1.0 / expected_rows < 0.999999 THEN 'coverage_incomplete' END, CASE WHEN n_duplicates > 0 THEN 'duplicate_cache_state_keys' END, CASE WHEN n_leaks > 0 THEN 'causal_boundary_violation' END, CASE WHEN n_missing > 0 THEN 'missing_cache_state_metadata' END], lambda e: e IS NOT NULL) AS f FROM x WHERE m > 0 OR native),
z AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, count(CASE WHEN native THEN 1 END) OVER (PARTITION BY run_id) AS nn, row_number() OVER (PARTITION BY run_id ORDER BY native DESC, m DESC, n_rows DESC, created_at DESC, cache_key DESC) AS k FROM y),
b AS (SELECT runs.run_id AS rid, z.*, CASE WHEN nn = 1 AND NOT list_contains(f, 'causal_boundary_violation') THEN 'native_link' WHEN nn > 1 THEN 'ambiguous' WHEN n = 1 AND len(f) = 0 THEN 'strict_inferred_link' WHEN n > 1 THEN 'ambiguous' WHEN list_contains(f, 'missing_cache_state_metadata') THEN 'requires_regeneration' WHEN n >= 1 THEN 'weak_inferred_candidate' ELSE 'not_linkable' END AS status FROM runs LEFT JOIN z ON z.run_id = runs.run_id AND z.k = 1)
SELECT rid AS run_id, cache_key, status, round(CASE status WHEN 'native_link' THEN 1.0 WHEN 'strict_inferred_link' THEN 0.95 WHEN 'ambiguous' THEN 0.2 WHEN 'weak_inferred_candidate' THEN least(0.65, 0.2 + 0.08 * m) ELSE 0.0 END, 6) AS confidence, coalesce(n, 0) AS n_candidates, CAST(coalesce(m, 0) AS BIGINT) AS n_matching, round(cov, 6) AS coverage,
  CASE WHEN status IN ('native_link', 'strict_inferred_link') THEN '' WHEN status = 'ambiguous' THEN array_to_string(list_prepend('multiple_candidates', f), ',') WHEN status = 'not_linkable' THEN 'no_candidate' ELSE array_to_string(f, ',') END AS reasons FROM b""")
def lineage_links(spark, sf_dir):
    """Suppliers as runs and customers as caches, with metadata by rule from their keys."""
    k = c("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select(k.alias("run_id"), (k % 97).alias("version"), (c("s_nationkey") * 40 + k % 40).alias("config"), F.floor(k / 3).alias("scope"), (5 + k % 4).alias("expected_rows"))
    k = c("c_custkey")
    flag = lambda n, v: F.when(k % n == 0, v).otherwise(0)
    caches = table(spark, sf_dir, "customer").select(
        k.alias("cache_key"), F.when(k % 60 == 7, F.floor(k / 60)).alias("parent_run_id"), F.date_add(F.lit("2020-01-01").cast("date"), (k % 300).cast("int")).alias("created_at"), F.when(k % 3 == 0, k % 97).alias("version"),
        (c("c_nationkey") * 40 + k % 40).alias("config"), F.when(k % 2 == 0, F.floor(k / 3)).alias("scope"), (k % 11).alias("n_rows"), flag(9, 1).alias("n_duplicates"), flag(17, 1).alias("n_leaks"), flag(7, 2).alias("n_missing"),
    )
    return rounded(decisions.link_lineage(runs, caches, FIELDS).withColumn("reasons", F.array_join("reasons", ",")))


SIGNATURE = ["n_share", "mean_ret", "mean_dwell"]


@query(q.base(upto="segs") + """, rr AS (SELECT runs.entity, label, segment, ret_20d, trade_date < DATE '1998-01-01' AS early FROM runs),
sg AS (SELECT entity AS pair, early, label, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY entity, early) AS n_share, avg(ret_20d) AS mean_ret, count(*) * 1.0 / count(DISTINCT segment) AS mean_dwell FROM rr GROUP BY 1, 2, 3),
di AS (SELECT a.pair, a.label AS x, b.label AS y, sqrt((power((a.n_share - b.n_share) / greatest(abs(a.n_share), abs(b.n_share), 1.0), 2) + power((a.mean_ret - b.mean_ret) / greatest(abs(a.mean_ret), abs(b.mean_ret), 1.0), 2) + power((ln(1 + a.mean_dwell) - ln(1 + b.mean_dwell)) / greatest(ln(1 + a.mean_dwell), ln(1 + b.mean_dwell), 1.0), 2)) / 3) AS d
  FROM sg a JOIN sg b ON a.pair = b.pair AND a.early AND NOT b.early),
pm AS (SELECT p.pair, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, r.x AS x3, r.y AS y3, p.d + q.d + r.d AS t FROM di p JOIN di q ON q.pair = p.pair AND q.x > p.x AND q.y != p.y JOIN di r ON r.pair = p.pair AND r.x > q.x AND r.y NOT IN (p.y, q.y)),
bp AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY pair ORDER BY t) = 1), mt AS (SELECT pair, unnest([x1, x2, x3]) AS x, unnest([y1, y2, y3]) AS y FROM bp),
rk AS (SELECT *, row_number() OVER (PARTITION BY pair, x ORDER BY d, y) AS k FROM di), sc AS (SELECT pair, x, d AS second FROM rk WHERE k = 2),
fi AS (SELECT di.*, second - di.d <= 0.05 AS amb FROM mt JOIN di ON di.pair = mt.pair AND di.x = mt.x AND di.y = mt.y LEFT JOIN sc ON sc.pair = mt.pair AND sc.x = mt.x)
SELECT pair, x AS base_state, y AS state, round(d, 6) + 0.0 AS distance, x = y AS label_kept, amb AS ambiguous, CASE WHEN amb THEN 'medium' WHEN x != y AND d <= 0.35 THEN 'high' WHEN x != y THEN 'medium' WHEN d <= 0.05 THEN 'none' WHEN d <= 0.2 THEN 'low' WHEN d <= 0.5 THEN 'medium' ELSE 'high' END AS severity FROM fi""")
def label_drift(spark, sf_dir):
    """Each entity's states before 1998 matched with those after, by share, mean return and dwell."""
    s = islands(_states(spark, sf_dir), "label").withColumn("early", c("trade_date") < "1998-01-01")
    n = s.groupBy(c("entity").alias("pair"), "early", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("ret_20d").alias("mean_ret"), F.countDistinct("segment").alias("runs"))
    sig = n.select("pair", "early", c("label").alias("state"), "label", (c("n") / F.sum("n").over(Window.partitionBy("pair", "early"))).alias("n_share"), "mean_ret", (c("n") / c("runs")).alias("mean_dwell"))
    d = alignment.distances(sig.where("early"), sig.where("not early"), SIGNATURE, ["mean_dwell"])
    return rounded(alignment.align(d).select("pair", "base_state", "state", "distance", "label_kept", "ambiguous", "severity"))


RANDOM_SQL = q.base("n_name") + """, ds AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, lead(trade_date) OVER (ORDER BY trade_date) AS exec_date FROM (SELECT DISTINCT trade_date FROM bars)),
rb AS (SELECT * FROM ds WHERE i % 60 = 0 AND exec_date IS NOT NULL), tr AS (SELECT unnest(generate_series(0, 39)) AS trial),
rk AS (SELECT trial, exec_date, entity, row_number() OVER (PARTITION BY trial, exec_date ORDER BY md5('42|' || trial || '|' || bars.trade_date || '|' || entity), entity) AS k FROM bars JOIN rb ON bars.trade_date = rb.trade_date, tr WHERE close IS NOT NULL),
ev AS (SELECT trial, exec_date, entity, 1.0 / count(*) OVER (PARTITION BY trial, exec_date) AS w FROM rk WHERE k <= 5),
od AS (SELECT exec_date, row_number() OVER (ORDER BY exec_date) AS j, lead(exec_date) OVER (ORDER BY exec_date) AS nx FROM (SELECT DISTINCT exec_date FROM ev)),
wc AS (SELECT trial, j, entity, w FROM ev JOIN od USING (exec_date) UNION ALL SELECT trial, j + 1, entity, -w FROM ev JOIN od USING (exec_date)),
tu AS (SELECT trial, od.exec_date, t FROM (SELECT trial, j, sum(abs(d)) AS t FROM (SELECT trial, j, entity, sum(w) AS d FROM wc GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN od USING (j)),
rt AS (SELECT entity, trade_date, coalesce(open / nullif(lag(close) OVER (PARTITION BY entity ORDER BY trade_date), 0) - 1, 0.0) AS g, coalesce(close / nullif(open, 0) - 1, 0.0) AS d FROM bars),
dy AS (SELECT d.trade_date, max(od.exec_date) OVER (ORDER BY d.trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS exec_date FROM ds d LEFT JOIN od ON od.exec_date = d.trade_date),
gr AS (SELECT trial, dy.trade_date, sum(w * g) AS night, sum(w * d) AS intra FROM dy JOIN ev ON ev.exec_date = dy.exec_date JOIN rt ON rt.entity = ev.entity AND rt.trade_date = dy.trade_date GROUP BY 1, 2),
cu AS (SELECT tr.trial, dy.trade_date, coalesce(t, 0.0) AS turnover, (1 + coalesce(night, 0.0)) * (1 + coalesce(intra, 0.0)) * (1 - coalesce(t, 0.0) * 0.001) - 1 AS net FROM dy CROSS JOIN tr LEFT JOIN gr ON gr.trial = tr.trial AND gr.trade_date = dy.trade_date LEFT JOIN tu ON tu.trial = tr.trial AND tu.exec_date = dy.trade_date WHERE dy.trade_date >= (SELECT min(exec_date) FROM od)),
nv AS (SELECT *, product(1 + net) OVER (PARTITION BY trial ORDER BY trade_date) AS nav FROM cu), dd AS (SELECT *, nav / nullif(max(nav) OVER (PARTITION BY trial ORDER BY trade_date), 0) - 1 AS fall FROM nv),
mt AS (SELECT trial, power(arg_max(nav, trade_date), 252.0 / count(*)) - 1 AS annual_return, min(fall) AS max_drawdown, avg(net) * sqrt(252) / nullif(stddev_pop(net), 0) AS sharpe, sum(turnover) AS turnover FROM dd GROUP BY 1),
lg AS (SELECT 'annual_return' AS metric, annual_return AS v FROM mt UNION ALL SELECT 'max_drawdown', max_drawdown FROM mt UNION ALL SELECT 'sharpe', sharpe FROM mt UNION ALL SELECT 'calmar', annual_return / nullif(-max_drawdown, 0) FROM mt UNION ALL SELECT 'turnover', turnover FROM mt)
SELECT metric, round(avg(v), 5) + 0.0 AS mean, round(quantile_cont(v, 0.5), 5) + 0.0 AS median, round(quantile_cont(v, 0.75), 5) + 0.0 AS p75, round(quantile_cont(v, 0.9), 5) + 0.0 AS p90, round(quantile_cont(v, 0.95), 5) + 0.0 AS p95 FROM lg WHERE v IS NOT NULL GROUP BY 1"""


@query(RANDOM_SQL)
def random_baseline(spark, sf_dir):
    """Metrics of 40 random portfolios of five nations, redrawn every 60 dates."""
    p = panel(spark, sf_dir, "n_name")
    curves = backtest.simulate_trials(p, backtest.random_events(p, 60, 5, 40), 0.001)
    return rounded(backtest.random_summary(backtest.trial_metrics(curves)), 5)


CUTOFF = "2000-12-31"


def _stored_targets(spark, sf_dir):
    """Stored targets with faults by rule: on some days of the month a value, a label, a weight or a date is off."""
    p = panel(spark, sf_dir)
    known = target_audit.truth(p, [5, 10], F.lit(CUTOFF).cast("date"))
    rows = known.select("entity", "trade_date", "horizon", F.explode(F.array(F.lit(0.1), F.lit(0.3))).alias("threshold"), "t_start", "t_end", "t_status", *(f"t_{v}" for v in target_audit.VALUES))
    day = F.dayofmonth("trade_date")
    ok = c("t_status") == "labeled"
    event = F.when(ok, c("t_future_mae") <= -c("threshold"))
    stored = rows.select(
        "entity", "trade_date", "horizon", F.when(day == 3, 0.2).otherwise(c("threshold")).alias("threshold"), F.when(day == 4, "other").otherwise("eligible").alias("usage"), F.when(day == 5, "unknown").when(day == 6, "cross_cutoff").otherwise(c("t_status")).alias("status"),
        F.when(day == 7, c("trade_date")).otherwise(c("t_start")).alias("start_date"), F.when(day == 8, F.date_add("t_end", 1)).otherwise(c("t_end")).alias("end_date"), F.when((day == 9) & ok, F.lit(None)).when(day == 10, True).otherwise(event).alias("event"),
        F.when(day == 11, 1.0).when(day == 12, 0.0).otherwise(ok.cast("double")).alias("weight"), F.when(day == 13, c("t_future_mae") + 0.01).otherwise(c("t_future_mae")).alias("future_mae"), "t_future_mdd", F.when(day == 14, F.lit(None)).otherwise(c("t_future_return")).alias("future_return"),
    ).withColumnRenamed("t_future_mdd", "future_mdd")
    return known, stored


def audit_of(spark, known):
    """The audit of a batch of stored targets: counters."""
    slices = spark.createDataFrame([(h, t) for h in (5, 10) for t in (0.1, 0.3)], "horizon bigint, threshold double")
    breaks = spark.createDataFrame([("ASIA",)], "entity string")
    return lambda batch: target_audit.counters(target_audit.broken_rules(batch, known, slices, breaks, F.lit(CUTOFF).cast("date")))


@query(q.base() + """, g AS (SELECT entity, trade_date, h AS horizon, th AS threshold, lead(trade_date) OVER w AS s, CASE h WHEN 5 THEN lead(trade_date, 5) OVER w ELSE lead(trade_date, 10) OVER w END AS e,
    CASE h WHEN 5 THEN min(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) ELSE min(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) END / close - 1 AS mae
  FROM bars, (SELECT unnest([5, 10]) AS h), (SELECT unnest([0.1, 0.3]) AS th) WINDOW w AS (PARTITION BY entity, h, th ORDER BY trade_date)),
t AS (SELECT *, day(trade_date) AS d, e IS NOT NULL AND e <= DATE '2000-12-31' AS ok, CASE WHEN e IS NULL THEN 'insufficient_future' WHEN e > DATE '2000-12-31' THEN 'cross_cutoff' ELSE 'labeled' END AS ts FROM g),
f AS (SELECT *, CASE d WHEN 5 THEN 'unknown' WHEN 6 THEN 'cross_cutoff' ELSE ts END AS st, CASE WHEN d = 10 THEN TRUE WHEN d != 9 AND ok THEN mae <= -threshold END AS ev, CASE d WHEN 11 THEN 1.0 WHEN 12 THEN 0.0 ELSE CAST(ok AS INTEGER) END AS w FROM t),
b AS (SELECT entity, st, ts, list_filter([CASE WHEN entity = 'ASIA' THEN 'silent_break_entity' END, CASE WHEN d = 3 THEN 'unknown_slice' END, CASE WHEN d = 4 THEN 'unknown_usage' END, CASE WHEN d = 5 THEN 'unknown_status' END, CASE WHEN d = 6 AND ts != 'cross_cutoff' THEN 'wrong_status' END,
  CASE WHEN d = 7 THEN 'starts_too_early' END, CASE WHEN st = 'labeled' AND d = 8 AND e + 1 > DATE '2000-12-31' THEN 'labeled_past_cutoff' END, CASE WHEN st = 'labeled' AND d = 7 THEN 'wrong_start' END, CASE WHEN st = 'labeled' AND d = 8 THEN 'wrong_end' END, CASE WHEN st = 'labeled' AND ev IS NULL THEN 'label_missing' END,
  CASE WHEN st != 'labeled' AND ev IS NOT NULL THEN 'label_not_allowed' END, CASE WHEN st = 'labeled' AND ev != (mae <= -(CASE WHEN d = 3 THEN 0.2 ELSE threshold END)) THEN 'wrong_label' END, CASE WHEN st = 'labeled' AND w <= 0 THEN 'weight_missing' END, CASE WHEN st != 'labeled' AND w > 0 THEN 'weight_not_allowed' END,
  CASE WHEN st = 'labeled' AND d = 13 THEN 'wrong_future_mae' END, CASE WHEN st = 'labeled' AND d = 14 THEN 'wrong_future_return' END], lambda x: x IS NOT NULL) AS broken, d FROM f),
k AS (SELECT unnest(broken) AS "check", 1 AS n, CAST(NULL AS DOUBLE) AS worst FROM b UNION ALL SELECT 'rows', 1, NULL FROM b UNION ALL SELECT 'broken_rows', CAST(len(broken) > 0 AS INTEGER), NULL FROM b
  UNION ALL SELECT 'error_future_mae', CAST(st = 'labeled' AND ts != 'insufficient_future' AS INTEGER), CASE WHEN st = 'labeled' AND ts != 'insufficient_future' THEN CASE WHEN d = 13 THEN 0.01 ELSE 0.0 END END FROM b
  UNION ALL SELECT 'error_future_mdd', CAST(st = 'labeled' AND ts != 'insufficient_future' AS INTEGER), CASE WHEN st = 'labeled' AND ts != 'insufficient_future' THEN 0.0 END FROM b
  UNION ALL SELECT 'error_future_return', CAST(st = 'labeled' AND ts != 'insufficient_future' AND d != 14 AS INTEGER), CASE WHEN st = 'labeled' AND ts != 'insufficient_future' AND d != 14 THEN 0.0 END FROM b)
SELECT "check", CAST(sum(n) AS BIGINT) AS n, round(max(worst), 6) + 0.0 AS worst FROM k GROUP BY 1""")
def full_target_audit(spark, sf_dir):
    """Every stored target made again and compared; faults are planted by rule, and ASIA may not be used."""
    known, stored = _stored_targets(spark, sf_dir)
    return rounded(audit_of(spark, known)(stored))
