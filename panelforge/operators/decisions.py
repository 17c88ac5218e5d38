"""Decisions by rule tables: ordered rules of which the first that holds counts, and checks whose failures are reasons.

A rule is SQL text over a subject's columns with the outcome that it gives; so a table of rules is data, can be printed, and
is evaluated for all subjects in one pass. A condition that is null doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: (condition, outcome by column); the last condition is usually "true".
Rules = list[tuple[str, dict[str, object]]]


def first_match(rules: Rules, column: str) -> Column:
    """The value that the first rule that holds gives a column; null if none holds."""
    out = F.when(F.lit(False), F.lit(None))
    for condition, outcome in rules:
        out = out.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(outcome.get(column)))
    return out


def decide(subjects: DataFrame, rules: Rules) -> DataFrame:
    """subjects with the outcome columns of the first rule that holds, and its number from 1 (rule)."""
    names = list(dict.fromkeys(x for _, outcome in rules for x in outcome))
    numbered = [(condition, {"rule": i}) for i, (condition, _) in enumerate(rules, 1)]
    return subjects.select("*", *(first_match(rules, x).alias(x) for x in names), first_match(numbered, "rule").cast("int").alias("rule"))


def reasons(checks: list[tuple[str, str]]) -> Column:
    """The reasons whose conditions hold, in order, each once."""
    said = F.array(*(F.when(F.coalesce(F.expr(condition), F.lit(False)), reason) for condition, reason in checks))
    return F.array_distinct(F.filter(said, lambda x: x.isNotNull()))


# readiness of a run from five kinds of evidence

INPUTS = ["confidence", "label_alignment", "churn_dwell", "causal_cache", "ci_validation"]
_ABSENT = " or ".join(f"coalesce({x}_availability, 'missing') in ('missing', 'unavailable')" for x in INPUTS)
_HARD = "arrays_overlap(reasons, array('causal_cache_leakage_violation', 'causal_cache_exec_date_violation', 'evidence_boundary_violation'))"
_SOFT = "arrays_overlap(reasons, array('causal_cache_not_linked_to_resolved_run_id', 'causal_cache_coverage_partial', 'label_alignment_ambiguity_high', 'ci_validation_no_private_db_not_db_backed'))"
READINESS_REASONS = [
    ("not db_found", "local_db_missing"),
    ("not run_id_resolved", "run_id_unresolved"),
]
READINESS_LATE_REASONS = [
    ("confidence_readiness in ('blocked', 'research_only', 'partial')", "confidence_not_strong_enough_for_validated_readiness"),
    ("label_alignment_readiness in ('blocked', 'research_only', 'partial')", "label_identity_not_strong_enough_for_validated_readiness"),
    ("churn_dwell_readiness in ('blocked', 'research_only')", "churn_dwell_gate_keeps_display_research_only"),
]


def _outcome(status: str, readiness: str, evidence: str, display: str) -> dict[str, object]:
    return {"status": status, "readiness_status": readiness, "evidence_level": evidence, "display_action": display}


READINESS: Rules = [
    (f"{_HARD} and churn_bucket = 'excessive'", _outcome("fail", "research_only", "exploratory", "hide_strategy")),
    (_HARD, _outcome("fail", "blocked", "exploratory", "blocked")),
    (f"(not db_found or not run_id_resolved or {_ABSENT}) and churn_bucket = 'excessive'", _outcome("partial", "research_only", "exploratory", "hide_strategy")),
    ("not db_found or not run_id_resolved", _outcome("partial", "blocked", "exploratory", "blocked")),
    (_ABSENT, _outcome("partial", "research_only", "exploratory", "research_only")),
    ("churn_bucket = 'excessive'", _outcome("pass", "research_only", "exploratory", "hide_strategy")),
    (f"coalesce(causal_cache_status, '') != 'pass' or {_SOFT}", _outcome("pass", "research_only", "exploratory", "research_only")),
    ("true", _outcome("pass", "partial", "internal_diagnostic", "warn")),
]


def readiness(evidence: DataFrame) -> DataFrame:
    """Readiness of each run from its evidence: db_found, run_id_resolved, churn_bucket, causal_cache_status, and for each of
    INPUTS <input>_availability, <input>_readiness and <input>_reasons (array).

    Adds reasons, absent (inputs that aren't there) and the outcome of READINESS.
    """
    given = F.flatten(F.array(*(F.coalesce(c(f"{x}_reasons"), F.array().cast("array<string>")) for x in INPUTS)))
    every = F.array_distinct(F.concat(reasons(READINESS_REASONS), given, reasons(READINESS_LATE_REASONS)))
    absent = reasons([(f"coalesce({x}_availability, 'missing') in ('missing', 'unavailable')", x) for x in INPUTS])
    return decide(evidence.withColumn("reasons", every).withColumn("absent", absent), READINESS)


# what a hazard's probabilities may be used for

_STRONGER = "(calibrated_brier is null or calibration_status = 'degraded_brier_worse' or calibrated_brier > baseline_brier)"
HAZARD: Rules = [
    ("missing_calibration and baseline_valid", {"readiness": "baseline_only", "reason": "missing_horizon_evidence"}),
    ("missing_calibration", {"readiness": "insufficient_sample", "reason": "missing_horizon_evidence"}),
    ("n < least", {"readiness": "insufficient_sample", "reason": "sample_below_minimum"}),
    ("n_positive <= 0 or n_negative <= 0", {"readiness": "insufficient_sample", "reason": "one_class_only"}),
    ("calibration_status = 'calibration_candidate' and calibrated_brier <= raw_brier and (baseline_brier is null or calibrated_brier <= baseline_brier)", {"readiness": "usable_probability", "reason": None}),
    (f"baseline_valid and {_STRONGER} and calibrated_brier is null", {"readiness": "baseline_only", "reason": "calibration_unavailable"}),
    (f"baseline_valid and {_STRONGER}", {"readiness": "baseline_only", "reason": "baseline_stronger"}),
    ("n > 0 and calibration_status = 'degraded_brier_worse'", {"readiness": "ordinal_only", "reason": "calibrated_brier_worse_than_raw"}),
    ("n > 0", {"readiness": "ordinal_only", "reason": "support_not_strong_enough"}),
    ("true", {"readiness": "insufficient_sample", "reason": "no_usable_support"}),
]


def hazard_readiness(metrics: DataFrame, least: int) -> DataFrame:
    """metrics (n, n_positive, n_negative, raw_brier, calibrated_brier, baseline_brier, calibration_status, baseline_valid,
    missing_calibration) with readiness, reason and rule of HAZARD."""
    return decide(metrics.withColumn("least", F.lit(least)), HAZARD).drop("least")


# which method's probability is used for a group

SELECTION: Rules = [
    ("n < {min_rows} or n_positive < {min_positive}", {"status": "insufficient_sample", "selected": "none"}),
    ("best_method is not null and best_brier <= raw_brier - {min_gain} and best_ece <= greatest(raw_ece, {max_ece}) and best_mce <= {max_mce} and best_monotone", {"status": "usable_probability", "selected": "best"}),
    ("raw_monotone and raw_ece <= {max_ece} and raw_mce <= {max_mce}", {"status": "raw_only", "selected": "raw"}),
    ("raw_monotone or raw_spearman >= 0.3", {"status": "ordinal_only", "selected": "raw"}),
    ("true", {"status": "invalid", "selected": "none"}),
]
LIMITS = {"min_rows": 1000, "min_positive": 100, "min_gain": 0.005, "max_ece": 0.05, "max_mce": 0.15}


def select_method(summary: DataFrame, by: list[str], limits: dict[str, float] | None = None) -> DataFrame:
    """(by..., status, selected_method, n, n_positive, raw_*, selected_*) from a row a method (raw and others) with n,
    n_positive, brier, ece, mce, monotone, spearman.

    Of the calibrated methods the best Brier score, then expected error, then name is compared with raw. Groups without
    raw have no row.
    """
    values = F.struct("brier", "ece", "mce", "monotone", "spearman")
    raw = summary.where("method = 'raw'").groupBy(*by).agg(F.max("n").alias("n"), F.max("n_positive").alias("n_positive"), F.first(values).alias("raw"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("brier", "ece", "method")) == 1
    best = summary.where("method != 'raw' and brier is not null").withColumn("_k", first).where("_k").select(*by, c("method").alias("best_method"), values.alias("best"))
    flat = raw.join(best, by, "left").select(*by, "n", "n_positive", "best_method", *(c(f"{g}.{x}").alias(f"{g}_{x}") for g in ("raw", "best") for x in ("brier", "ece", "mce", "monotone", "spearman")))
    limits = LIMITS | (limits or {})
    got = decide(flat, [(condition.format(**limits), outcome) for condition, outcome in SELECTION])
    pick = lambda x: F.when(c("selected") == "best", c(f"best_{x}")).when(c("selected") == "raw", c(f"raw_{x}"))
    method = F.when(c("selected") == "best", c("best_method")).otherwise(c("selected"))
    return got.select(*by, "status", method.alias("selected_method"), "n", "n_positive", "raw_brier", "raw_ece", "raw_mce", *(pick(x).alias(f"selected_{x}") for x in ("brier", "ece", "mce")), F.coalesce(pick("monotone"), F.lit(False)).alias("monotone"))


# how far a calibrated slice has come

_USABLE = "n >= 500 and n_positive >= 10 and ece <= 0.05 and (width is null or width <= 0.25) and brier is not null"
CATEGORIES: Rules = [
    ("coalesce(usage, '') != 'eligible'", {"category": "research_only", "reason": "diagnostic_only_target_usage"}),
    ("n < 100 or n_positive < 3 or n_negative <= 0", {"category": "insufficient_data", "reason": "insufficient_evaluation_support"}),
    ("method = 'identity'", {"category": "baseline_only_candidate", "reason": "uncalibrated_reference_not_probability"}),
    (f"{_USABLE} and n_blocks < 2", {"category": "ordinal_only_candidate", "reason": "market_event_block_evidence_below_minimum"}),
    (f"{_USABLE} and brier_retention < 0", {"category": "ordinal_only_candidate", "reason": "calibration_worsened_brier_score"}),
    (_USABLE, {"category": "usable_probability_candidate", "reason": "development_calibration_gate_pass"}),
    ("n >= 100 and n_positive >= 3 and auc >= 0.55", {"category": "ordinal_only_candidate", "reason": "ranking_retained_but_probability_gate_not_met"}),
    ("true", {"category": "research_only", "reason": "calibration_diagnostics_not_ready"}),
]


def calibration_categories(folds: DataFrame, widths: DataFrame, by: list[str]) -> DataFrame:
    """Folds (by..., method, usage, n, n_positive, n_negative, n_blocks, ece, brier, auc, brier_retention) put together by
    slice and method: counts summed, metrics averaged, blocks at their least; with the category of CATEGORIES.

    widths (by..., method, width) has the widths of clustered confidence intervals; a slice may have none.
    """
    keys = [*by, "method", "usage"]
    total = folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), *(F.sum(x).alias(x) for x in ("n", "n_positive", "n_negative")), F.coalesce(F.min("n_blocks"), F.lit(0)).alias("n_blocks"), *(F.avg(x).alias(x) for x in ("ece", "brier", "auc", "brier_retention")),
    )
    return decide(total.join(widths, [*by, "method"], "left"), CATEGORIES)


# which cache belongs to a run


def link_lineage(runs: DataFrame, caches: DataFrame, fields: list[str]) -> DataFrame:
    """The cache that best fits each run by equal metadata fields; ties and rivals are reported, not settled.

    runs: (run_id, fields..., expected_rows). caches: (cache_key, parent_run_id, created_at, fields..., n_rows, n_duplicates,
    n_leaks, n_missing). A cache that names the run as its parent is a native link. Others are candidates if they share a
    field with the run; one that matches all fields, covers the expected rows and has no fault is a strict link if it is
    the only candidate. Keys are unique; a null matches nothing.

    No pair of run and cache is made but native links (one a cache). Caches are counted, and the best is kept, by each set of
    fields and its values; a run meets the row of each of its sets. Its candidates are the sum over its sets, those of
    an even number of fields taken off (inclusion and exclusion), its best cache is that of the largest set that has one.
    Rows grow by 2^fields of a distinct combination of values, not by the runs that share a value.

    Returns (run_id, cache_key, status, confidence, n_candidates, n_matching, coverage, reasons).
    """
    texts = F.array(*(c(x).cast("string") for x in fields)).alias("texts")
    known = F.aggregate(F.transform("texts", lambda x, i: F.when(x.isNotNull(), F.pow(F.lit(2), i).cast("int")).otherwise(0)), F.lit(0), lambda s, v: s + v)
    masks = F.explode(F.filter(F.sequence(F.lit(1), F.lit(2 ** len(fields) - 1)), lambda m: m.bitwiseAND(known) == m)).alias("mask")
    values = F.filter("texts", lambda x, i: F.getbit("mask", i) == 1).alias("values")
    in_sets = lambda df, *keep: df.select("texts", *keep, masks).select(*keep, "mask", values)
    size = F.bit_count("mask")
    rank = F.struct("n_rows", "created_at", "cache_key", "n_duplicates", "n_leaks", "n_missing")  # the order of preference, then what follows from the key
    plain = caches.where("cache_key is not null").select("parent_run_id", texts, rank.alias("best"))
    alike = plain.groupBy("texts").agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("best"))
    by_set = in_sets(alike, "n", "best").groupBy("mask", "values").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    asked = runs.select("run_id", "expected_rows", texts)
    met = in_sets(asked, "run_id").join(by_set, ["mask", "values"]).groupBy("run_id").agg(
        F.sum(F.when(size % 2 == 1, c("n")).otherwise(-c("n"))).alias("n_met"), F.max(F.struct(size.alias("n_matching"), "best")).alias("met"),
    )
    equal = F.size(F.filter(F.zip_with("texts", "run_texts", lambda x, y: x == y), lambda same: same))
    linked = plain.join(asked.select("run_id", c("texts").alias("run_texts")), c("parent_run_id") == c("run_id")).select("run_id", equal.alias("n_matching"), "best")
    native = linked.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_native"), F.count_if(c("n_matching") == 0).alias("n_apart"), F.max(F.struct("n_matching", "best")).alias("own"))
    both = asked.drop("texts").join(met, "run_id", "left").join(native, "run_id", "left").withColumn("top", F.coalesce("own", "met"))
    full = both.select("run_id", "expected_rows", (F.coalesce("n_met", F.lit(0)) + F.coalesce("n_apart", F.lit(0))).alias("n_candidates"), F.coalesce("n_native", F.lit(0)).alias("n_native"), "top.n_matching", "top.best.*")
    full = full.withColumn("coverage", F.try_divide(c("n_rows").cast("double"), c("expected_rows")))
    faults = reasons([
        (f"n_matching < {len(fields)}", "strict_metadata_not_fully_matched"), ("coverage is null", "coverage_unknown"), ("coverage < 0.999999", "coverage_incomplete"),
        ("n_duplicates > 0", "duplicate_cache_state_keys"), ("n_leaks > 0", "causal_boundary_violation"), ("n_missing > 0", "missing_cache_state_metadata"),
    ])
    judged = full.withColumn("faults", F.when(c("cache_key").isNotNull(), faults))
    rules: Rules = [
        ("n_native = 1 and not exists(faults, f -> f = 'causal_boundary_violation')", {"status": "native_link", "confidence": 1.0}),
        ("n_native > 1", {"status": "ambiguous", "confidence": 0.2}),
        ("n_candidates = 1 and size(faults) = 0", {"status": "strict_inferred_link", "confidence": 0.95}),
        ("n_candidates > 1", {"status": "ambiguous", "confidence": 0.2}),
        ("array_contains(faults, 'missing_cache_state_metadata')", {"status": "requires_regeneration", "confidence": 0.0}),
        ("n_matching > 0 or n_native > 0", {"status": "weak_inferred_candidate", "confidence": None}),
        ("true", {"status": "not_linkable", "confidence": 0.0}),
    ]
    got = decide(judged, rules)
    weak = F.least(F.lit(0.65), 0.2 + 0.08 * c("n_matching"))
    none = F.array().cast("array<string>")
    why = F.when(c("status").isin("native_link", "strict_inferred_link"), none).when(c("status") == "ambiguous", F.concat(F.array(F.lit("multiple_candidates")), "faults")).when(c("status") == "not_linkable", F.array(F.lit("no_candidate"))).otherwise(c("faults"))
    return got.select(
        "run_id", "cache_key", "status", F.coalesce(c("confidence").cast("double"), weak).alias("confidence"), F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"),
        F.coalesce("n_matching", F.lit(0)).cast("bigint").alias("n_matching"), "coverage", F.coalesce(why, none).alias("reasons"),
    )
