"""Runs of equal states: segments, dwell times, transitions, durations and exits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.panel import in_time, islands, ratio

c = F.col


def state_segments(states: DataFrame) -> DataFrame:
    """Segments of (entity, trade_date, label, close): span, length, return and largest fall inside."""
    rows = islands(states, "label")
    peak = F.max("close").over(in_time("entity", "segment").rowsBetween(Window.unboundedPreceding, 0))
    seg = rows.withColumn("_dd", ratio(c("close"), peak) - 1).groupBy("entity", "segment").agg(
        F.min_by("label", "trade_date").alias("label"), F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"),
        F.count(F.lit(1)).alias("n_days"), F.min_by("close", "trade_date").alias("_a"), F.max_by("close", "trade_date").alias("_b"), F.min("_dd").alias("max_drawdown"),
    )
    w = in_time("entity", order="segment")
    return seg.select(
        "entity", "segment", "label", "start_date", "end_date", "n_days", (F.date_diff("end_date", "start_date") + 1).cast("bigint").alias("calendar_days"),
        (ratio(c("_b"), c("_a")) - 1).alias("segment_return"), "max_drawdown",
        F.lag("label").over(w).alias("prev_label"), F.lead("label").over(w).alias("next_label"), F.lag("n_days").over(w).alias("prev_days"),
    )


def transition_screen(segments: DataFrame, to_label: str, max_days: int, min_prev_days: int) -> DataFrame:
    """Entities whose last segment is to_label, young, and follows a long enough other one."""
    last = segments.groupBy("entity").agg(F.max("segment").alias("segment"))
    hit = segments.join(last, ["entity", "segment"], "left_semi")
    hit = hit.where((c("label") == to_label) & (c("n_days") <= max_days) & (F.coalesce("prev_days", F.lit(0)) >= min_prev_days))
    return hit.select("entity", c("start_date").alias("switch_date"), c("prev_label").alias("from_label"), c("label").alias("to_label"), "n_days", "prev_days")


def transition_matrix(states: DataFrame) -> DataFrame:
    """(from_label, to_label, n, share): day-to-day changes, shares of each from_label."""
    pairs = states.select(c("label").alias("from_label"), F.lead("label").over(in_time()).alias("to_label")).where("to_label is not null")
    n = pairs.groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("from_label")))


def churn(segments: DataFrame) -> DataFrame:
    """Dwell statistics and transition rate per entity, with a bucket."""
    p = lambda q: F.percentile("n_days", F.lit(q))
    s = segments.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("n_days").alias("_days"), F.avg("n_days").alias("dwell_mean"), p(0.5).alias("dwell_median"),
        p(0.1).alias("dwell_p10"), p(0.9).alias("dwell_p90"), F.avg((c("n_days") == 1).cast("double")).alias("single_day_share"),
    )
    rate = ratio((c("n_segments") - 1).cast("double"), c("_days") - 1)
    bucket = F.when(c("transition_rate") >= 0.3, "excessive").when(c("transition_rate") >= 0.15, "high").when(c("transition_rate") >= 0.05, "normal").otherwise("sticky")
    return s.withColumn("transition_rate", rate).withColumn("bucket", bucket).drop("_days")


def duration_profile(segments: DataFrame) -> DataFrame:
    """Durations per label and over all (``__ALL__``), without segments cut off at either end."""
    rows = segments.withColumn("_cut", c("prev_label").isNull() | c("next_label").isNull())
    whole = F.when(~c("_cut"), c("n_days"))
    out = rows.rollup("label").agg(
        F.grouping("label").alias("_all"), F.count(F.lit(1)).alias("n_episodes"), F.count_if(c("_cut")).alias("n_censored"),
        F.avg(whole).alias("mean_days"), F.percentile(whole, F.lit(0.5)).alias("median_days"), F.max(whole).alias("max_days"),
    )
    return out.withColumn("label", F.when(c("_all") == 1, "__ALL__").otherwise(c("label"))).withColumn("censored_share", c("n_censored") / c("n_episodes")).drop("_all")


def exit_targets(states: DataFrame, horizons: list[int]) -> DataFrame:
    """Does the state end within h rows? True on an observed exit, null if neither it nor h rows were seen."""
    rows = islands(states, "label")
    w, s = in_time(), Window.partitionBy("entity", "segment")
    rows = rows.withColumn("_pos", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("entity")))
    rows = rows.withColumn("_end", F.max("_pos").over(s))
    lag = F.when(c("_end") < c("_n"), c("_end") + 1 - c("_pos"))
    rows = rows.withColumn("exit_lag", lag.cast("bigint"))
    hit = lambda h: F.when(c("exit_lag") <= h, True).when(c("_pos") + h <= c("_n"), False)
    return rows.select("entity", "trade_date", "label", "exit_lag", *(hit(h).alias(f"exit_{h}") for h in horizons))


def calibration_table(df: DataFrame, p: str, hit: str, bins: int = 5) -> DataFrame:
    """Per label and probability bin: mean probability, realised share, Brier score and error."""
    b = F.least(F.floor(c(p) * bins), F.lit(bins - 1))
    y = c(hit).cast("double")
    t = df.where(c(p).isNotNull() & c(hit).isNotNull()).groupBy("label", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("realised"), F.avg((c(p) - y) * (c(p) - y)).alias("brier"),
    )
    return t.withColumn("error", c("mean_p") - c("realised"))


def posterior_confidence(df: DataFrame, probabilities: list[str]) -> DataFrame:
    """Largest and second probability, margin, entropy (natural and of its maximum) and a bucket."""
    import math

    ps = F.sort_array(F.array(*probabilities), asc=False)
    entropy = sum((F.when(c(p) > 0, -c(p) * F.log(c(p))).otherwise(0.0) for p in probabilities), F.lit(0.0))
    out = df.withColumn("top", ps[0]).withColumn("margin", ps[0] - ps[1]).withColumn("entropy", entropy)
    out = out.withColumn("normalised_entropy", c("entropy") / math.log(len(probabilities)))
    bucket = F.when((c("top") >= 0.7) & (c("margin") >= 0.4), "high").when((c("top") >= 0.5) & (c("margin") >= 0.15), "medium").otherwise("low")
    return out.withColumn("confidence", bucket)


def next_state_profile(segments: DataFrame, least: int = 1) -> DataFrame:
    """Where finished segments of a label lead: the most frequent next label and its share."""
    n = segments.where("next_label is not null").groupBy("label", "next_label").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("label").agg(F.sum("n").alias("n"), F.max(F.struct(c("n"), c("next_label"))).alias("_t"))
    share = ratio(c("_t.n").cast("double"), c("n"))
    tendency = F.when(c("n") < least, "insufficient").when(share >= 0.45, "strong").when(share >= 0.35, "weak").otherwise("open")
    return top.select("label", "n", c("_t.next_label").alias("top_label"), share.alias("top_share"), tendency.alias("tendency"))


def state_signatures(states: DataFrame, value: str) -> DataFrame:
    """Per label: share of rows, share of rows after which it ends, and median and mean of a value."""
    nxt = F.lead("label").over(in_time())
    rows = states.withColumn("_out", F.when(nxt.isNotNull(), (nxt != c("label")).cast("double")))
    s = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("_out").alias("exit_share"), F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"))
    return s.withColumn("occupancy", c("n") / F.sum("n").over(Window.partitionBy()))


def transition_validation(segments: DataFrame, split: float = 0.6) -> DataFrame:
    """How often the next label of later segments is the most frequent one of earlier segments.

    The cut is a share of the distinct end dates, which are few; the learned table has one row per label.
    """
    done = segments.where("next_label is not null")
    w = Window.orderBy("end_date")
    days = done.select("end_date").distinct()
    days = days.select("end_date", (F.row_number().over(w) <= F.count(F.lit(1)).over(Window.partitionBy()) * split).alias("early"))
    rows = done.join(days, "end_date")
    counts = rows.where("early").groupBy("label", "next_label").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("label").agg(F.max(F.struct("n", "next_label")).alias("_t")).select("label", c("_t.next_label").alias("predicted"))
    late = rows.where("not early").join(mode, "label", "left")
    return late.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(c("predicted") == c("next_label"), F.lit(False)).cast("double")).alias("accuracy"))


def exit_dataset(states: DataFrame, horizons: list[int], cutoff: str | None = None) -> DataFrame:
    """A row per state row and horizon: does the label change within so many rows, as far as is observed?

    An exit is the next row with another label that isn't null; rows without a label count as time. What
    lies after the cutoff (the last date of all, if none is given) isn't observed. Status is positive,
    negative, censored_by_cutoff, censored_by_run_end or missing_state; only the first two have weight.
    """
    w, back = in_time(), Window.partitionBy("entity").orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("label", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = states.select("entity", "trade_date", "label", F.row_number().over(w).alias("_pos"), F.max("trade_date").over(Window.partitionBy("entity")).alias("_run_end"), before.alias("_before"))
    mark = F.when(c("label") != c("_before"), F.struct("_pos", "trade_date", "label"))
    rows = rows.withColumn("_exit", F.when(c("label").isNotNull(), F.last(mark, ignorenulls=True).over(back)))
    if cutoff is None:
        rows = rows.crossJoin(F.broadcast(states.agg(F.max("trade_date").alias("_cutoff"))))  # one row
    else:
        rows = rows.withColumn("_cutoff", F.lit(cutoff).cast("date"))

    def target(h: int):
        end = F.lead("trade_date", h).over(w)
        seen = F.least(F.coalesce(end, c("_run_end")), c("_cutoff"))
        cut = c("_cutoff") < F.coalesce(end, c("_run_end"))
        hit = F.coalesce((c("_exit._pos") - c("_pos") <= h) & (c("_exit.trade_date") <= seen), F.lit(False))
        status = F.when(c("label").isNull(), "missing_state").when(hit, "positive").when(end.isNotNull() & ~cut, "negative").when(cut, "censored_by_cutoff").otherwise("censored_by_run_end")
        return F.struct(F.lit(h).cast("bigint").alias("horizon"), status.alias("status"), F.when(c("label").isNull(), c("trade_date")).otherwise(seen).alias("observed_until"))

    rows = rows.select("entity", "trade_date", "label", c("_exit.label").alias("next_label"), c("_exit.trade_date").alias("exit_date"), F.array(*map(target, horizons)).alias("_t"))
    rows = rows.withColumn("_t", F.explode("_t")).select("entity", "trade_date", "label", "next_label", "exit_date", "_t.*")
    value = F.when(c("status") == "positive", 1).when(c("status") == "negative", 0).cast("bigint")
    return rows.withColumn("exit_within", value).withColumn("weight", F.when(value.isNotNull(), 1.0).otherwise(0.0))


def age_stability(states: DataFrame, most: float = 0.05) -> DataFrame:
    """Falls of (entity, trade_date, label, checkpoint, age) within one label, per entity and over all (``__ALL__``)."""
    w = in_time()
    same = F.coalesce(c("label") == F.lag("label").over(w), F.lit(False))
    moved = F.coalesce(c("checkpoint") != F.lag("checkpoint").over(w), F.lit(False))
    rows = states.select("entity", "age", same.alias("_same"), moved.alias("_moved"), F.coalesce(F.lag("age").over(w) - c("age"), F.lit(0)).alias("_fall"))
    fell = c("_same") & (c("_fall") > 0)
    out = rows.rollup("entity").agg(
        F.grouping("entity").alias("_all"), F.count_if(c("_same")).alias("n_pairs"), F.count_if(fell).alias("n_resets"),
        F.count_if(c("_same") & c("_moved")).alias("n_boundary_pairs"), F.count_if(fell & c("_moved")).alias("n_boundary_resets"), F.max("age").alias("max_age"),
    )
    rate = lambda a, b: F.coalesce(ratio(c(a).cast("double"), c(b)), F.lit(0.0))
    out = out.withColumn("reset_rate", rate("n_resets", "n_pairs")).withColumn("boundary_reset_rate", rate("n_boundary_resets", "n_boundary_pairs"))
    out = out.withColumn("passed", (c("reset_rate") <= most) & (c("boundary_reset_rate") <= most))
    return out.withColumn("entity", F.when(c("_all") == 1, "__ALL__").otherwise(c("entity"))).drop("_all")


def state_phases(states: DataFrame, least: int = 3) -> DataFrame:
    """Age of each row in its state, and its phase by the 33rd and 66th percentile of the label's whole durations.

    Durations are those of segments with both ends seen; a label with fewer than least has no phase
    (unknown). The profile has a row per label.
    """
    rows = islands(states, "label").withColumn("age", F.row_number().over(in_time("entity", "segment")).cast("bigint"))
    per = rows.groupBy("entity", "segment").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("_d"))
    whole = per.withColumn("_last", F.max("segment").over(Window.partitionBy("entity"))).where("segment > 1 and segment < _last")
    cuts = whole.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.percentile("_d", F.lit(0.33)).alias("_a"), F.percentile("_d", F.lit(0.66)).alias("_b"))
    rows = rows.join(cuts.where(c("_n") >= least), "label", "left")
    phase = F.when(c("_n").isNull(), "unknown").when(c("age") <= c("_a"), "early").when(c("age") <= c("_b"), "mature").otherwise("late")
    return rows.select(*states.columns, "age", phase.alias("phase"))


def phase_profile(phased: DataFrame, forward: DataFrame, values: list[str]) -> DataFrame:
    """Rows, mean age and mean forward values by label and phase."""
    rows = phased.join(forward, ["entity", "trade_date"], "left")
    return rows.groupBy("label", "phase").agg(F.count(F.lit(1)).alias("n"), F.avg("age").alias("mean_age"), *(F.avg(v).alias(v) for v in values))
