"""Statistics of signals, calibration, concentration and market stress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.panel import average_rank, ratio

c = F.col


def forward_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, win rate, deviations and quantiles of a forward value per key."""
    loss = F.when(c(value) < 0, c(value))
    q = lambda p: F.percentile(value, F.lit(p))
    return df.where(c(value).isNotNull() & c(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("trade_date").alias("n_dates"), F.avg(value).alias("mean"), q(0.5).alias("median"),
        F.avg((c(value) > 0).cast("double")).alias("win_rate"), F.stddev_pop(value).alias("std"), F.coalesce(F.stddev_pop(loss), F.lit(0.0)).alias("downside_std"),
        q(0.1).alias("p10"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.9).alias("p90"),
    )


def information_coefficient(df: DataFrame, score: str, target: str, least: int = 3) -> DataFrame:
    """Spearman correlation of score and target per date (average ranks), without rounding dust."""
    ok = df.where(c(score).isNotNull() & c(target).isNotNull())
    ranked = ok.select("trade_date", average_rank(c(score), "trade_date").alias("_x"), average_rank(c(target), "trade_date").alias("_y"))
    day = ranked.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"), F.covar_pop("_x", "_y").alias("_c"))
    return day.where(c("n") >= least).select("trade_date", "n", F.round(ratio(c("_c"), c("_sx") * c("_sy")), 12).alias("ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    return ic.where("ic is not null").agg(
        F.count(F.lit(1)).alias("n_dates"), F.avg("ic").alias("mean"), F.percentile("ic", F.lit(0.5)).alias("median"), F.stddev_samp("ic").alias("std"),
        ratio(F.avg("ic") * F.sqrt(F.count(F.lit(1)).cast("double")), F.stddev_samp("ic")).alias("t_stat"), F.avg((c("ic") > 0).cast("double")).alias("positive_share"),
    )


def score_buckets(df: DataFrame, score: str, target: str, k: int) -> DataFrame:
    """Mean target by score bucket, where bucket b holds the ranks up to 1 + (n - 1) b / k of its date."""
    w = Window.partitionBy("trade_date")
    ok = df.where(c(score).isNotNull() & c(target).isNotNull())
    rows = ok.withColumn("_r", F.row_number().over(w.orderBy(score, "entity"))).withColumn("_n", F.count(F.lit(1)).over(w)).where(c("_n") >= k)
    bucket = F.greatest(F.lit(1), F.expr(f"cast(ceil((_r - 1) * {k} / cast(greatest(_n - 1, 1) as double)) as int)"))
    return rows.groupBy(bucket.cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_target"), F.avg((c(target) > 0).cast("double")).alias("hit_rate"))


def auc(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks, per key."""
    ok = df.where(c(score).isNotNull() & c(label).isNotNull())
    ranked = ok.select(*keys, c(label).cast("int").alias("_y"), average_rank(c(score), *keys).alias("_r"))
    s = ranked.groupBy(*keys).agg(F.sum("_y").alias("n_pos"), F.count(F.lit(1)).alias("n"), F.sum(c("_r") * c("_y")).alias("_s"))
    pos, neg = c("n_pos"), c("n") - c("n_pos")
    return s.select(*keys, "n", "n_pos", ratio(c("_s") - pos * (pos + 1) / 2.0, (pos * neg).cast("double")).alias("auc"))


def calibration_curve(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(c(p) * bins), F.lit(bins - 1))
    y = c(label).cast("double")
    return df.where(c(p).isNotNull() & c(label).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))


def calibration_errors(curve: DataFrame) -> DataFrame:
    """Expected and largest calibration error, slope and intercept over the bins."""
    gap = F.abs(c("mean_p") - c("observed"))
    return curve.agg(
        (F.sum(gap * c("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.regr_slope("observed", "mean_p").alias("slope"), F.regr_intercept("observed", "mean_p").alias("intercept"),
    )


def concentration(events: DataFrame, key: str) -> DataFrame:
    """Number of events, keys that have any, largest share, Herfindahl index and median per key."""
    per = events.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    total = per.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_keys"), F.max("k").alias("_m"), F.sum((c("k") * c("k")).cast("double")).alias("_s"), F.percentile("k", F.lit(0.5)).alias("median"))
    return total.select("n", "n_keys", ratio(c("_m").cast("double"), c("n")).alias("max_share"), ratio(c("_s"), (c("n") * c("n")).cast("double")).alias("hhi"), "median")


def market_blocks(events: DataFrame, share: float, gap: int) -> DataFrame:
    """Blocks of dates on which at least a share of entities has an event; dates at most gap apart merge."""
    day = events.groupBy("trade_date").agg(F.avg(c("event").cast("double")).alias("share"))
    w = Window.orderBy("trade_date")
    day = day.withColumn("_pos", F.row_number().over(w)).where(c("share") >= share)
    new = F.coalesce(c("_pos") - F.lag("_pos").over(w) > gap, F.lit(True)).cast("bigint")
    day = day.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return day.groupBy("block").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("n_dates"), F.max("share").alias("peak_share"))


def clustered_mean(df: DataFrame, value: str, cluster: str) -> DataFrame:
    """Mean of cluster means with its 95 % interval from their sample deviation."""
    per = df.where(c(value).isNotNull()).groupBy(cluster).agg(F.avg(value).alias("_m"))
    s = per.agg(F.count(F.lit(1)).alias("n_clusters"), F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("_s"))
    half = 1.96 * c("_s") / F.sqrt(c("n_clusters").cast("double"))
    return s.select("n_clusters", "mean", (c("mean") - half).alias("low"), (c("mean") + half).alias("high"))


def empirical_rates(events: DataFrame, tail: int = 20, least: int = 5) -> DataFrame:
    """Event rate per entity over its last tail labelled rows, else the overall rate (one row, joined)."""
    ok = events.where("event is not null")
    w = Window.partitionBy("entity").orderBy(F.desc("trade_date"))
    recent = ok.withColumn("_k", F.row_number().over(w)).where(c("_k") <= tail).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg(c("event").cast("double")).alias("_own"))
    overall = ok.agg(F.avg(c("event").cast("double")).alias("_all"))
    return recent.crossJoin(F.broadcast(overall)).select("entity", "n", F.when(c("n") >= least, c("_own")).otherwise(c("_all")).alias("rate"))


def age_baseline(targets: DataFrame, label: str, age: str, event: str, least: int = 30) -> DataFrame:
    """Counts and, with enough rows, event rates by label and age bucket."""
    bucket = F.when(c(age) <= 3, "01-03").when(c(age) <= 7, "04-07").when(c(age) <= 14, "08-14").otherwise("15+")
    y = c(event)
    t = targets.groupBy(label, bucket.alias("age_bucket")).agg(F.count(y).alias("n_valid"), F.count_if(y).alias("n_pos"), F.count_if(y.isNull()).alias("n_censored"))
    return t.withColumn("rate", F.when(c("n_valid") >= least, c("n_pos") / c("n_valid")))


def stress_levels(components: DataFrame, names: list[str]) -> DataFrame:
    """Warning level of several stress z-scores: high from 2, medium from 1, fewer than two is insufficient."""
    have = F.array_compact(F.array(*(c(n) for n in names)))
    high = F.size(F.filter(have, lambda x: x >= 2))
    medium = F.size(F.filter(have, lambda x: (x >= 1) & (x < 2)))
    level = F.when(F.size(have) < 2, "insufficient").when(high >= 2, "high").when((high == 1) | (medium >= 2), "elevated").when(medium == 1, "watch").otherwise("normal")
    names_high = F.array_join(F.array_compact(F.array(*(F.when(c(n) >= 1, F.lit(n)) for n in names))), ",")
    return components.withColumn("level", level).withColumn("drivers", names_high)


def period_breakdown(df: DataFrame, value: str) -> DataFrame:
    """Rows, mean and win rate of a value by year."""
    ok = df.where(c(value).isNotNull())
    return ok.groupBy(F.year("trade_date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg((c(value) > 0).cast("double")).alias("win_rate"))


def downshift(df: DataFrame, score: str, ret: str) -> DataFrame:
    """Daily mean return with full exposure and with exposure cut by score: .75 from q75, .5 from q90.

    The quantiles are one row, joined back as such.
    """
    q = df.agg(F.percentile(score, F.array(F.lit(0.75), F.lit(0.9))).alias("_q"))
    rows = df.where(c(score).isNotNull() & c(ret).isNotNull()).crossJoin(F.broadcast(q))
    exposure = F.when(c(score) >= c("_q")[1], 0.5).when(c(score) >= c("_q")[0], 0.75).otherwise(1.0)
    return rows.groupBy("trade_date").agg(F.avg(ret).alias("full"), F.avg(c(ret) * exposure).alias("cut"), F.avg(exposure).alias("exposure"))


#: Warning levels that make an episode, from mild to severe.
WARNINGS = ["watch", "elevated", "high"]


def warning_episodes(levels: DataFrame, gap_days: int = 7) -> DataFrame:
    """Runs of dates (trade_date, level, drivers) with a warning: span, dates by level, peak, first drivers.

    A run ends at a date without a warning, and where two neighbouring dates lie more than gap_days apart.
    """
    w = Window.orderBy("trade_date")
    warns = c("level").isin(WARNINGS)
    joins = F.lag(warns).over(w) & (F.date_diff("trade_date", F.lag("trade_date").over(w)) <= gap_days)
    rows = levels.withColumn("_on", warns).withColumn("_new", (warns & ~F.coalesce(joins, F.lit(False))).cast("bigint"))
    rows = rows.withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_last", F.max("trade_date").over(Window.partitionBy())).where("_on")
    peak = F.max(F.array_position(F.array(*map(F.lit, WARNINGS)), c("level")))
    return rows.groupBy("episode").agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("n_dates"), peak.alias("severity"),
        *(F.count_if(c("level") == x).alias(f"n_{x}") for x in WARNINGS), F.min_by("drivers", "trade_date").alias("first_drivers"), (F.max("trade_date") == F.max("_last")).alias("active"),
    ).withColumn("peak", F.array(*map(F.lit, WARNINGS))[(c("severity") - 1).cast("int")])


def idiosyncratic_episodes(events: DataFrame, blocks: DataFrame, gap: int) -> DataFrame:
    """An entity's event episodes (dates at most gap rows apart), and whether they overlap a market block.

    Blocks are disjoint, so an episode overlaps one if the last block begun by its end reaches its start:
    an as-of window over the calendar and an equality join, no join on intervals.
    """
    w = Window.partitionBy("entity").orderBy("trade_date")
    ok = events.where("event is not null")
    rows = ok.withColumn("_pos", F.row_number().over(w)).where("event")
    new = F.coalesce(c("_pos") - F.lag("_pos").over(w) > gap, F.lit(True)).cast("bigint")
    rows = rows.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy("entity", "episode").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("n_dates"))
    days = ok.select("trade_date").distinct().join(blocks.select(c("start_date").alias("trade_date"), c("end_date").alias("_end")), "trade_date", "left")
    days = days.select(c("trade_date").alias("end_date"), F.last("_end", ignorenulls=True).over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)).alias("_reach"))
    return found.join(days, "end_date").select("entity", "episode", "start_date", "end_date", "n_dates", F.coalesce(c("_reach") >= c("start_date"), F.lit(False)).alias("in_market_block"))


def event_evidence(events: DataFrame, blocks: DataFrame, episodes: DataFrame, discounts: list[float]) -> DataFrame:
    """One row: labelled rows, events, market blocks, episodes outside them, evidence at discounts, verdict at the first."""
    e = events.agg(F.count("event").alias("n_labelled"), F.count_if(c("event")).alias("n_events"))
    b, i = blocks.agg(F.count(F.lit(1)).alias("n_blocks")), episodes.agg(F.count_if(~c("in_market_block")).alias("n_idiosyncratic"))
    one = e.crossJoin(b).crossJoin(i)  # one row each
    one = one.select("*", *((c("n_blocks") + c("n_idiosyncratic") * d).alias(f"evidence_{round(100 * d)}") for d in discounts))
    at = c(f"evidence_{round(100 * discounts[0])}")
    short = F.when(c("n_events") > 0, "drop").otherwise("short_history")
    return one.withColumn("verdict", F.when(c("n_labelled") == 0, "short_history").when(at < 5, short).when((at < 10) | (c("n_blocks") < 2), "diagnostic").otherwise("eligible"))


def state_spreads(df: DataFrame, value: str, pairs: list[tuple[str, str]], rounds: int = 200, seed: int = 42) -> DataFrame:
    """Mean and median of value under one label less another's, with a bootstrap of whole dates.

    Dates with both labels are drawn with replacement: draw i of round r takes the date numbered by a hash
    of (seed, r, i), so draws are rows that Spark deals out, the same on any partitioning. The interval
    holds 95 % of the rounds' differences of means; p_not_above is the share at zero or below.
    """
    ok = df.where(c(value).isNotNull() & c("label").isNotNull())
    found = None
    for left, right in pairs:
        side = lambda x: F.when(c("label") == x, c(value))
        name = F.lit(f"{left}-{right}").alias("spread")
        whole = ok.agg(
            F.count(side(left)).alias("n_left"), F.count(side(right)).alias("n_right"), (F.avg(side(left)) - F.avg(side(right))).alias("mean"),
            (F.percentile(side(left), F.lit(0.5)) - F.percentile(side(right), F.lit(0.5))).alias("median"),
        )
        day = ok.groupBy("trade_date").agg(F.sum(side(left)).alias("_ls"), F.count(side(left)).alias("_ln"), F.sum(side(right)).alias("_rs"), F.count(side(right)).alias("_rn"))
        day = day.where("_ln > 0 and _rn > 0").withColumn("_k", F.row_number().over(Window.orderBy("trade_date")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
        digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), c("_r").cast("string"), c("_k").cast("string"))), 1, 8)
        draws = day.select("_k", "_n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_r")).select("_r", (F.conv(digits, 16, 10).cast("bigint") % c("_n")).alias("_k"))
        per = draws.join(day.drop("_n"), "_k").groupBy("_r").agg((F.sum("_ls") / F.sum("_ln") - F.sum("_rs") / F.sum("_rn")).alias("_d"))
        drawn = per.agg(F.percentile("_d", F.lit(0.025)).alias("low"), F.percentile("_d", F.lit(0.975)).alias("high"), F.avg((c("_d") <= 0).cast("double")).alias("p_not_above"))
        row = whole.crossJoin(drawn).select(name, "*")  # one row each
        found = row if found is None else found.unionByName(row)
    return found


def score_metrics(df: DataFrame, p: str, label: str, *keys: str) -> DataFrame:
    """Brier score, average precision (ties at one threshold together) and Spearman correlation, per key."""
    ok = df.where(c(p).isNotNull() & c(label).isNotNull()).select(*keys, c(p).alias("_p"), c(label).cast("int").alias("_y"))
    ranked = ok.withColumn("_a", average_rank(c("_p"), *keys)).withColumn("_b", average_rank(c("_y"), *keys))
    plain = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((c("_p") - c("_y")) * (c("_p") - c("_y"))).alias("brier"),
        ratio(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")).alias("spearman"),
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    steps = ok.groupBy(*keys, "_p").agg(F.sum("_y").alias("_pos"), F.count(F.lit(1)).alias("_n"))
    steps = steps.select(*keys, "_pos", (F.sum("_pos").over(w) / F.sum("_n").over(w)).alias("_precision"))
    ap = steps.groupBy(*keys).agg(ratio(F.sum(c("_pos") * c("_precision")), F.sum("_pos").cast("double")).alias("average_precision"))
    return plain.join(ap, list(keys)).select(*keys, "n", "brier", "average_precision", "spearman")
