"""Exit tendency of states: age against stays that had ended by then, realised rates, and ranks of raw scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.quantiles import quantiles
from panelforge.panel import in_time, islands, ratio

c = F.col
#: Ages and durations are told apart below 2^_BITS.
_BITS = 20
#: Weights of age, realised rate and raw rank, with and without the rank; quantiles that part low, medium and high.
WITH_RAW, WITHOUT_RAW, PARTS = (0.45, 0.40, 0.15), (0.55, 0.45), (0.30, 0.70)
AGES = [(1, 3, "1-3"), (4, 7, "4-7"), (8, 14, "8-14"), (15, None, "15+")]


def ended_stays(states: DataFrame) -> DataFrame:
    """(label, duration, known_from) of stays of (entity, trade_date, label) that were seen to end: the date of the next stay's first row."""
    rows = islands(states, "label")
    per = rows.groupBy("entity", "segment").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("duration"), F.min("trade_date").alias("start"))
    return per.select("label", "duration", F.lead("start").over(Window.partitionBy("entity").orderBy("segment")).alias("known_from")).where("known_from is not null and label is not null")


def age_percentiles(rows: DataFrame, stays: DataFrame) -> DataFrame:
    """(label, trade_date, age, percentile, n_stays): of stays (label, duration, known_from) known by the date, the share that lasted age or less.

    No row meets the stays. Ages and durations are numbers of a binary tree: a duration lies under one node of each level,
    and the durations up to an age are the nodes at its set bits. So stays and questions are rows of (label, node) in time,
    and a running sum of stays answers the questions among them. Both are counted by day first, which bounds a node's rows
    by the calendar. Without a known stay the percentile is null.
    """
    asked = rows.where("label is not null and age is not null").select("label", "trade_date", c("age").cast("bigint").alias("age")).distinct()
    most = (1 << _BITS) - 1
    levels = F.sequence(F.lit(0), F.lit(_BITS))
    counts = stays.groupBy("label", c("known_from").alias("trade_date"), F.least("duration", F.lit(most)).cast("bigint").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    at = counts.select("label", "trade_date", "d", "k", F.explode(levels).alias("level"))
    at = at.withColumn("node", F.expr("shiftright(d, level)")).where(f"node % 2 = 0 or level = {_BITS}")
    events = at.groupBy("label", "level", "node", "trade_date").agg(F.sum("k").alias("k"))
    # all durations under age + 1: a node for each set bit; and the root for how many stays there are
    asks = asked.withColumn("x", F.least(c("age") + 1, F.lit(most + 1))).select("label", "trade_date", "age", "x", F.explode(levels).alias("level"))
    asks = asks.where(f"level = {_BITS} or (x <= {most} and shiftright(x, level) % 2 = 1)").withColumn("node", F.expr(f"case when level = {_BITS} then 0 else shiftright(x, level + 1) * 2 end"))
    both = events.select("label", "level", "node", "trade_date", F.lit(None).cast("bigint").alias("age"), "k").unionByName(asks.select("label", "level", "node", "trade_date", "age", F.lit(0).cast("bigint").alias("k")))
    so_far = Window.partitionBy("label", "level", "node").orderBy("trade_date").rangeBetween(Window.unboundedPreceding, 0)
    answered = both.withColumn("upto", F.sum("k").over(so_far)).where("age is not null")
    n = F.sum(F.when(c("level") == _BITS, c("upto")))
    under = F.coalesce(F.sum(F.when(c("level") < _BITS, c("upto"))), F.lit(0))
    got = answered.groupBy("label", "trade_date", "age").agg(n.alias("n_stays"), under.alias("_under"))
    share = F.when(c("age") >= most, 1.0).otherwise(c("_under") / c("n_stays"))
    return got.select("label", "trade_date", "age", F.when(c("n_stays") > 0, share).alias("percentile"), "n_stays")


def age_bucket(age) -> "F.Column":
    out = F.when(age.isNull(), "unknown")
    for low, high, name in AGES:
        out = out.when((age >= low) & (F.lit(True) if high is None else age <= high), name)
    return out.otherwise("unknown")


def relative_tendency(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with exit_tendency: low, medium or high by the quantiles PARTS of score in each group, unavailable without a score.

    A group of fewer than three scores, or whose quantiles are (nearly) equal, is medium throughout.
    """
    q = quantiles(rows, ["score"], list(PARTS), by).withColumnRenamed("score", "_q")
    sizes = rows.groupBy(*by).agg(F.count("score").alias("_n"))
    low, high = c("_q")[0], c("_q")[1]
    flat = (c("_n") < 3) | (F.abs(low - high) <= 1e-8 + 1e-5 * F.abs(high))
    name = F.when(c("score").isNull(), "unavailable").when(flat, "medium").when(c("score") <= low + 1e-12, "low").when(c("score") >= high - 1e-12, "high").otherwise("medium")
    return rows.join(q, by, "left").join(sizes, by, "left").withColumn("exit_tendency", name).drop("_q", "_n")


def exit_tendency(targets: DataFrame, raw: DataFrame, status: DataFrame, stays: DataFrame, least_bucket: int = 100, least_label: int = 300) -> DataFrame:
    """Score and tendency of each (entity, trade_date, label, horizon).

    targets: exit_dataset's rows with age. raw: (entity, trade_date, horizon, raw, tail_status). status: (label, horizon,
    probability_status), which lets raw scores count where it is usable_probability or raw_only. The score weighs the age's
    percentile among stays known by the date, the realised exit rate of its age bucket (of least_bucket observed rows, else
    of the label's, least_label) and the raw score's rank within the label. It is null where either of the first two is
    missing, or where the age lies beyond the durations that the raw score knows (tail_censored).
    """
    rows = targets.withColumn("age_bucket", age_bucket(c("age")))
    seen = rows.where("exit_within is not null")
    buckets = seen.groupBy("label", "horizon", "age_bucket").agg(F.count(F.lit(1)).alias("n_bucket"), F.avg("exit_within").alias("_rate"))
    labels = seen.groupBy("label", "horizon").agg(F.count(F.lit(1)).alias("n_label"), F.avg("exit_within").alias("_label_rate"))
    rates = buckets.join(labels, ["label", "horizon"])
    used = F.when(c("n_bucket") >= least_bucket, c("_rate")).when(c("n_label") >= least_label, c("_label_rate"))
    rates = rates.select("label", "horizon", "age_bucket", "n_bucket", "n_label", used.alias("realised_rate"))
    scored = rows.select("entity", "trade_date", "label", "horizon").join(raw, ["entity", "trade_date", "horizon"])
    ties = Window.partitionBy("label", "horizon", "raw")
    order = Window.partitionBy("label", "horizon").orderBy(c("raw").asc_nulls_last())
    n = F.count("raw").over(Window.partitionBy("label", "horizon"))
    ranked = scored.withColumn("raw_rank", F.when(c("raw").isNotNull(), (F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0) / n))
    full = rows.join(rates, ["label", "horizon", "age_bucket"], "left").join(ranked.drop("label"), ["entity", "trade_date", "horizon"], "left").join(status, ["label", "horizon"], "left")
    full = full.join(age_percentiles(rows, stays).select("label", "trade_date", "age", c("percentile").alias("age_percentile"), "n_stays"), ["label", "trade_date", "age"], "left")
    beyond = (c("tail_status") == "beyond_duration_support") & c("raw").isNull()
    full = full.withColumn("tail_censored", F.coalesce(beyond, F.lit(False))).withColumn("probability_status", F.when(c("tail_censored"), "tail_censored").otherwise(F.coalesce("probability_status", F.lit("missing"))))
    allowed = c("probability_status").isin("usable_probability", "raw_only") & c("raw_rank").isNotNull()
    full = full.withColumn("raw_used", allowed)
    mix = lambda weights, parts: sum(w * x for w, x in zip(weights, parts)) / sum(weights)
    parts = [c("age_percentile"), c("realised_rate"), c("raw_rank")]
    score = F.when(c("tail_censored"), F.lit(None)).when(c("raw_used"), mix(WITH_RAW, parts)).otherwise(mix(WITHOUT_RAW, parts[:2]))
    basis = F.when(c("tail_censored"), "tail_censored_beyond_duration_support").otherwise(F.concat(F.lit("age_percentile+realised_rate+"), F.when(c("raw_used"), "raw_rank").otherwise("no_raw_rank")))
    out = full.select(
        "entity", "trade_date", "label", "horizon", "age", "age_bucket", "age_percentile", "n_stays", "n_bucket", "n_label", "realised_rate",
        F.when(c("raw_used"), c("raw_rank")).alias("raw_rank"), "raw_used", "tail_censored", "probability_status", score.cast("double").alias("score"), basis.alias("basis"),
    )
    return relative_tendency(out, ["label", "horizon"])


def aged(states: DataFrame) -> DataFrame:
    """states with age: rows since the label began."""
    rows = islands(states, "label")
    return rows.withColumn("age", F.row_number().over(in_time("entity", "segment")).cast("bigint")).drop("segment")


def tendency_shares(rows: DataFrame) -> DataFrame:
    """(label, horizon, exit_tendency, n, share): how the tendencies are spread."""
    n = rows.groupBy("label", "horizon", "exit_tendency").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", ratio(c("n").cast("double"), F.sum("n").over(Window.partitionBy("label", "horizon"))))
