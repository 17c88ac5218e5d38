"""Validation of bars and coverage."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.panel import in_time, ratio

c = F.col


def consistent() -> Column:
    """Prices present, positive and within high and low; volume and amount not negative."""
    ok = (c("high") >= F.greatest("open", "low", "close")) & (c("low") <= F.least("open", "close")) & (c("low") > 0) & (c("volume") >= 0) & (c("amount") >= 0)
    return F.coalesce(ok & c("open").isNotNull() & c("close").isNotNull() & c("high").isNotNull() & c("low").isNotNull(), F.lit(False))


RULES = {
    "missing_price": lambda: c("open").isNull() | c("high").isNull() | c("low").isNull() | c("close").isNull(),
    "nonpositive_price": lambda: F.coalesce(F.least("open", "high", "low", "close") <= 0, F.lit(False)),
    "high_below": lambda: F.coalesce(c("high") < F.greatest("open", "low", "close"), F.lit(False)),
    "low_above": lambda: F.coalesce(c("low") > F.least("open", "close"), F.lit(False)),
    "negative_volume": lambda: F.coalesce(F.least("volume", "amount") < 0, F.lit(False)),
}


def violations(panel: DataFrame) -> DataFrame:
    """(rule, n): rows that break each rule, and keys that occur more than once, in two aggregations."""
    counts = panel.agg(*(F.count_if(rule()).alias(name) for name, rule in RULES.items()))
    long = counts.unpivot([], list(RULES), "rule", "n")
    again = panel.groupBy("entity", "trade_date").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    return long.unionByName(again.select(F.lit("duplicate_key").alias("rule"), "n"))


def coverage(panel: DataFrame, listing: DataFrame) -> DataFrame:
    """Per date: how many entities were listed, how many have a row, the share and a status.

    listing has (entity, first_date, last_date). Expected rows are counted from listing and delisting
    events by a running sum over dates, so dates and entities are never multiplied out.
    """
    from pyspark.sql import Window

    have = panel.groupBy("trade_date").agg(F.count_distinct("entity").alias("n"))
    events = listing.select(c("first_date").alias("d"), F.lit(1).alias("step")).unionByName(listing.where("last_date is not null").select(F.date_add("last_date", 1).alias("d"), F.lit(-1).alias("step")))
    changes = events.groupBy("d").agg(F.sum("step").alias("step"), F.lit(None).cast("bigint").alias("n"))
    days = have.select(c("trade_date").alias("d"), F.lit(0).cast("bigint").alias("step"), "n")
    marks = changes.unionByName(days).withColumn("expected", F.sum("step").over(Window.orderBy("d")))
    share = F.try_divide(c("n").cast("double"), c("expected"))
    status = F.when(share < 0.4, "fail").when(share < 0.8, "warn").otherwise("ok")
    return marks.where("n is not null").select(c("d").alias("trade_date"), "expected", c("n").alias("actual"), share.alias("coverage"), status.alias("status"))


def data_audit(panel: DataFrame, features: list[str]) -> DataFrame:
    """One row over a panel: span, counts, repeated keys, bad and missing prices, days per entity, missing shares.

    Rows are counted per key first, so no distinct count holds a set; the rest adds up these counts.
    """
    bad = lambda x: F.count_if(c(x) <= 0).alias(f"non_positive_{x}")
    whole = functools.reduce(lambda a, b: a & b, (c(f).isNotNull() for f in features))
    one = panel.agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count(F.lit(1)).alias("n_rows"), bad("open"), bad("close"),
        *(F.count_if(c(x).isNull()).alias(f"missing_{x}") for x in ("open", "close", "amount")), F.count_if(whole).alias("n_complete"),
        *(F.avg(c(f).isNull().cast("double")).alias(f"missing_share_{f}") for f in features),
    )
    per = panel.groupBy("entity", "trade_date").agg(F.count(F.lit(1)).alias("_k")).groupBy("entity").agg(F.count(F.lit(1)).alias("_days"), F.sum(c("_k") - 1).alias("_repeats"))
    p = lambda q, name: F.percentile("_days", F.lit(q)).alias(name)
    entities = per.agg(F.count(F.lit(1)).alias("n_entities"), F.sum("_repeats").alias("n_repeats"), p(0.1, "days_p10"), p(0.5, "days_median"), p(0.9, "days_p90"))
    dates = panel.select("trade_date").distinct().agg(F.count(F.lit(1)).alias("n_dates"))
    return one.crossJoin(entities).crossJoin(dates)  # one row each


def breadth_coverage(breadth: DataFrame) -> DataFrame:
    """Coverage columns made uniform: known modes only, ratios filled from older columns, and whether usable.

    Takes (mode, coverage_ratio, full_ratio, local_ratio, effective, total, level); a day is usable if the
    whole market is meant, by mode and level, and at least 0.8 of it is there.
    """
    mode = F.trim("mode")
    out = breadth.withColumn("mode", F.when(mode.isin("full_market", "local_sample"), mode).otherwise("unknown"))
    out = out.withColumn("full_ratio", F.when(c("mode") == "full_market", F.coalesce("full_ratio", "coverage_ratio")).otherwise(c("full_ratio")))
    derived = ratio(c("effective").cast("double"), c("total"))
    out = out.withColumn("local_ratio", F.when(c("mode") == "local_sample", F.coalesce(c("local_ratio"), c("coverage_ratio"), derived)).otherwise(c("local_ratio")))
    usable = (c("mode") == "full_market") & (c("level") == "full_market") & (c("full_ratio") >= 0.8)
    return out.withColumn("usable", F.coalesce(usable, F.lit(False)))


def cache_audit(cache: DataFrame, keys: list[str], upto: list[str], metadata: list[str]) -> DataFrame:
    """One row over cached states: rows, keys, repeats, dates used after trade_date, missing metadata."""
    per = cache.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"), *(F.count_if(c(x) > c("trade_date")).alias(f"_late_{x}") for x in upto), *(F.count_if(c(x).isNull()).alias(f"_none_{x}") for x in metadata),
    )
    return per.agg(
        F.sum("_k").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(c("_k") - 1).alias("n_repeats"),
        *(F.sum(f"_late_{x}").alias(f"late_{x}") for x in upto), *(F.sum(f"_none_{x}").alias(f"missing_{x}") for x in metadata),
    )


def target_violations(targets: DataFrame) -> DataFrame:
    """(check, n) of the rows of an exit dataset that break a rule of censoring, weights or dates; rules without a breach are absent."""
    value, status = c("exit_within"), c("status")
    cut = status.startswith("censored")
    rules = {
        "positive_label": (status == "positive") & ~value.eqNullSafe(F.lit(1)), "negative_label": (status == "negative") & ~value.eqNullSafe(F.lit(0)),
        "censored_label": cut & value.isNotNull(), "missing_label": (status == "missing_state") & value.isNotNull(), "censored_weight": cut & (c("weight") > 0),
        "positive_exit_date": (status == "positive") & (c("exit_date") > c("observed_until")), "negative_end": (status == "negative") & (c("observed_until") < c("trade_date")),
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return targets.select(F.explode(broken).alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def silent_breaks(panel: DataFrame, most_days: int) -> DataFrame:
    """Entities with neighbouring rows more than most_days calendar days apart: number of gaps and the longest."""
    gap = F.date_diff("trade_date", F.lag("trade_date").over(in_time()))
    return panel.select("entity", gap.alias("_g")).where(c("_g") > most_days).groupBy("entity").agg(F.count(F.lit(1)).alias("n_gaps"), F.max("_g").cast("bigint").alias("longest"))


def key_coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in both, only expected, only found, and the share of expected keys found; null keys count as keys."""
    sides = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_f")).unionByName(found.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_f")))
    per = sides.groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_f").alias("_f"))
    out = per.agg(F.count_if((c("_e") == 1) & (c("_f") == 1)).alias("n_both"), F.count_if(c("_f") == 0).alias("n_missing"), F.count_if(c("_e") == 0).alias("n_extra"))
    return out.withColumn("share", ratio(c("n_both").cast("double"), c("n_both") + c("n_missing")))
