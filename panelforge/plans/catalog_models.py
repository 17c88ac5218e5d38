"""Registered queries of the state, hazard and calibration models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelforge.operators import calibration, features, logistic, rebuild, segments, state_models, targets, tendency
from panelforge.plans import sql as q
from panelforge.plans.catalog import _factors, _features, _segments, _states, query
from panelforge.plans.tables import members, panel, rounded, states
from panelforge.shared import materialize, shared_dir
from panelforge.sources.builds import Builds

c = F.col
STATE_COLUMNS = ["ret_5d", "vol_20d"]
#: What makes a state trending or risky, over the means of its rows.
TREND = "avg(ret_20d) + avg(rs_20d) + avg(ma20_slope) - 0.25 * avg(vol_20d)"
RISK = "-avg(ret_20d) - avg(rs_20d) - avg(drawdown) + 0.5 * avg(vol_20d)"
STAY_COLUMNS = ["excess_5", "excess_20", "vol_20", "drawdown_20", "amount_z_20"]
#: Labels of states of stays in order of choice: weights of z-scored means (| for absolute values), least number of states.
PROFILES = [
    ("Trend", {"excess_20": 1.0, "excess_10": 1.0, "slope_20": 1.0, "|drawdown_20": -1.0}, 1),
    ("Stress", {"excess_20": -1.0, "excess_5": -1.0, "|drawdown_20": 1.0, "downside_10": 1.0}, 1),
    ("Repair", {"excess_5": 1.0, "ret_5": 1.0, "|drawdown_20": 0.5, "vol_20": 0.25}, 4),
    ("Compression", {"|vol_20": -1.0, "|amount_z_20": -1.0}, 5),
]
HORIZONS = [1, 3, 5, 10, 20]
STAYS = state_models.Config(kind="stays", n_states=4, starts=2, rounds=20, cluster_rounds=15, max_stay=60)


def _dates(p):
    return p.select(c("trade_date").alias("signal_date")).distinct()


@query()
def walk_forward_states(spark, sf_dir):
    """Filtered states of each day by models trained each quarter on the 504 dates before."""
    f = _features(spark, sf_dir)
    got = state_models.walk_forward(f, STATE_COLUMNS, _dates(f), F.date_trunc("quarter", "signal_date"), state_models.Config(starts=2, rounds=60), F.expr(TREND), F.expr(RISK))
    return rounded(got)


@query()
def stay_states(spark, sf_dir):
    """States with duration distributions, fitted to and decoded on the whole panel, with lifecycle scalars."""
    f = features.regime_features(panel(spark, sf_dir)).withColumns({"window": F.lit(0), "in_train": F.lit(True)})
    known = materialize(f.where(" and ".join(f"{x} is not null" for x in STAY_COLUMNS)), "known")
    seqs = state_models.sequences(state_models.standardised(known, STAY_COLUMNS), [f"z_{x}" for x in STAY_COLUMNS])
    models = state_models.fit(seqs, len(STAY_COLUMNS), STAYS)
    paths = state_models.decoded(seqs, models, len(STAY_COLUMNS))
    labels = state_models.profile_labels(paths.join(known.drop("in_train"), ["window", "entity", "trade_date"]), PROFILES)
    life = state_models.lifecycle(paths, state_models.parameters(seqs, models), ["window", "state"], HORIZONS)
    return rounded(life.join(labels, ["window", "state"]).drop("window", "in_train"))


def _walked_stays(spark, sf_dir):
    f = features.regime_features(panel(spark, sf_dir))
    return state_models.walk_forward_stays(f, STAY_COLUMNS, _dates(f), F.date_trunc("quarter", "signal_date"), STAYS, PROFILES, HORIZONS)


@query()
def stay_walk_forward(spark, sf_dir):
    """Each day's state, age and chances to exit by the model of the quarter's checkpoint, from the rows until then."""
    return rounded(_walked_stays(spark, sf_dir))


@query()
def stay_episodes(spark, sf_dir):
    return state_models.episodes(_walked_stays(spark, sf_dir))


def _life_sql() -> str:
    sums = "list_sum(list_slice(stay, {}, {}))".format
    left = sums("greatest(age, 1)", "60")
    exits = ", ".join(f"CASE WHEN age > 0 AND age < 60 AND {left} > 1e-12 THEN round(least({sums('age', f'age + {h} - 1')} / {left}, 1.0), 6) + 0.0 END AS p_exit_{h}" for h in (1, 5, 20))
    return f""", d AS (SELECT label, least(n_days, 60) AS d, count(*) AS k FROM segs WHERE next_label IS NOT NULL GROUP BY 1, 2),
g AS (SELECT label, d, coalesce(k, 0) + 1.0 AS k FROM (SELECT DISTINCT label FROM segs) CROSS JOIN (SELECT unnest(generate_series(1, 60)) AS d) LEFT JOIN d USING (label, d)),
p AS (SELECT label, list(k / t ORDER BY d) AS stay FROM (SELECT *, sum(k) OVER (PARTITION BY label) AS t FROM g) GROUP BY 1),
a AS (SELECT entity, segment, label, CAST(n_days AS INTEGER) AS age, stay FROM segs JOIN p USING (label)),
x AS (SELECT *, CASE WHEN age >= 60 THEN 1.0 ELSE {sums('1', 'age')} END AS pc,
  CASE WHEN age < 60 AND {left} > 1e-12 THEN list_sum(list_transform(generate_series(age, 60), lambda d: (d - age) * stay[d])) / {left} ELSE 0.0 END AS rest FROM a)
SELECT entity, segment, label, age, round(pc, 6) + 0.0 AS duration_percentile, {exits}, round(rest, 6) + 0.0 AS expected_rest,
  CASE WHEN age >= 60 THEN 'beyond_duration_support' ELSE 'within_duration_support' END AS tail_status, CASE WHEN pc < 0.33 THEN 'early' WHEN pc < 0.67 THEN 'mature' ELSE 'late' END AS phase FROM x"""


@query(q.base(upto="segs") + _life_sql())
def lifecycle_scalars(spark, sf_dir):
    """What the durations of a label's ended segments (add-one smoothed) say of each segment at its age."""
    s = _segments(spark, sf_dir).select("entity", "segment", "label", c("n_days").cast("int").alias("age"), "next_label")
    return rounded(state_models.lifecycle(s.drop("next_label"), state_models.empirical_stays(s.where("next_label is not null"), s, 60), ["label"], [1, 5, 20]))


# exits: tendencies, calibrated rates, hazards

#: States with their runs, ages and how many rows later they end.
EXITS_SQL = """, st AS (
  SELECT entity, trade_date, label, segment, row_number() OVER (PARTITION BY entity ORDER BY trade_date) AS pos, row_number() OVER (PARTITION BY entity, segment ORDER BY trade_date) AS age,
    count(*) OVER (PARTITION BY entity) AS n_rows, count(*) OVER (PARTITION BY entity, segment) AS len, max(segment) OVER (PARTITION BY entity) AS last_segment FROM runs),
durations AS (SELECT label, least(n_days, 60) AS d, count(*) AS k FROM segs WHERE next_label IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT label, d, coalesce(k, 0) + 1.0 AS k FROM (SELECT DISTINCT label FROM segs) CROSS JOIN (SELECT unnest(generate_series(1, 60)) AS d) LEFT JOIN durations USING (label, d)),
pmf AS (SELECT label, list(k / t ORDER BY d) AS stay FROM (SELECT *, sum(k) OVER (PARTITION BY label) AS t FROM grid) GROUP BY 1),
ex0 AS (
  SELECT st.*, h AS horizon, CASE WHEN segment < last_segment AND len - age + 1 <= h THEN 1 WHEN pos + h <= n_rows THEN 0 END AS y, stay
  FROM st CROSS JOIN (SELECT unnest([5, 20]) AS h) JOIN pmf USING (label)),
ex AS (
  SELECT *, CASE WHEN age < 60 THEN least(list_sum(list_slice(stay, age, age + horizon - 1)) / list_sum(list_slice(stay, age, 60)), 1.0) END AS raw,
    CASE WHEN age >= 60 THEN 1.0 ELSE list_sum(list_slice(stay, 1, age)) END AS pc FROM ex0)"""


def _exits(spark, sf_dir, f=None):
    """From features f (made here, if not given), written: (entity, trade_date, label, age, horizon, y, raw, tail_status, duration_percentile, phase, exit_date, observed_until)."""
    labelled = materialize(states(_features(spark, sf_dir) if f is None else f), "states")
    aged = tendency.aged(labelled.select("entity", "trade_date", "label"))
    s = segments.state_segments(labelled).select("entity", "segment", "label", c("n_days").cast("int").alias("age"), "next_label")
    stays = state_models.empirical_stays(s.where("next_label is not null"), s, 60)
    life = state_models.lifecycle(aged.withColumn("age", c("age").cast("int")), stays, ["label"], [5, 20])
    raw = F.explode(F.array(*(F.struct(F.lit(h).cast("bigint").alias("horizon"), c(f"p_exit_{h}").alias("raw")) for h in (5, 20)))).alias("r")
    raw = life.select("entity", "trade_date", c("age").cast("bigint").alias("age"), "duration_percentile", "phase", "tail_status", raw).select("*", "r.*").drop("r")
    rows = segments.exit_dataset(labelled, [5, 20]).join(raw, ["entity", "trade_date", "horizon"]).withColumn("y", c("exit_within"))
    return materialize(rows, "exits")


@query(q.base(upto="segs") + EXITS_SQL + """,
known AS (SELECT a.label, a.n_days AS d, b.start_date AS known_from FROM segs a JOIN segs b ON a.entity = b.entity AND b.segment = a.segment + 1),
age_pct AS (SELECT x.label, x.trade_date, x.age, count(*) AS n_stays, count(CASE WHEN d <= x.age THEN 1 END) * 1.0 / count(*) AS p FROM (SELECT DISTINCT label, trade_date, age FROM st) x JOIN known k ON k.label = x.label AND k.known_from <= x.trade_date GROUP BY 1, 2, 3),
b AS (SELECT *, CASE WHEN age <= 3 THEN '1-3' WHEN age <= 7 THEN '4-7' WHEN age <= 14 THEN '8-14' ELSE '15+' END AS age_bucket FROM ex),
br AS (SELECT label, horizon, age_bucket, count(*) AS n_bucket, avg(y) AS r FROM b WHERE y IS NOT NULL GROUP BY 1, 2, 3), lr AS (SELECT label, horizon, count(*) AS n_label, avg(y) AS r FROM b WHERE y IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT entity, trade_date, horizon, CASE WHEN raw IS NOT NULL THEN (rank() OVER (PARTITION BY label, horizon ORDER BY raw NULLS LAST) + (count(*) OVER (PARTITION BY label, horizon, raw) - 1) / 2.0) / count(raw) OVER (PARTITION BY label, horizon) END AS rr FROM b),
f AS (SELECT b.*, p AS age_percentile, coalesce(n_stays, 0) AS n_stays, n_bucket, CASE WHEN n_bucket IS NOT NULL THEN n_label END AS n_label, CASE WHEN n_bucket >= 100 THEN br.r WHEN n_bucket IS NOT NULL AND n_label >= 300 THEN lr.r END AS realised, rr,
  b.age >= 60 AS tail, CASE WHEN b.age >= 60 THEN 'tail_censored' WHEN b.label = 'flat' THEN 'ordinal_only' ELSE 'raw_only' END AS probability_status
  FROM b LEFT JOIN age_pct a ON a.label = b.label AND a.trade_date = b.trade_date AND a.age = b.age LEFT JOIN br ON br.label = b.label AND br.horizon = b.horizon AND br.age_bucket = b.age_bucket
  LEFT JOIN lr ON lr.label = b.label AND lr.horizon = b.horizon LEFT JOIN rk ON rk.entity = b.entity AND rk.trade_date = b.trade_date AND rk.horizon = b.horizon),
s AS (SELECT *, probability_status = 'raw_only' AND rr IS NOT NULL AS used FROM f),
z AS (SELECT *, CASE WHEN tail THEN NULL WHEN used THEN (0.45 * age_percentile + 0.40 * realised + 0.15 * rr) / 1.0 ELSE (0.55 * age_percentile + 0.45 * realised) / 1.0 END AS score FROM s),
w AS (SELECT *, score AS sc FROM z), k AS (SELECT label, horizon, quantile_cont(sc, 0.3) AS lo, quantile_cont(sc, 0.7) AS hi, count(sc) AS n FROM w GROUP BY 1, 2)
SELECT entity, w.trade_date, w.label, w.horizon, age, age_bucket, round(age_percentile, 6) + 0.0 AS age_percentile, n_stays, n_bucket, n_label, round(realised, 6) + 0.0 AS realised_rate, CASE WHEN used THEN round(rr, 6) + 0.0 END AS raw_rank, used AS raw_used, tail AS tail_censored,
  probability_status, round(sc, 6) + 0.0 AS score, CASE WHEN tail THEN 'tail_censored_beyond_duration_support' WHEN used THEN 'age_percentile+realised_rate+raw_rank' ELSE 'age_percentile+realised_rate+no_raw_rank' END AS basis,
  CASE WHEN sc IS NULL THEN 'unavailable' WHEN k.n < 3 OR abs(lo - hi) <= 1e-8 + 1e-5 * abs(hi) THEN 'medium' WHEN sc <= lo + 1e-12 THEN 'low' WHEN sc >= hi - 1e-12 THEN 'high' ELSE 'medium' END AS exit_tendency
FROM w JOIN k ON k.label = w.label AND k.horizon = w.horizon""")
def exit_tendency(spark, sf_dir):
    """Tendency of each state row to exit within 5 and 20 rows; the raw scores of flat states may only order."""
    t = _exits(spark, sf_dir)
    status = t.select("label", "horizon").distinct().withColumn("probability_status", F.when(c("label") == "flat", "ordinal_only").otherwise("raw_only"))
    stays = tendency.ended_stays(_states(spark, sf_dir).select("entity", "trade_date", "label"))
    rows = t.select("entity", "trade_date", "label", "horizon", "age", "exit_within")
    return rounded(tendency.exit_tendency(rows, t.select("entity", "trade_date", "horizon", "raw", "tail_status"), status, stays))


PROB = ([-0.001, 0.2, 0.4, 0.6, 0.8, 1.001], ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"])
AGES = ([0, 1, 3, 5, 10, 20, float("inf")], ["1", "2-3", "4-5", "6-10", "11-20", "21+"])


def _cut_sql(x: str, edges: list, labels: list) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {a} AND {x} <= {'1e300' if b == float('inf') else b} THEN '{n}'" for a, b, n in zip(edges, edges[1:], labels)) + " END"


CALIBRATION_SQL = EXITS_SQL + f""",
en AS (SELECT entity, segment, max(trade_date) AS last_date FROM st GROUP BY 1, 2),
dates AS (SELECT entity, pos, trade_date FROM st),
c0 AS (SELECT ex.*, round(raw, 9) AS r9, coalesce(d.trade_date, m.trade_date) AS horizon_end, x.trade_date AS exit_date, CASE WHEN pc < 0.33 THEN 'early' WHEN pc < 0.67 THEN 'mature' ELSE 'late' END AS phase
  FROM ex LEFT JOIN dates d ON d.entity = ex.entity AND d.pos = ex.pos + horizon LEFT JOIN dates m ON m.entity = ex.entity AND m.pos = ex.n_rows LEFT JOIN dates x ON x.entity = ex.entity AND ex.segment < ex.last_segment AND x.pos = ex.pos + len - age + 1),
cal AS (SELECT *, {_cut_sql('age', *AGES)} AS ab, {_cut_sql('round(pc, 9)', *PROB)} AS db, {_cut_sql('r9', *PROB)} AS rb FROM c0)"""


def _calibration_rows(spark, sf_dir):
    t = _exits(spark, sf_dir).withColumn("raw", F.round("raw", 9)).withColumnRenamed("observed_until", "horizon_end")
    return t.select(
        "entity", "trade_date", "label", "phase", "horizon", "horizon_end", "exit_date", "y", "raw",
        calibration.bucket(c("age"), *AGES).alias("age_bucket"), calibration.bucket(F.round("duration_percentile", 9), *PROB).alias("duration_bucket"), calibration.bucket(c("raw"), *PROB).alias("raw_bucket"),
    )


LEVELS = [[], ["label"], ["label", "phase"], ["label", "phase", "age_bucket", "duration_bucket", "raw_bucket"]]


@query(q.base(upto="segs") + CALIBRATION_SQL + """,
tr AS (SELECT * FROM cal WHERE y IS NOT NULL AND raw IS NOT NULL AND trade_date <= DATE '1999-06-30' AND horizon_end <= DATE '1999-06-30' AND NOT (y = 1 AND exit_date > DATE '1999-06-30')),
t3 AS (SELECT horizon, label, phase, ab, db, rb, count(*) AS n, avg(y) AS r FROM tr GROUP BY ALL HAVING count(*) >= 50), t2 AS (SELECT horizon, label, phase, count(*) AS n, avg(y) AS r FROM tr GROUP BY ALL HAVING count(*) >= 25),
t1 AS (SELECT horizon, label, count(*) AS n, avg(y) AS r FROM tr GROUP BY ALL HAVING count(*) >= 25), t0 AS (SELECT horizon, count(*) AS n, avg(y) AS r FROM tr GROUP BY ALL)
SELECT c.entity, c.trade_date, c.horizon, c.label, round(r9, 6) + 0.0 AS raw, CASE WHEN raw IS NOT NULL THEN round(coalesce(t3.r, t2.r, t1.r, t0.r, r9), 6) + 0.0 END AS calibrated,
  CASE WHEN raw IS NOT NULL THEN CASE WHEN t3.r IS NOT NULL THEN 0 WHEN t2.r IS NOT NULL THEN 1 WHEN t1.r IS NOT NULL THEN 2 WHEN t0.r IS NOT NULL THEN 3 ELSE 4 END END AS level, CASE WHEN raw IS NOT NULL THEN coalesce(t3.n, t2.n, t1.n, t0.n, 0) END AS n_level,
  CASE WHEN raw IS NULL THEN 'unavailable' ELSE 'usable_probability' END AS probability_status
FROM cal c LEFT JOIN t3 ON t3.horizon = c.horizon AND t3.label = c.label AND t3.phase = c.phase AND t3.ab = c.ab AND t3.db = c.db AND t3.rb = c.rb LEFT JOIN t2 ON t2.horizon = c.horizon AND t2.label = c.label AND t2.phase = c.phase
  LEFT JOIN t1 ON t1.horizon = c.horizon AND t1.label = c.label LEFT JOIN t0 ON t0.horizon = c.horizon""")
def exit_calibration_backoff(spark, sf_dir):
    """Exit chances calibrated by realised rates settled by mid 1999: bucket, then label and phase, label, all."""
    got = calibration.exit_calibrator(_calibration_rows(spark, sf_dir), F.lit("1999-06-30").cast("date"), ["horizon"], LEVELS)
    return rounded(got.select("entity", "trade_date", "horizon", "label", "raw", "calibrated", "level", "n_level", "probability_status"))


@query(q.base(upto="segs") + CALIBRATION_SQL + """,
el AS (SELECT * FROM cal WHERE y IS NOT NULL AND raw IS NOT NULL), dayno AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM el)),
sp AS (SELECT trade_date, CASE WHEN i <= greatest(1, floor(n * 0.6)) THEN 'train' WHEN i <= greatest(greatest(1, floor(n * 0.6)) + 1, floor(n * 0.8)) THEN 'validation' ELSE 'test' END AS split FROM dayno),
e2 AS (SELECT el.*, split FROM el JOIN sp USING (trade_date)), tr AS (SELECT * FROM e2 WHERE split = 'train'),
t2 AS (SELECT horizon, label, ab, rb, count(*) AS n, avg(y) AS r FROM tr GROUP BY ALL HAVING count(*) >= 20), t1 AS (SELECT horizon, label, avg(y) AS r FROM tr GROUP BY ALL), t0 AS (SELECT horizon, avg(y) AS r FROM tr GROUP BY ALL),
p AS (SELECT e.*, coalesce(t1.r, t0.r, r9) AS base, t2.n AS nb, t2.r AS pb FROM e2 e LEFT JOIN t2 ON t2.horizon = e.horizon AND t2.label = e.label AND t2.ab = e.ab AND t2.rb = e.rb LEFT JOIN t1 ON t1.horizon = e.horizon AND t1.label = e.label LEFT JOIN t0 ON t0.horizon = e.horizon WHERE split != 'train')
SELECT entity, trade_date, horizon, label, split, round(coalesce((nb * pb + 100 * base) / (nb + 100), base), 6) + 0.0 AS calibrated FROM p""")
def exit_calibration_shrinkage(spark, sf_dir):
    """Rates of the first 60 per cent of the dates, shrunken to the label's, for the later dates."""
    split = calibration.time_split(_calibration_rows(spark, sf_dir))
    got = calibration.shrunken(split.where("split != 'train'"), split.where("split = 'train'"), ["horizon"], ["label"], ["age_bucket", "raw_bucket"], 100.0, 20)
    return rounded(got.select("entity", "trade_date", "horizon", "label", "split", "calibrated"))


@query()
def exit_calibration_methods(spark, sf_dir):
    """Identity, logistic, isotonic and shrunken calibration of the raw exit chances, by Brier score on later dates."""
    split = calibration.time_split(_calibration_rows(spark, sf_dir)).withColumn("in_train", c("split") == "train")
    keep = ["horizon", "label", "trade_date", "entity", "y", "raw", "in_train", "method", "calibrated"]
    same = split.withColumn("calibrated", c("raw")).withColumn("method", F.lit("identity"))
    curve = calibration.platt(split, ["horizon"]).withColumn("method", F.lit("logistic"))
    steps = calibration.isotonic(split, ["horizon", "label"]).withColumn("method", F.lit("isotonic"))
    rates = calibration.shrunken(split, split.where("in_train"), ["horizon"], ["label"], ["age_bucket", "raw_bucket"], 100.0, 20).withColumn("method", F.lit("shrunken"))
    every = same.select(keep)
    for more in (curve, steps, rates):
        every = every.unionByName(more.select(keep))
    return rounded(calibration.chosen(every, ["horizon"]))


HAZARD_FEATURES = ["ret_5d", "ret_20d", "vol_20d", "amount_z", "drawdown", "ma20_slope", "age"]


def _hazard(spark, sf_dir):
    f = materialize(_features(spark, sf_dir), "features")
    rows = _exits(spark, sf_dir, f).select("entity", "trade_date", "label", "horizon", "age", "y")
    f = f.select("entity", "trade_date", *HAZARD_FEATURES[:-1])
    plan = targets.fold_plan(rows.select("trade_date"), 3, 20, 20)
    return logistic.hazard(rows.join(f, ["entity", "trade_date"]), HAZARD_FEATURES, ["label"], plan, ["horizon"])


@query()
def hazard_models(spark, sf_dir):
    """Coefficients of the exit hazard by fold and horizon, fitted on the fold's training dates."""
    models, _ = _hazard(spark, sf_dir)
    return rounded(models)


@query()
def hazard_scores(spark, sf_dir):
    """Exit chances of validation rows by models of their fold."""
    _, scored = _hazard(spark, sf_dir)
    return rounded(scored.select("fold", "horizon", "entity", "trade_date", "label", "y", "p", "hazard_status"))


REBUILD_SQL = q.base("n_name") + """, fac AS (SELECT entity, trade_date, (1.0 + floor((trade_date - DATE '1995-01-01') / 500.0) * 0.1) * CASE WHEN left(entity, 1) IN ('C', 'F') AND trade_date >= DATE '1997-01-01' THEN 1.25 ELSE 1.0 END AS f FROM bars),
ref AS (SELECT entity, arg_max(f, trade_date) AS ref FROM fac GROUP BY 1),
adj AS (SELECT bars.entity, sector, bars.trade_date, open * f / ref AS open, greatest(open, high, low, close) * f / ref AS high, least(open, high, low, close) * f / ref AS low, close * f / ref AS close, volume, amount
  FROM bars JOIN fac ON fac.entity = bars.entity AND fac.trade_date = bars.trade_date JOIN ref ON ref.entity = bars.entity),
pv AS (SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY trade_date) AS prev FROM adj),
dy AS (SELECT sector, trade_date, avg(coalesce(close / nullif(prev, 0) - 1, 0.0)) AS r, sum(volume) AS volume, sum(amount) AS amount, count(*) AS members FROM pv GROUP BY 1, 2),
ix AS (SELECT sector, trade_date, sum(ln(greatest(1 + r, 1e-6))) OVER (PARTITION BY sector ORDER BY trade_date) + ln(1000) AS lc, members, amount FROM dy),
ft AS (SELECT *, lc - lag(lc, 20) OVER (PARTITION BY sector ORDER BY trade_date) AS l20, (amount - CASE WHEN count(amount) OVER w >= 10 THEN avg(amount) OVER w END) / nullif(CASE WHEN count(amount) OVER w >= 10 THEN stddev_pop(amount) OVER w END, 0) AS az FROM ix WINDOW w AS (PARTITION BY sector ORDER BY trade_date ROWS 19 PRECEDING)),
br AS (SELECT trade_date, count(CASE WHEN close > prev THEN 1 END) AS up FROM pv GROUP BY 1)
SELECT sector AS entity, trade_date, round(lc, 5) + 0.0 AS log_close, members, round(l20, 5) + 0.0 AS log_ret_20, round(az, 5) + 0.0 AS amount_z, up FROM ft JOIN br USING (trade_date)"""


@query(REBUILD_SQL)
def dependent_rebuild(spark, sf_dir):
    """Prices, indices, features and breadth after some entities' factors changed: only what they move is made anew.

    The SQL makes everything from the changed factors.
    """
    daily, old = panel(spark, sf_dir, "n_name"), _factors(spark, sf_dir)
    new = old.withColumn("adj_factor", F.when(F.left("entity", F.lit(1)).isin("C", "F") & (c("trade_date") >= "1997-01-01"), c("adj_factor") * 1.25).otherwise(c("adj_factor")))
    who = members(spark, sf_dir).select("entity", "sector").distinct()
    builds = Builds(spark, f"{shared_dir(spark)}/builds-{uuid.uuid4().hex}")
    rebuild.build_all(builds, daily, old, who)
    rebuild.rebuild_changed(builds, daily, old, new, who)
    index, f, b = (builds.read(t) for t in ("index", "features", "breadth"))
    rows = index.select("entity", "trade_date", F.log("close").alias("log_close"), "members").join(f.select("entity", "trade_date", F.log1p("ret_20d").alias("log_ret_20"), "amount_z"), ["entity", "trade_date"])
    return rounded(rows.join(b.select("trade_date", "up"), "trade_date"), 5)
