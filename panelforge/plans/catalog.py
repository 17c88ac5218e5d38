"""All registered queries of the panel operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import scalars
from panelforge.operators import backtest, etl, evaluation, features, models, quality, ranking, segments, targets
from panelforge.plans import sql as q
from panelforge.plans.tables import members, panel, rounded, states, table
from panelforge.sources import store

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return register


def _features(spark, sf_dir):
    p = panel(spark, sf_dir)
    return features.sector_features(p, features.equal_weight_benchmark(p))


def _states(spark, sf_dir):
    return states(_features(spark, sf_dir))


def _segments(spark, sf_dir):
    return segments.state_segments(_states(spark, sf_dir))


def _factors(spark, sf_dir):
    """Adjustment factors of the nations' bars, by rule: they step up every 500 days or so."""
    days = panel(spark, sf_dir, "n_name").select("entity", "trade_date")
    return days.select("entity", "trade_date", (1.0 + F.floor(F.date_diff("trade_date", F.lit("1995-01-01").cast("date")) / 500) * 0.1).alias("adj_factor"))


FACTORS_SQL = "factors AS (SELECT entity, trade_date, 1.0 + floor((trade_date - DATE '1995-01-01') / 500.0) * 0.1 AS adj_factor FROM bars)"


@query(q.base() + f" SELECT entity, trade_date, {q.r('open', 'open')}, {q.r('high', 'high')}, {q.r('low', 'low')}, {q.r('close', 'close')}, {q.r('volume', 'volume')}, {q.r('amount', 'amount')} FROM bars")
def bars_daily(spark, sf_dir):
    return rounded(panel(spark, sf_dir))


@query(q.base(upto="feats") + f" SELECT trade_date, {q.r('b', 'benchmark_ret')} FROM bench")
def ew_benchmark_ret20(spark, sf_dir):
    return rounded(features.equal_weight_benchmark(panel(spark, sf_dir)))


FEATURES = ["close", "ret_1d", "ret_5d", "ret_20d", "vol_20d", "amount_z", "rs_20d", "drawdown", "ma20_slope", "gap_1d", "intraday"]


@query(q.base(upto="feats") + " SELECT entity, trade_date, " + ", ".join(q.r(x, x) for x in FEATURES) + " FROM feats")
def sector_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir))


def _regime_sql() -> str:
    cols = [q.r(q.pct("close", k), f"ret_{k}") for k in (1, 3, 5, 10, 20)]
    cols += [q.r(f"{q.pct('close', n)} - m{n}", f"excess_{n}") for n in (5, 10, 20)]
    cols += [q.r(f"(1 + {q.pct('close', n)}) / nullif(1 + m{n}, 0) - 1", f"rs_{n}") for n in (5, 10, 20)]
    for n in (5, 10, 20):
        mp = max(3, n // 2)
        cols += [
            q.r(f"{q.roll('stddev_pop', 'r', n, mp)} * sqrt({n})", f"vol_{n}"),
            q.r(f"close / nullif({q.roll('max', 'close', n, mp)}, 0) - 1", f"drawdown_{n}"),
            q.r(f"ma{n} / nullif({q.lag(f'ma{n}', max(1, n // 4))}, 0) - 1", f"slope_{n}"),
            q.r(q.z("amount", n, mp), f"amount_z_{n}"),
        ]
    cols += [q.r(f"{q.roll('stddev_pop', 'loss', n, 3)} * sqrt({n})", f"downside_{n}") for n in (5, 10)]
    market = ", ".join(f"{q.roll('product', '1 + m', n, n, by='')} - 1 AS m{n}" for n in (5, 10, 20))
    mas = ", ".join(f"{q.roll('avg', 'close', n, max(3, n // 2))} AS ma{n}" for n in (5, 10, 20))
    return f"""WITH {q.bars()}, {q.RETURNS}, daily AS (SELECT trade_date, avg(r) AS m FROM rets GROUP BY 1),
market AS (SELECT trade_date, {market} FROM daily),
x AS (SELECT rets.*, m5, m10, m20, CASE WHEN r > 0 THEN 0.0 ELSE r END AS loss, {mas} FROM rets LEFT JOIN market USING (trade_date))
SELECT entity, trade_date, {', '.join(cols)} FROM x"""


@query(_regime_sql())
def regime_features(spark, sf_dir):
    return rounded(features.regime_features(panel(spark, sf_dir)))


@query(q.base(upto="feats") + """,
lim AS (SELECT quantile_cont(ret_1d, 0.01) AS a, quantile_cont(ret_1d, 0.99) AS b, quantile_cont(amount_z, 0.01) AS s, quantile_cont(amount_z, 0.99) AS t FROM feats)
SELECT entity, trade_date, round(greatest(least(ret_1d, b), a), 6) + 0.0 AS ret_1d, round(CASE WHEN amount_z IS NOT NULL THEN greatest(least(amount_z, t), s) END, 6) + 0.0 AS amount_z
FROM feats, lim WHERE ret_1d IS NOT NULL""")  # fmt: skip
def winsorize(spark, sf_dir):
    f = _features(spark, sf_dir).select("entity", "trade_date", "ret_1d", "amount_z")
    return rounded(features.winsorize(f, ["ret_1d", "amount_z"]).where("ret_1d is not null"))


@query(f"""WITH {q.bars('n_name')}, {q.bars('r_name', 'secs')},
market AS (SELECT trade_date, avg(close) AS close FROM secs GROUP BY 1),
sec AS (SELECT entity AS sector, trade_date, {q.pct('close', 20)} AS s FROM secs),
mkt AS (SELECT trade_date, {q.pct('close', 20, by='')} AS m FROM market),
own0 AS (SELECT *, {q.pct('close', 20)} AS ret, {q.z('amount', 20, 10)} AS az, close / nullif({q.roll('max', 'close', 20, 10)}, 0) - 1 AS dd, {q.roll('avg', 'close', 20, 10)} AS ma FROM bars),
own AS (SELECT *, ma / nullif({q.lag('ma', 5)}, 0) - 1 AS slope FROM own0)
SELECT entity, own.trade_date AS trade_date, {q.r('ret', 'ret_20d')}, {q.r('ret - s', 'rs_sector')}, {q.r('ret - m', 'rs_market')}, {q.r('az', 'amount_z')}, {q.r('dd', 'drawdown')}, {q.r('slope', 'slope')},
  ((CASE WHEN close > ma THEN 1 ELSE 0 END) + (CASE WHEN slope > 0 THEN 1 ELSE 0 END)) / 2.0 AS trend_quality
FROM own LEFT JOIN sec ON own.sector = sec.sector AND own.trade_date = sec.trade_date LEFT JOIN mkt ON own.trade_date = mkt.trade_date""")  # fmt: skip
def stock_relative_strength(spark, sf_dir):
    sector = panel(spark, sf_dir)
    market = sector.groupBy("trade_date").agg(F.avg("close").alias("close"))
    return rounded(features.member_features(members(spark, sf_dir), sector, market))


@query(q.base() + f""", x AS (SELECT *, {q.pct('close', 1)} AS r FROM bars),
f AS (SELECT entity, trade_date, coalesce(r >= 0.3, false) AS limit_up, coalesce(r <= -0.3, false) AS limit_down,
  coalesce(open = high AND high = low AND low = close AND abs(r) >= 0.3, false) AS one_price, close IS NULL OR coalesce(volume, 0) <= 0 AS suspended FROM x),
g AS (SELECT *, sum(CASE WHEN limit_up THEN 0 ELSE 1 END) {q.over()} AS island FROM f)
SELECT entity, trade_date, limit_up, limit_down, one_price, suspended,
  CAST(CASE WHEN limit_up THEN sum(CASE WHEN limit_up THEN 1 ELSE 0 END) OVER (PARTITION BY entity, island ORDER BY trade_date) ELSE 0 END AS BIGINT) AS limit_up_run FROM g""")  # fmt: skip
def limit_flags_runs(spark, sf_dir):
    return features.limit_flags(panel(spark, sf_dir), 0.3)


@query(q.base() + f""", x AS (SELECT entity, trade_date, {q.pct('close', 20)} AS ret, {q.pct('close', 1)} AS r FROM bars WHERE entity IN ('ASIA', 'EUROPE', 'AMERICA')),
y AS (SELECT *, {q.roll('stddev_pop', 'r', 20, 10)} * sqrt(20) AS vol FROM x)
SELECT trade_date, {', '.join(f"round(max(CASE WHEN entity = '{n}' THEN {k} END), 6) + 0.0 AS {n}_{k}" for n in ('ASIA', 'EUROPE', 'AMERICA') for k in ('ret', 'vol'))},
  round(stddev_pop(ret), 6) + 0.0 AS dispersion, round(max(CASE WHEN entity = 'ASIA' THEN ret END) - max(CASE WHEN entity = 'AMERICA' THEN ret END), 6) + 0.0 AS first_vs_last
FROM y GROUP BY 1""")  # fmt: skip
def market_features_pivot(spark, sf_dir):
    return rounded(features.market_features(panel(spark, sf_dir), ["ASIA", "EUROPE", "AMERICA"]))


@query(q.base() + f""", x AS (SELECT *, {q.pct('close', 1)} AS r, ln(high / low) AS hl, ln(close / open) AS co, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs0 FROM bars),
y AS (SELECT *, CASE WHEN r > 0 THEN 0.0 ELSE r END AS loss, hl * hl / (4 * ln(2)) AS pk, greatest(0.5 * hl * hl - (2 * ln(2) - 1) * co * co, 0.0) AS gk, greatest(rs0, 0.0) AS rs FROM x),
p AS (SELECT a.entity, a.trade_date, max(1 - a2.close / a1.close) AS mdd FROM (SELECT entity, trade_date, close, row_number() {q.over()} AS i FROM bars) a
  JOIN (SELECT entity, close, row_number() {q.over()} AS i FROM bars) a1 ON a.entity = a1.entity AND a1.i BETWEEN a.i - 19 AND a.i
  JOIN (SELECT entity, close, row_number() {q.over()} AS i FROM bars) a2 ON a.entity = a2.entity AND a2.i BETWEEN a1.i AND a.i GROUP BY 1, 2)
SELECT y.entity, y.trade_date, {q.r(q.roll('stddev_pop', 'r', 20, 5, 'y.entity'), 'vol_20')}, {q.r(q.roll('stddev_pop', 'r', 60, 10, 'y.entity'), 'vol_60')}, {q.r(q.roll('stddev_pop', 'loss', 20, 5, 'y.entity'), 'downside_20')},
  {q.r('sqrt(' + q.roll('avg', 'pk', 20, 5, 'y.entity') + ')', 'parkinson')}, {q.r('sqrt(' + q.roll('avg', 'gk', 20, 5, 'y.entity') + ')', 'garman_klass')}, {q.r('sqrt(' + q.roll('avg', 'rs', 20, 5, 'y.entity') + ')', 'rogers_satchell')},
  {q.r(q.roll('avg', '(high - low) / close', 20, 5, 'y.entity'), 'range_ratio')}, {q.r('close / ' + q.roll('max', 'high', 60, 10, 'y.entity') + ' - 1', 'from_high')}, {q.r('mdd', 'max_drawdown_20')}
FROM y JOIN p ON y.entity = p.entity AND y.trade_date = p.trade_date""".replace("ORDER BY trade_date ROWS", "ORDER BY y.trade_date ROWS").replace("FROM bars),\nx", "FROM bars),\nx"))  # fmt: skip
def range_vol_estimators(spark, sf_dir):
    return rounded(features.price_baselines(panel(spark, sf_dir)))


@query(q.base() + f""", {q.RETURNS}, h AS (SELECT entity, trade_date, list(r * r) FILTER (WHERE r IS NOT NULL) OVER (PARTITION BY entity ORDER BY trade_date ROWS 199 PRECEDING) AS h FROM rets)
SELECT entity, trade_date, CASE WHEN len(h) >= 5 THEN round(sqrt(list_reduce(h, lambda s, x: (1 - 2.0 / 21) * s + 2.0 / 21 * x)), 6) + 0.0 END AS ewma_vol FROM h""")
def ewma_volatility(spark, sf_dir):
    return rounded(features.ewma_volatility(panel(spark, sf_dir)))


@query(q.base(upto="feats") + f" SELECT entity, trade_date, {q.lag('trade_date')} AS asof_date, {q.r(q.lag('ret_5d'), 'ret_5d')}, {q.r(q.lag('vol_20d'), 'vol_20d')} FROM feats")
def asof_shift(spark, sf_dir):
    return rounded(features.shifted(_features(spark, sf_dir), ["ret_5d", "vol_20d"]))


@query(q.base(upto="feats") + f" SELECT entity, trade_date, round((vol_20d - {q.roll('avg', 'vol_20d', 60, 20, skip=1)}) / nullif({q.roll('stddev_pop', 'vol_20d', 60, 20, skip=1)}, 0), 6) + 0.0 AS z FROM feats")
def causal_zscore(spark, sf_dir):
    return rounded(features.causal_zscore(_features(spark, sf_dir).select("entity", "trade_date", "vol_20d"), "vol_20d").select("entity", "trade_date", "z"))


@query(q.base("n_name") + """ SELECT entity, round(avg(CASE WHEN high >= greatest(open, low, close) AND low <= least(open, close) AND low > 0 AND volume >= 0 AND amount >= 0 THEN 1.0 ELSE 0.0 END), 6) AS valid_rate,
  avg(CASE WHEN high >= greatest(open, low, close) AND low <= least(open, close) AND low > 0 AND volume >= 0 AND amount >= 0 THEN 1.0 ELSE 0.0 END) >= 0.95 AS usable FROM bars GROUP BY 1""")  # fmt: skip
def range_reliability(spark, sf_dir):
    return rounded(features.range_reliability(panel(spark, sf_dir, "n_name")))


@query(q.base("n_name") + f", {FACTORS_SQL} SELECT entity, round(arg_max(adj_factor, trade_date), 6) AS ref_factor FROM factors WHERE adj_factor > 0 GROUP BY 1")
def reference_factor(spark, sf_dir):
    return rounded(etl.reference_factors(_factors(spark, sf_dir)))


@query(q.base("n_name") + f""", {FACTORS_SQL}, ref AS (SELECT entity, arg_max(adj_factor, trade_date) AS ref_factor FROM factors WHERE adj_factor > 0 GROUP BY 1)
SELECT bars.entity, bars.trade_date, {', '.join(f"round({e} * adj_factor / ref_factor, 6) AS {k}" for k, e in (('open', 'open'), ('high', 'greatest(open, high, low, close)'), ('low', 'least(open, high, low, close)'), ('close', 'close')))},
  round(volume, 6) AS volume, round(amount, 6) AS amount, greatest(open, high, low, close) != high OR least(open, high, low, close) != low AS repaired
FROM bars JOIN factors ON bars.entity = factors.entity AND bars.trade_date = factors.trade_date JOIN ref ON bars.entity = ref.entity""")  # fmt: skip
def qfq_adjust(spark, sf_dir):
    f = _factors(spark, sf_dir)
    return rounded(etl.adjust_prices(panel(spark, sf_dir, "n_name"), f, etl.reference_factors(f)))


@query(q.base("n_name") + f""", {FACTORS_SQL}, fresh AS (SELECT entity, trade_date, CASE WHEN dayofmonth(trade_date) = 17 THEN adj_factor + 0.05 ELSE adj_factor END AS adj_factor FROM factors),
x AS (SELECT o.entity, o.trade_date, o.adj_factor AS a, n.adj_factor AS b, abs(n.adj_factor - o.adj_factor) > 1e-10 AS ch FROM factors o JOIN fresh n ON o.entity = n.entity AND o.trade_date = n.trade_date)
SELECT entity, min(CASE WHEN ch THEN trade_date END) AS first_changed, round(arg_min(CASE WHEN ch THEN a END, CASE WHEN ch THEN trade_date END), 6) AS old_factor, round(arg_min(CASE WHEN ch THEN b END, CASE WHEN ch THEN trade_date END), 6) AS new_factor,
  count(CASE WHEN ch THEN 1 END) AS n_changed, max(trade_date) AS last_checked FROM x GROUP BY 1 HAVING count(CASE WHEN ch THEN 1 END) > 0""")  # fmt: skip
def changed_factor_detect(spark, sf_dir):
    old = _factors(spark, sf_dir)
    new = old.withColumn("adj_factor", F.when(F.dayofmonth("trade_date") == 17, c("adj_factor") + 0.05).otherwise(c("adj_factor")))
    return rounded(etl.changed_factors(old, new))


@query(q.base("n_name") + f""", x AS (SELECT *, {q.pct('close', 1)} AS r, {q.roll('avg', 'close', 20, 10)} AS ma FROM bars),
d AS (SELECT trade_date, count(CASE WHEN r > 0 THEN 1 END) AS up, count(CASE WHEN r < 0 THEN 1 END) AS down, count(CASE WHEN r = 0 THEN 1 END) AS unchanged, count(CASE WHEN r >= 0.098 THEN 1 END) AS limit_up, count(CASE WHEN r <= -0.098 THEN 1 END) AS limit_down,
  count(CASE WHEN close > ma THEN 1 END) AS above, count(ma) AS n_ma, count(r) AS valid, count(DISTINCT entity) AS entities, sum(amount) AS amount FROM x GROUP BY 1)
SELECT trade_date, up, down, unchanged, limit_up, limit_down, entities, round(up * 1.0 / nullif(valid, 0), 6) AS up_ratio, round(above * 1.0 / nullif(n_ma, 0), 6) AS above_ma20_ratio, {q.r(q.z('amount', 20, 10, by=''), 'amount_z')},
  CASE WHEN entities >= 20 AND valid >= 0.8 * entities THEN 'full' WHEN valid >= 0.4 * entities THEN 'partial' ELSE 'insufficient' END AS level FROM d""")  # fmt: skip
def market_breadth(spark, sf_dir):
    return rounded(etl.market_breadth(panel(spark, sf_dir, "n_name"), full=20))


@query(f"""WITH {q.bars('n_name')}, p AS (SELECT *, {q.lag('close')} AS prev FROM bars),
d AS (SELECT sector, trade_date, {', '.join(f"avg(coalesce({k} / nullif(prev, 0) - 1, 0.0)) AS {k}" for k in ('open', 'high', 'low', 'close'))}, sum(volume) AS volume, sum(amount) AS amount, count(*) AS members FROM p GROUP BY 1, 2),
l AS (SELECT sector, trade_date, open AS o, high AS h, low AS w, volume, amount, members, 1000 * exp(sum(ln(greatest(1 + close, 1e-6))) OVER (PARTITION BY sector ORDER BY trade_date)) AS close FROM d),
m AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY sector ORDER BY trade_date), 1000.0) AS prev FROM l),
n AS (SELECT sector, trade_date, close, volume, amount, members, prev * (1 + o) AS open, prev * (1 + h) AS high, prev * (1 + w) AS low FROM m)
SELECT sector, trade_date, round(ln(close), 5) + 0.0 AS log_close, members, round(volume, 6) AS volume, round(ln(greatest(open, high, low, close) / close), 5) + 0.0 AS log_high, round(ln(least(open, high, low, close) / close), 5) + 0.0 AS log_low FROM n""")  # fmt: skip
def sector_index_from_members(spark, sf_dir):
    x = etl.index_from_members(members(spark, sf_dir))
    return rounded(x.select("sector", "trade_date", F.round(F.log("close"), 5).alias("log_close"), "members", "volume", F.round(F.log(c("high") / c("close")), 5).alias("log_high"), F.round(F.log(c("low") / c("close")), 5).alias("log_low")))


def _basket_sql(policy: str) -> str:
    bottom = "8.0" if policy == "fixed" else "w"
    return f"""WITH {q.bars('n_name')}, m(entity, weight) AS (VALUES ('NATION_1', 3.0), ('NATION_7', 2.0), ('NATION_12', 2.0), ('NATION_20', 1.0)),
x AS (SELECT bars.*, weight, {q.pct('close', 1, 'bars.entity').replace('ORDER BY trade_date', 'ORDER BY bars.trade_date').replace('(close', '(bars.close')} AS r FROM bars JOIN m ON bars.entity = m.entity),
d AS (SELECT trade_date, sum(r * weight) AS wr, sum(CASE WHEN r IS NOT NULL THEN weight END) AS w, count(close) AS k, sum(volume) AS volume FROM x GROUP BY 1),
e AS (SELECT trade_date, CASE WHEN row_number() OVER (ORDER BY trade_date) = 1 THEN 0.0 ELSE coalesce(wr / nullif({bottom}, 0), 0.0) END AS ret, k / 4.0 AS coverage, volume FROM d)
SELECT trade_date, round(ret, 6) + 0.0 AS ret, round(coverage, 6) AS coverage, coverage < 0.5 AS low_coverage, round(volume, 6) AS volume FROM e"""


def _basket(spark, sf_dir, policy):
    weights = spark.createDataFrame([("NATION_1", 3.0), ("NATION_7", 2.0), ("NATION_12", 2.0), ("NATION_20", 1.0)], "entity string, weight double")
    return etl.basket_index(weights, panel(spark, sf_dir, "n_name"), policy)


@query(_basket_sql("fixed"))
def basket_index_fixed(spark, sf_dir):
    return rounded(_basket(spark, sf_dir, "fixed").select("trade_date", "ret", "coverage", "low_coverage", "volume"))


@query(_basket_sql("dynamic"))
def basket_index_dynamic(spark, sf_dir):
    return rounded(_basket(spark, sf_dir, "dynamic").select("trade_date", "ret", "coverage", "low_coverage", "volume"))


@query(q.base("n_name") + """, bad AS (SELECT *, volume * (CASE WHEN dayofmonth(trade_date) = 3 THEN -1 ELSE 1 END) AS v, CASE WHEN dayofmonth(trade_date) = 5 THEN low - 1 ELSE high END AS h FROM bars)
SELECT 'missing_price' AS rule, count(CASE WHEN open IS NULL OR h IS NULL OR low IS NULL OR close IS NULL THEN 1 END) AS n FROM bad
UNION ALL SELECT 'nonpositive_price', count(CASE WHEN least(open, h, low, close) <= 0 THEN 1 END) FROM bad UNION ALL SELECT 'high_below', count(CASE WHEN h < greatest(open, low, close) THEN 1 END) FROM bad
UNION ALL SELECT 'low_above', count(CASE WHEN low > least(open, close) THEN 1 END) FROM bad UNION ALL SELECT 'negative_volume', count(CASE WHEN least(v, amount) < 0 THEN 1 END) FROM bad
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT entity, trade_date FROM bad GROUP BY 1, 2 HAVING count(*) > 1)""")  # fmt: skip
def ohlc_validate(spark, sf_dir):
    p = panel(spark, sf_dir, "n_name")
    day = F.dayofmonth("trade_date")
    return quality.violations(p.withColumn("volume", c("volume") * F.when(day == 3, -1).otherwise(1)).withColumn("high", F.when(day == 5, c("low") - 1).otherwise(c("high"))))


@query(q.base("n_name") + """, l AS (SELECT entity, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY 1), d AS (SELECT DISTINCT trade_date FROM bars),
x AS (SELECT d.trade_date, count(*) AS expected FROM d, l WHERE d.trade_date BETWEEN a AND b GROUP BY 1), h AS (SELECT trade_date, count(DISTINCT entity) AS actual FROM bars GROUP BY 1)
SELECT trade_date, expected, actual, round(actual * 1.0 / expected, 6) AS coverage, CASE WHEN actual * 1.0 / expected < 0.4 THEN 'fail' WHEN actual * 1.0 / expected < 0.8 THEN 'warn' ELSE 'ok' END AS status FROM x JOIN h USING (trade_date)""")  # fmt: skip
def coverage_by_date(spark, sf_dir):
    p = panel(spark, sf_dir, "n_name")
    return rounded(quality.coverage(p, p.groupBy("entity").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 4) AS price FROM orders""")
def keyed_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", c("o_orderstatus").alias("status"), c("o_totalprice").alias("price"))
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("status"), (c("price") + 1).alias("price"))
    return rounded(store.upsert(old, new, ["o_orderkey"]), 4)


@query(q.base("n_name") + " SELECT entity, least(max(trade_date) - 10, DATE '2001-06-30') AS start FROM bars GROUP BY 1")
def incremental_start(spark, sf_dir):
    return store.incremental_start(panel(spark, sf_dir, "n_name"), F.lit("1995-01-01").cast("date"), 10, F.lit("2001-06-30").cast("date"))


@query("""SELECT p_partkey, lpad(CAST(p_partkey * 37 % 1000000 AS VARCHAR), 6, '0') AS code, CASE WHEN left(lpad(CAST(p_partkey * 37 % 1000000 AS VARCHAR), 6, '0'), 1) IN ('4', '8') OR left(lpad(CAST(p_partkey * 37 % 1000000 AS VARCHAR), 6, '0'), 3) = '920' THEN 'BJ'
  WHEN left(lpad(CAST(p_partkey * 37 % 1000000 AS VARCHAR), 6, '0'), 1) IN ('5', '6', '9') THEN 'SH' ELSE 'SZ' END AS exchange FROM part""")
def code_normalisation(spark, sf_dir):
    code = scalars.normal_code(F.concat(F.lit("x"), (c("p_partkey") * 37 % 1000000).cast("string"), F.lit(".SZ")))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).withColumn("exchange", scalars.exchange_of(c("code")))


LATEST_SQL = """, mx AS (SELECT entity, max(trade_date) AS d FROM feats WHERE ret_20d IS NOT NULL GROUP BY 1), last AS (SELECT f.* FROM feats f JOIN mx ON f.entity = mx.entity AND f.trade_date = mx.d)"""


@query(q.base(upto="feats") + LATEST_SQL + " SELECT entity, trade_date, round(close, 6) AS close, round(ret_20d, 6) + 0.0 AS ret_20d FROM last")
def latest_state(spark, sf_dir):
    return rounded(ranking.latest(_features(spark, sf_dir).where("ret_20d is not null").select("entity", "trade_date", "close", "ret_20d")))


def _probabilities(df):
    """Probabilities by rule from the features, for the operators that take a model's."""
    up, risk = scalars.sigmoid(F.coalesce("rs_20d", F.lit(0.0))), scalars.sigmoid(-4 * F.coalesce("ret_20d", F.lit(0.0)))
    total = up + risk + 0.5
    return df.select("*", (up / total).alias("p_up"), (0.5 / total).alias("p_flat"), (risk / total).alias("p_risk"))


PROB_SQL = """, pr0 AS (SELECT *, 1 / (1 + exp(-coalesce(rs_20d, 0.0))) AS u, 1 / (1 + exp(4 * coalesce(ret_20d, 0.0))) AS k FROM feats),
pr AS (SELECT *, u / (u + k + 0.5) AS p_up, 0.5 / (u + k + 0.5) AS p_flat, k / (u + k + 0.5) AS p_risk FROM pr0)"""


def _z_sql(x):
    w = "OVER (PARTITION BY trade_date)"
    return f"coalesce(greatest(least(({x} - avg({x}) {w}) / nullif(stddev_pop({x}) {w}, 0), 3.0), -3.0), 0.0)"


SCORE_SQL = f"""0.35 * p_up + 0.25 * {_z_sql('rs_20d')} + 0.15 * {_z_sql('ret_20d')} + 0.15 * {_z_sql('amount_z')} - 0.10 * {_z_sql('vol_20d')} - 0.10 * p_risk"""


@query(q.base(upto="feats") + PROB_SQL + f"""SELECT entity, trade_date, {q.r(SCORE_SQL, 'score')},
  CASE WHEN p_risk >= 0.6 OR coalesce(drawdown, 0) <= -0.15 THEN 'risk' WHEN p_up >= 0.6 AND coalesce(rs_20d, 0) > 0 AND coalesce(amount_z, 0) > 0.5 THEN 'leader'
  WHEN p_up >= 0.5 AND coalesce(ret_20d, 0) > 0 THEN 'trend' WHEN coalesce(drawdown, 0) < -0.05 AND coalesce(rs_20d, 0) > 0 THEN 'repair' ELSE 'neutral' END AS tag FROM pr""".replace("SELECT entity, trade_date, round(0.35", " SELECT entity, trade_date, round(0.35"))  # fmt: skip
def sector_rank(spark, sf_dir):
    scored = ranking.sector_scores(_probabilities(_features(spark, sf_dir)), "trade_date")
    return rounded(scored.select("entity", "trade_date", "score", "tag"))


@query(q.base(upto="feats") + """, s AS (SELECT CASE WHEN ret_20d IS NULL THEN 0 WHEN NOT coalesce(ret_20d > 0, false) THEN 1 WHEN NOT coalesce(drawdown > -0.3, false) THEN 2 WHEN NOT coalesce(amount_z > 0, false) THEN 3 ELSE 4 END AS f FROM feats)
SELECT k AS step, rule, count(CASE WHEN f >= k - 1 THEN 1 END) AS before, count(CASE WHEN f >= k THEN 1 END) AS after, count(CASE WHEN f = k - 1 THEN 1 END) AS removed
FROM s, (VALUES (CAST(1 AS BIGINT), 'history'), (2, 'momentum'), (3, 'drawdown'), (4, 'turnover')) v(k, rule) GROUP BY 1, 2""")  # fmt: skip
def stock_filter_funnel(spark, sf_dir):
    return ranking.funnel(_features(spark, sf_dir), [("history", c("ret_20d").isNotNull()), ("momentum", c("ret_20d") > 0), ("drawdown", c("drawdown") > -0.3), ("turnover", c("amount_z") > 0)])


@query(q.base("n_name", "feats") + """, x AS (SELECT entity, trade_date, vol_20d, rank() OVER (PARTITION BY trade_date ORDER BY vol_20d NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, vol_20d) - 1) / 2.0 AS rk, count(vol_20d) OVER (PARTITION BY trade_date) AS n FROM feats),
y AS (SELECT entity, trade_date, CASE WHEN vol_20d IS NOT NULL THEN rk / n END AS p FROM x)
SELECT entity, trade_date, round(p, 6) AS pct_rank, CASE WHEN p IS NULL THEN 'unknown' WHEN p >= 0.8 THEN 'high' WHEN p >= 0.6 THEN 'elevated' WHEN p <= 0.2 THEN 'low' ELSE 'normal' END AS band FROM y""")  # fmt: skip
def percentile_rank_bands(spark, sf_dir):
    p = panel(spark, sf_dir, "n_name")
    f = features.sector_features(p, features.equal_weight_benchmark(p)).select("entity", "trade_date", "vol_20d")
    return rounded(ranking.percentile_bands(f, "vol_20d", "trade_date").drop("vol_20d"))


@query(q.base(upto="states") + """, x AS (SELECT entity, trade_date, label, lag(label) OVER (PARTITION BY entity ORDER BY trade_date) AS p FROM states)
SELECT entity, trade_date, p AS from_label, label AS to_label FROM x WHERE p IS NOT NULL AND p != label ORDER BY trade_date DESC, entity LIMIT 20""")
def recent_switches(spark, sf_dir):
    return ranking.recent_switches(_states(spark, sf_dir), 20)


@query(q.base("n_name") + " SELECT entity, trade_date, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY trade_date DESC) AS k FROM bars) WHERE k <= 30")
def last_rows_per_entity(spark, sf_dir):
    return rounded(ranking.last_rows(panel(spark, sf_dir, "n_name").select("entity", "trade_date", "close"), 30))


SEG_COLS = "entity, segment, label, start_date, end_date, n_days, calendar_days, round(segment_return, 6) + 0.0 AS segment_return, round(max_drawdown, 6) + 0.0 AS max_drawdown, prev_label, next_label, prev_days"


@query(q.base(upto="segs") + f" SELECT {SEG_COLS} FROM segs")
def state_segments(spark, sf_dir):
    return rounded(_segments(spark, sf_dir))


@query(q.base(upto="segs") + """, l AS (SELECT entity, max(segment) AS segment FROM segs GROUP BY 1)
SELECT segs.entity, start_date AS switch_date, prev_label AS from_label, label AS to_label, n_days, prev_days FROM segs JOIN l ON segs.entity = l.entity AND segs.segment = l.segment WHERE label = 'flat' AND n_days <= 30 AND coalesce(prev_days, 0) >= 1""")
def transition_screen(spark, sf_dir):
    return segments.transition_screen(_segments(spark, sf_dir), "flat", 30, 1)


@query(q.base(upto="states") + """, x AS (SELECT label AS a, lead(label) OVER (PARTITION BY entity ORDER BY trade_date) AS b FROM states), n AS (SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT a AS from_label, b AS to_label, n, round(n * 1.0 / sum(n) OVER (PARTITION BY a), 6) AS share FROM n""")
def transition_matrix(spark, sf_dir):
    return rounded(segments.transition_matrix(_states(spark, sf_dir)))


@query(q.base(upto="segs") + """, x AS (SELECT entity, count(*) AS n_segments, sum(n_days) AS d, avg(n_days) AS dwell_mean, quantile_cont(n_days, 0.5) AS dwell_median, quantile_cont(n_days, 0.1) AS dwell_p10, quantile_cont(n_days, 0.9) AS dwell_p90, avg(CASE WHEN n_days = 1 THEN 1.0 ELSE 0.0 END) AS single_day_share FROM segs GROUP BY 1),
y AS (SELECT *, (n_segments - 1) * 1.0 / nullif(d - 1, 0) AS transition_rate FROM x)
SELECT entity, n_segments, round(dwell_mean, 6) AS dwell_mean, round(dwell_median, 6) AS dwell_median, round(dwell_p10, 6) AS dwell_p10, round(dwell_p90, 6) AS dwell_p90, round(single_day_share, 6) AS single_day_share, round(transition_rate, 6) AS transition_rate,
  CASE WHEN transition_rate >= 0.3 THEN 'excessive' WHEN transition_rate >= 0.15 THEN 'high' WHEN transition_rate >= 0.05 THEN 'normal' ELSE 'sticky' END AS bucket FROM y""")  # fmt: skip
def churn_dwell(spark, sf_dir):
    return rounded(segments.churn(_segments(spark, sf_dir)))


@query(q.base(upto="segs") + """, x AS (SELECT *, prev_label IS NULL OR next_label IS NULL AS cut, CASE WHEN prev_label IS NOT NULL AND next_label IS NOT NULL THEN n_days END AS d FROM segs)
SELECT coalesce(label, '__ALL__') AS label, count(*) AS n_episodes, count(CASE WHEN cut THEN 1 END) AS n_censored, round(avg(d), 6) AS mean_days, round(quantile_cont(d, 0.5), 6) AS median_days, max(d) AS max_days, round(count(CASE WHEN cut THEN 1 END) * 1.0 / count(*), 6) AS censored_share
FROM x GROUP BY ROLLUP (label)""")  # fmt: skip
def duration_profile(spark, sf_dir):
    return rounded(segments.duration_profile(_segments(spark, sf_dir)))


EXIT_SQL = """, ps AS (SELECT entity, trade_date, label, segment, row_number() OVER (PARTITION BY entity ORDER BY trade_date) AS pos, count(*) OVER (PARTITION BY entity) AS n FROM runs),
pe AS (SELECT *, max(pos) OVER (PARTITION BY entity, segment) AS e FROM ps), ex AS (SELECT *, CASE WHEN e < n THEN e + 1 - pos END AS exit_lag FROM pe)"""


@query(q.base(upto="segs") + EXIT_SQL + " SELECT entity, trade_date, label, exit_lag, " + ", ".join(f"CASE WHEN exit_lag <= {h} THEN true WHEN pos + {h} <= n THEN false END AS exit_{h}" for h in (1, 5)) + " FROM ex")
def exit_targets(spark, sf_dir):
    return segments.exit_targets(_states(spark, sf_dir), [1, 5])


@query(q.base(upto="segs") + EXIT_SQL + """, y AS (SELECT ex.label, CASE WHEN exit_lag <= 1 THEN 1.0 WHEN pos + 1 <= n THEN 0.0 END AS y, 1 / (1 + exp(-abs(s.ret_20d))) AS p FROM ex JOIN states s ON ex.entity = s.entity AND ex.trade_date = s.trade_date)
SELECT label, CAST(least(floor(p * 5), 4) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS realised, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(p) - avg(y), 6) + 0.0 AS error FROM y WHERE y IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def exit_calibration(spark, sf_dir):
    s = _states(spark, sf_dir)
    t = segments.exit_targets(s, [1]).join(s.select("entity", "trade_date", scalars.sigmoid(F.abs("ret_20d")).alias("p")), ["entity", "trade_date"])
    return rounded(segments.calibration_table(t, "p", "exit_1"))


@query(q.base(upto="feats") + PROB_SQL + """, x AS (SELECT entity, trade_date, list_sort([p_up, p_flat, p_risk], 'DESC') AS p, -(p_up * ln(p_up) + p_flat * ln(p_flat) + p_risk * ln(p_risk)) AS entropy FROM pr)
SELECT entity, trade_date, round(p[1], 6) AS top, round(p[1] - p[2], 6) AS margin, round(entropy, 6) AS entropy, round(entropy / ln(3), 6) AS normalised_entropy, CASE WHEN p[1] >= 0.7 AND p[1] - p[2] >= 0.4 THEN 'high' WHEN p[1] >= 0.5 AND p[1] - p[2] >= 0.15 THEN 'medium' ELSE 'low' END AS confidence FROM x""")  # fmt: skip
def posterior_confidence(spark, sf_dir):
    x = segments.posterior_confidence(_probabilities(_features(spark, sf_dir)), ["p_up", "p_flat", "p_risk"])
    return rounded(x.select("entity", "trade_date", "top", "margin", "entropy", "normalised_entropy", "confidence"))


FWD_SQL = ", fwd AS (SELECT entity, trade_date, " + q.lead("trade_date") + " AS exec_date, " + ", ".join(f"{q.lead('trade_date', h)} AS exit_date_{h}, {q.lead('close', h)} / nullif(CASE WHEN {q.lead('open')} > 0 THEN {q.lead('open')} END, 0) - 1 AS fwd_{h}" for h in (1, 5)) + " FROM bars)"


@query(q.base() + FWD_SQL + " SELECT entity, trade_date, exec_date, exit_date_1, exit_date_5, round(fwd_1, 6) + 0.0 AS fwd_1, round(fwd_5, 6) + 0.0 AS fwd_5 FROM fwd")
def tradable_forward_return(spark, sf_dir):
    return rounded(targets.tradable_forward_returns(panel(spark, sf_dir), [1, 5]))


@query(q.base() + f" SELECT entity, trade_date, round({q.lead('open', 2)} / nullif({q.lead('open', 1)}, 0) - 1, 6) + 0.0 AS open_ret FROM bars")
def next_open_returns(spark, sf_dir):
    return rounded(targets.next_open_returns(panel(spark, sf_dir)))


def _path_sql(h: int) -> str:
    rel = [f"{q.lead('close', i)} / close - 1" for i in range(1, h + 1)]
    prev = ["close"] + [q.lead("close", i) for i in range(1, h)]
    step = [f"{q.lead('close', i)} / {prev[i - 1]} - 1 AS s{i}" for i in range(1, h + 1)]
    mdd = [f"1 - {q.lead('close', j)} / {q.lead('close', i) if i else 'close'}" for i in range(h) for j in range(i + 1, h + 1)]
    s = [f"s{i}" for i in range(1, h + 1)]
    mean = f"(({' + '.join(s)}) / {h})"
    k = " + ".join(f"(CASE WHEN {x} < 0 THEN 1 ELSE 0 END)" for x in s)
    m = "(" + " + ".join(f"(CASE WHEN {x} < 0 THEN {x} ELSE 0 END)" for x in s) + ") / nullif(k, 0)"
    return f"""{q.base()}, x AS (SELECT entity, trade_date, {q.lead('close', h)} AS last, {rel[-1]} AS fr, least({', '.join(rel)}) AS mae, greatest({', '.join(mdd)}, 0.0) AS mdd, {', '.join(step)} FROM bars),
y AS (SELECT *, {mean} AS m, {k} AS k FROM x), z AS (SELECT *, {m} AS mm FROM y)
SELECT entity, trade_date, round(fr, 6) + 0.0 AS future_return, round(CASE WHEN last IS NOT NULL THEN mae END, 6) + 0.0 AS future_mae, round(CASE WHEN last IS NOT NULL THEN mdd END, 6) + 0.0 AS future_mdd,
  round(sqrt(({' + '.join(f'({x} - m) * ({x} - m)' for x in s)}) / {h}), 6) + 0.0 AS future_vol,
  round(CASE WHEN last IS NOT NULL THEN coalesce(sqrt(({' + '.join(f'(CASE WHEN {x} < 0 THEN ({x} - mm) * ({x} - mm) ELSE 0 END)' for x in s)}) / nullif(k, 0)), 0.0) END, 6) + 0.0 AS downside_vol FROM z"""


@query(_path_sql(5))
def path_metrics(spark, sf_dir):
    return rounded(targets.path_metrics(panel(spark, sf_dir), 5))


@query(q.base() + ", x AS (" + " UNION ALL ".join(f"SELECT entity, trade_date, CAST({h} AS BIGINT) AS horizon, min(close) {q.over(f'ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING')} / close - 1 AS mae, {q.lead('trade_date', h)} AS e FROM bars" for h in (5, 10)) + """)
SELECT entity, trade_date, horizon, round(mae, 6) + 0.0 AS mae, threshold, CASE WHEN e IS NULL THEN 'insufficient_future' WHEN e > DATE '2000-12-31' THEN 'cross_cutoff' ELSE 'labeled' END AS status,
  CASE WHEN e IS NOT NULL AND e <= DATE '2000-12-31' THEN mae <= -threshold END AS event FROM x, (VALUES (CAST(0.1 AS DOUBLE)), (0.3)) v(threshold)""")  # fmt: skip
def mae_events(spark, sf_dir):
    return rounded(targets.mae_events(panel(spark, sf_dir), [5, 10], [0.1, 0.3], F.lit("2000-12-31").cast("date")))


@query(q.base() + """, d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM bars)), k AS (SELECT unnest(generate_series(1, 4)) AS fold),
x AS (SELECT fold, trade_date, pos, fold * (n // 5) + least(fold, n % 5) + 1 AS a, (fold + 1) * (n // 5) + least(fold + 1, n % 5) + 1 AS b FROM d, k)
SELECT CAST(fold AS BIGINT) AS fold, trade_date, CASE WHEN pos < a - 10 THEN 'train' WHEN pos < a THEN 'purged' WHEN pos < b THEN 'validation' ELSE 'embargo' END AS role FROM x WHERE pos < b + 20""")  # fmt: skip
def purge_embargo_folds(spark, sf_dir):
    return targets.fold_plan(panel(spark, sf_dir), 4, 10, 20)


@query(q.base() + f""", t AS (SELECT entity, trade_date AS s, {q.lead('trade_date', 5)} AS e FROM bars)
SELECT a.entity, a.s AS start, a.e AS "end", CAST(count(b.s) AS BIGINT) AS overlapping FROM (SELECT * FROM t WHERE e IS NOT NULL) a LEFT JOIN (SELECT * FROM t WHERE e IS NOT NULL) b ON a.entity = b.entity AND b.s < a.s AND b.e >= a.s GROUP BY 1, 2, 3""")
def overlapping_target_windows(spark, sf_dir):
    from panelforge.panel import in_time

    t = panel(spark, sf_dir).select("entity", c("trade_date").alias("start"), F.lead("trade_date", 5).over(in_time()).alias("end"))
    return targets.overlapping_windows(t.where("end is not null"))


@query(q.base(upto="segs") + """, a AS (SELECT entity, start_date, end_date FROM segs WHERE label = 'up'), b AS (SELECT entity, trade_date AS s, trade_date + 3 AS e FROM feats WHERE amount_z > 2.5)
SELECT a.entity, a.start_date AS start, a.end_date AS "end", count(b.s) > 0 AS overlaps FROM a LEFT JOIN b ON a.entity = b.entity AND b.s <= a.end_date AND b.e >= a.start_date GROUP BY 1, 2, 3""")
def interval_overlap(spark, sf_dir):
    a = _segments(spark, sf_dir).where("label = 'up'").select("entity", c("start_date").alias("start"), c("end_date").alias("end"))
    b = _features(spark, sf_dir).where("amount_z > 2.5").select("entity", c("trade_date").alias("start"), F.date_add("trade_date", 3).alias("end"))
    return targets.overlaps_any(a, b)


@query(q.base() + " SELECT CAST(date_trunc('month', trade_date) AS DATE) AS period, max(trade_date) AS checkpoint FROM bars GROUP BY 1")
def checkpoint_dates(spark, sf_dir):
    return targets.checkpoint_dates(panel(spark, sf_dir))


@query(q.base("n_name") + """, d AS (SELECT DISTINCT trade_date FROM bars WHERE trade_date <= DATE '2000-06-30' ORDER BY 1 DESC LIMIT 250), x AS (SELECT bars.* FROM bars SEMI JOIN d ON bars.trade_date = d.trade_date), e AS (SELECT entity FROM x GROUP BY 1 HAVING count(*) >= 60)
SELECT x.entity, count(*) AS n, min(trade_date) AS first_date, round(avg(close), 4) AS mean_close FROM x SEMI JOIN e ON x.entity = e.entity GROUP BY 1""")
def training_window(spark, sf_dir):
    t = targets.training_window(panel(spark, sf_dir, "n_name"), F.lit("2000-06-30").cast("date"), 250, 60)
    return rounded(t.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_date"), F.avg("close").alias("mean_close")), 4)


@query(q.base(upto="feats") + ", v AS (SELECT entity, trade_date, vol_20d / sqrt(20) AS sigma FROM feats) SELECT entity, trade_date, round(sigma, 6) AS sigma, CAST(h AS BIGINT) AS horizon, k AS factor, round(CASE WHEN sigma IS NOT NULL THEN greatest(least(sigma * sqrt(h) * k, 0.15), 0.02) END, 6) AS threshold FROM v, (VALUES (5), (20)) a(h), (VALUES (CAST(0.01 AS DOUBLE)), (0.05)) b(k)")
def vol_scaled_thresholds(spark, sf_dir):
    return rounded(targets.scaled_thresholds(panel(spark, sf_dir), [5, 20], [0.01, 0.05]))


def _signal(spark, sf_dir):
    p = panel(spark, sf_dir, "n_name")
    f = features.sector_features(p, features.equal_weight_benchmark(p))
    return f.join(targets.tradable_forward_returns(p, [5]).select("entity", "trade_date", "fwd_5"), ["entity", "trade_date"])


SIGNAL_SQL = q.base("n_name", "feats") + FWD_SQL + ", sig AS (SELECT feats.*, fwd_5 FROM feats JOIN fwd ON feats.entity = fwd.entity AND feats.trade_date = fwd.trade_date)"
SIGNAL_STATES = ", ss AS (SELECT *, CASE WHEN ret_20d > 0.2 THEN 'up' WHEN ret_20d < -0.2 THEN 'down' WHEN ret_20d IS NOT NULL THEN 'flat' END AS label FROM sig)"


@query(SIGNAL_SQL + SIGNAL_STATES + """ SELECT label, count(*) AS n, count(DISTINCT trade_date) AS n_dates, round(avg(fwd_5), 6) + 0.0 AS mean, round(quantile_cont(fwd_5, 0.5), 6) + 0.0 AS median, round(avg(CASE WHEN fwd_5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(stddev_pop(fwd_5), 6) AS std,
  round(coalesce(stddev_pop(CASE WHEN fwd_5 < 0 THEN fwd_5 END), 0.0), 6) AS downside_std, round(quantile_cont(fwd_5, 0.1), 6) + 0.0 AS p10, round(quantile_cont(fwd_5, 0.25), 6) + 0.0 AS p25, round(quantile_cont(fwd_5, 0.75), 6) + 0.0 AS p75, round(quantile_cont(fwd_5, 0.9), 6) + 0.0 AS p90
FROM ss WHERE fwd_5 IS NOT NULL AND label IS NOT NULL GROUP BY 1""")  # fmt: skip
def state_forward_profile(spark, sf_dir):
    label = F.when(c("ret_20d") > 0.2, "up").when(c("ret_20d") < -0.2, "down").when(c("ret_20d").isNotNull(), "flat")
    return rounded(evaluation.forward_profile(_signal(spark, sf_dir).withColumn("label", label), "label", "fwd_5"))


IC_SQL = """, o AS (SELECT trade_date, rs_20d, fwd_5 FROM sig WHERE rs_20d IS NOT NULL AND fwd_5 IS NOT NULL),
rk AS (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY rs_20d) + (count(*) OVER (PARTITION BY trade_date, rs_20d) - 1) / 2.0 AS x, rank() OVER (PARTITION BY trade_date ORDER BY fwd_5) + (count(*) OVER (PARTITION BY trade_date, fwd_5) - 1) / 2.0 AS y FROM o),
ic AS (SELECT trade_date, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 12) AS ic FROM rk GROUP BY 1 HAVING count(*) >= 3)"""


@query(SIGNAL_SQL + IC_SQL + " SELECT trade_date, n, round(ic, 6) + 0.0 AS ic FROM ic")
def cross_sectional_ic(spark, sf_dir):
    return rounded(evaluation.information_coefficient(_signal(spark, sf_dir), "rs_20d", "fwd_5"))


@query(SIGNAL_SQL + IC_SQL + """ SELECT count(*) AS n_dates, round(avg(ic), 6) + 0.0 AS mean, round(quantile_cont(ic, 0.5), 6) + 0.0 AS median, round(stddev_samp(ic), 6) AS std, round(avg(ic) * sqrt(count(*)) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS t_stat, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share FROM ic WHERE ic IS NOT NULL""")
def ic_summary(spark, sf_dir):
    return rounded(evaluation.ic_summary(evaluation.information_coefficient(_signal(spark, sf_dir), "rs_20d", "fwd_5")))


@query(SIGNAL_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY rs_20d, entity) AS r, count(*) OVER (PARTITION BY trade_date) AS n FROM sig WHERE rs_20d IS NOT NULL AND fwd_5 IS NOT NULL)
SELECT CAST(greatest(1, ceil((r - 1) * 5 / CAST(greatest(n - 1, 1) AS DOUBLE))) AS BIGINT) AS bucket, count(*) AS n, round(avg(fwd_5), 6) + 0.0 AS mean_target, round(avg(CASE WHEN fwd_5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM o WHERE n >= 5 GROUP BY 1""")
def score_buckets(spark, sf_dir):
    return rounded(evaluation.score_buckets(_signal(spark, sf_dir), "rs_20d", "fwd_5", 5))


@query(SIGNAL_SQL + """, o AS (SELECT entity, vol_20d AS s, CASE WHEN fwd_5 < -0.2 THEN 1 ELSE 0 END AS y FROM sig WHERE vol_20d IS NOT NULL AND fwd_5 IS NOT NULL),
k AS (SELECT entity, y, rank() OVER (PARTITION BY entity ORDER BY s) + (count(*) OVER (PARTITION BY entity, s) - 1) / 2.0 AS r FROM o)
SELECT entity, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM k GROUP BY 1""")
def rank_auc(spark, sf_dir):
    s = _signal(spark, sf_dir).where("fwd_5 is not null").withColumn("hit", c("fwd_5") < -0.2)
    return rounded(evaluation.auc(s, "vol_20d", "hit", "entity"))


CURVE_SQL = SIGNAL_SQL + """, o AS (SELECT 1 / (1 + exp(-rs_20d)) AS p, CASE WHEN fwd_5 > 0 THEN 1.0 ELSE 0.0 END AS y FROM sig WHERE rs_20d IS NOT NULL AND fwd_5 IS NOT NULL),
cv AS (SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM o GROUP BY 1)"""


def _curve(spark, sf_dir):
    s = _signal(spark, sf_dir).where("rs_20d is not null and fwd_5 is not null")
    return evaluation.calibration_curve(s.select(scalars.sigmoid(c("rs_20d")).alias("p"), (c("fwd_5") > 0).alias("y")), "p", "y")


@query(CURVE_SQL + " SELECT bin, n, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed FROM cv")
def calibration_curve(spark, sf_dir):
    return rounded(_curve(spark, sf_dir))


@query(CURVE_SQL + " SELECT round(sum(abs(mean_p - observed) * n) / sum(n), 6) AS ece, round(max(abs(mean_p - observed)), 6) AS mce, round(regr_slope(observed, mean_p), 5) AS slope, round(regr_intercept(observed, mean_p), 5) AS intercept FROM cv")
def calibration_errors(spark, sf_dir):
    return rounded(rounded(evaluation.calibration_errors(_curve(spark, sf_dir))).withColumns({x: F.round(x, 5) for x in ("slope", "intercept")}))


EVENT_SQL = q.base("n_name") + f", ev AS (SELECT entity, trade_date, min(close) {q.over('ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING')} / close - 1 <= -0.3 AS event FROM bars QUALIFY {q.lead('trade_date', 5)} IS NOT NULL)"


def _events(spark, sf_dir):
    return targets.mae_events(panel(spark, sf_dir, "n_name"), [5], [0.3]).where("event is not null")


@query(EVENT_SQL + ", k AS (SELECT entity, count(*) AS k FROM ev WHERE event GROUP BY 1) SELECT CAST(sum(k) AS BIGINT) AS n, count(*) AS n_keys, round(max(k) * 1.0 / sum(k), 6) AS max_share, round(sum(k * k) * 1.0 / (sum(k) * sum(k)), 6) AS hhi, round(quantile_cont(k, 0.5), 6) AS median FROM k")
def event_concentration(spark, sf_dir):
    return rounded(evaluation.concentration(_events(spark, sf_dir).where("event"), "entity"))


@query(EVENT_SQL + """, d AS (SELECT trade_date, avg(CASE WHEN event THEN 1.0 ELSE 0.0 END) AS share FROM ev GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS pos FROM d), a AS (SELECT *, pos - lag(pos) OVER (ORDER BY trade_date) AS gap FROM p WHERE share >= 0.75),
b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 5 THEN 1 ELSE 0 END) OVER (ORDER BY trade_date) AS block FROM a)
SELECT CAST(block AS BIGINT) AS block, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS n_dates, round(max(share), 6) AS peak_share FROM b GROUP BY 1""")  # fmt: skip
def market_event_blocks(spark, sf_dir):
    return rounded(evaluation.market_blocks(_events(spark, sf_dir), 0.75, 5))


@query(SIGNAL_SQL + ", m AS (SELECT entity, avg(fwd_5) AS m FROM sig WHERE fwd_5 IS NOT NULL GROUP BY 1) SELECT count(*) AS n_clusters, round(avg(m), 6) AS mean, round(avg(m) - 1.96 * stddev_samp(m) / sqrt(count(*)), 6) AS low, round(avg(m) + 1.96 * stddev_samp(m) / sqrt(count(*)), 6) AS high FROM m")
def clustered_mean(spark, sf_dir):
    return rounded(evaluation.clustered_mean(_signal(spark, sf_dir), "fwd_5", "entity"))


@query(EVENT_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY trade_date DESC) AS k FROM ev), r AS (SELECT entity, count(*) AS n, avg(CASE WHEN event THEN 1.0 ELSE 0.0 END) AS own FROM k WHERE k <= 20 GROUP BY 1)
SELECT entity, n, round(CASE WHEN n >= 5 THEN own ELSE (SELECT avg(CASE WHEN event THEN 1.0 ELSE 0.0 END) FROM ev) END, 6) AS rate FROM r""")
def empirical_event_rates(spark, sf_dir):
    return rounded(evaluation.empirical_rates(_events(spark, sf_dir)))


@query(q.base(upto="segs") + EXIT_SQL + """, g AS (SELECT *, row_number() OVER (PARTITION BY entity, segment ORDER BY trade_date) AS age, CASE WHEN exit_lag <= 5 THEN true WHEN pos + 5 <= n THEN false END AS y FROM ex)
SELECT label, CASE WHEN age <= 3 THEN '01-03' WHEN age <= 7 THEN '04-07' WHEN age <= 14 THEN '08-14' ELSE '15+' END AS age_bucket, count(y) AS n_valid, count(CASE WHEN y THEN 1 END) AS n_pos, count(CASE WHEN y IS NULL THEN 1 END) AS n_censored,
  CASE WHEN count(y) >= 30 THEN round(count(CASE WHEN y THEN 1 END) * 1.0 / count(y), 6) END AS rate FROM g GROUP BY 1, 2""")  # fmt: skip
def age_bucket_baseline(spark, sf_dir):
    from panelforge.panel import in_time, islands

    s = _states(spark, sf_dir)
    aged = islands(s, "label").withColumn("age", F.row_number().over(in_time("entity", "segment"))).select("entity", "trade_date", "age")
    return rounded(evaluation.age_baseline(segments.exit_targets(s, [5]).join(aged, ["entity", "trade_date"]), "label", "age", "exit_5"))


@query(q.base("n_name", "feats") + f""", d AS (SELECT trade_date, avg(vol_20d) AS a, stddev_samp(ret_1d) AS b, avg(amount_z) AS e FROM feats GROUP BY 1),
zz AS (SELECT trade_date, {', '.join(f"({x} - {q.roll('avg', x, 60, 20, by='', skip=1)}) / nullif({q.roll('stddev_pop', x, 60, 20, by='', skip=1)}, 0) AS z{x}" for x in 'abe')} FROM d),
y AS (SELECT *, list_filter([za, zb, ze], lambda x: x IS NOT NULL) AS h FROM zz), w AS (SELECT *, len(list_filter(h, lambda x: x >= 2)) AS hi, len(list_filter(h, lambda x: x >= 1 AND x < 2)) AS me FROM y)
SELECT trade_date, CASE WHEN len(h) < 2 THEN 'insufficient' WHEN hi >= 2 THEN 'high' WHEN hi = 1 OR me >= 2 THEN 'elevated' WHEN me = 1 THEN 'watch' ELSE 'normal' END AS level,
  concat_ws(',', CASE WHEN za >= 1 THEN 'vol' END, CASE WHEN zb >= 1 THEN 'dispersion' END, CASE WHEN ze >= 1 THEN 'turnover' END) AS drivers FROM w""")  # fmt: skip
def break_warnings(spark, sf_dir):
    p = panel(spark, sf_dir, "n_name")
    f = features.sector_features(p, features.equal_weight_benchmark(p))
    day = f.groupBy("trade_date").agg(F.avg("vol_20d").alias("vol"), F.stddev_samp("ret_1d").alias("dispersion"), F.avg("amount_z").alias("turnover"))
    for name in ("vol", "dispersion", "turnover"):
        day = features.causal_zscore(day, name, entity=()).withColumn(f"z_{name}", c("z")).drop("z")
    day = day.select("trade_date", *(c(f"z_{n}").alias(n) for n in ("vol", "dispersion", "turnover")))
    return evaluation.stress_levels(day, ["vol", "dispersion", "turnover"]).select("trade_date", "level", "drivers")


BACKTEST_SQL = q.base("n_name", "feats") + """, ds AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, lead(trade_date) OVER (ORDER BY trade_date) AS exec_date FROM (SELECT DISTINCT trade_date FROM feats)),
rb AS (SELECT * FROM ds WHERE i % 20 = 0 AND exec_date IS NOT NULL),
rk AS (SELECT rb.exec_date, entity, row_number() OVER (PARTITION BY rb.exec_date ORDER BY rs_20d DESC, entity) AS k FROM feats JOIN rb ON feats.trade_date = rb.trade_date WHERE rs_20d IS NOT NULL),
ev AS (SELECT exec_date, entity, 1.0 / count(*) OVER (PARTITION BY exec_date) AS weight FROM rk WHERE k <= 5),
od AS (SELECT exec_date, row_number() OVER (ORDER BY exec_date) AS j, lead(exec_date) OVER (ORDER BY exec_date) AS next_date FROM (SELECT DISTINCT exec_date FROM ev)),
wc AS (SELECT j, entity, weight AS w FROM ev JOIN od ON ev.exec_date = od.exec_date UNION ALL SELECT j + 1, entity, -weight FROM ev JOIN od ON ev.exec_date = od.exec_date),
ch AS (SELECT od.exec_date, t.turnover FROM (SELECT j, sum(d) AS turnover FROM (SELECT j, entity, abs(sum(w)) AS d FROM wc GROUP BY 1, 2) GROUP BY 1) t JOIN od ON od.j = t.j),
rr AS (SELECT entity, trade_date, coalesce(r, 0.0) AS r FROM rets),
dy AS (SELECT d.trade_date, max(od.exec_date) OVER (ORDER BY d.trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS exec_date FROM (SELECT DISTINCT trade_date FROM feats) d LEFT JOIN od ON od.exec_date = d.trade_date),
gr AS (SELECT dy.trade_date, sum(weight * r) AS gross FROM dy JOIN ev ON ev.exec_date = dy.exec_date JOIN rr ON rr.entity = ev.entity AND rr.trade_date = dy.trade_date GROUP BY 1),
cu AS (SELECT d.trade_date, coalesce(gross, 0.0) AS gross, coalesce(turnover, 0.0) AS turnover, coalesce(gross, 0.0) - coalesce(turnover, 0.0) * 0.001 AS net
  FROM (SELECT DISTINCT trade_date FROM feats) d LEFT JOIN gr ON d.trade_date = gr.trade_date LEFT JOIN ch ON d.trade_date = ch.exec_date WHERE d.trade_date >= (SELECT min(exec_date) FROM od))"""


def _rebalanced(spark, sf_dir):
    p = panel(spark, sf_dir, "n_name")
    f = features.sector_features(p, features.equal_weight_benchmark(p))
    return p, backtest.rebalance_events(f.select("entity", "trade_date", c("rs_20d").alias("score")), 20, 5)


@query(BACKTEST_SQL + " SELECT exec_date, entity, round(weight, 6) AS weight FROM ev")
def rebalance_events(spark, sf_dir):
    return rounded(_rebalanced(spark, sf_dir)[1])


@query(BACKTEST_SQL + " SELECT trade_date, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(net, 6) + 0.0 AS net FROM cu")
def portfolio_curve(spark, sf_dir):
    p, events = _rebalanced(spark, sf_dir)
    return rounded(backtest.simulate(p, events, 0.001))


@query(BACKTEST_SQL + """, g AS (SELECT unnest([0, 1, 3]) AS k), n AS (SELECT k, gross - turnover * k / 1000 AS net, turnover FROM cu, g)
  SELECT CAST(k AS DOUBLE) / 1000 AS cost, round(ln(product(1 + net)), 6) + 0.0 AS log_total_return, round(avg(net), 8) + 0.0 AS mean_net, round(sum(turnover), 6) AS turnover FROM n GROUP BY k""")
def cost_sensitivity(spark, sf_dir):
    p, events = _rebalanced(spark, sf_dir)
    grid = backtest.cost_grid(backtest.simulate(p, events, 0.0), [0.0, 0.001, 0.003])
    return grid.select("cost", (F.round(F.log1p("total_return"), 6) + 0.0).alias("log_total_return"), (F.round("mean_net", 8) + 0.0).alias("mean_net"), F.round("turnover", 6).alias("turnover"))


@query(BACKTEST_SQL + """, nv AS (SELECT *, product(1 + net) OVER (ORDER BY trade_date) AS nav FROM cu), dd AS (SELECT *, nav / nullif(max(nav) OVER (ORDER BY trade_date), 0) - 1 AS d FROM nv),
  s AS (SELECT count(*) AS n_days, power(arg_max(nav, trade_date), 252.0 / count(*)) - 1 AS annual, min(d) AS fall, avg(net) * sqrt(252) / nullif(stddev_pop(net), 0) AS sharpe, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win, sum(turnover) AS turnover FROM dd)
  SELECT n_days, round(annual, 5) AS annual_return, round(fall, 6) AS max_drawdown, round(sharpe, 5) AS sharpe, round(annual / nullif(-fall, 0), 5) AS calmar, round(win, 6) AS win_rate, round(turnover, 6) AS turnover FROM s""")
def portfolio_metrics(spark, sf_dir):
    p, events = _rebalanced(spark, sf_dir)
    m = backtest.metrics(backtest.simulate(p, events, 0.001))
    return m.select("n_days", F.round("annual_return", 5).alias("annual_return"), F.round("max_drawdown", 6).alias("max_drawdown"), F.round("sharpe", 5).alias("sharpe"), F.round("calmar", 5).alias("calmar"), F.round("win_rate", 6).alias("win_rate"), F.round("turnover", 6).alias("turnover"))


@query()
def hidden_states(spark, sf_dir):
    f = _features(spark, sf_dir).select("entity", "trade_date", "ret_5d", "vol_20d")
    model, _ = models.fit_states(f, ["ret_5d", "vol_20d"], 3)
    return models.filtered_states(f, ["ret_5d", "vol_20d"], model).select("entity", "trade_date", "state")


@query()
def isotonic_calibration(spark, sf_dir):
    s = _signal(spark, sf_dir).where("fwd_5 is not null").withColumn("hit", c("fwd_5") > 0)
    return rounded(models.isotonic_by(s, "entity", "rs_20d", "hit"))


@query(q.base(upto="feats") + f""", m AS (SELECT quantile_cont(ret_5d, 0.01) AS lo, quantile_cont(ret_5d, 0.99) AS hi FROM feats), x AS (SELECT greatest(least(ret_5d, hi), lo) AS x, lo, hi FROM feats, m WHERE ret_5d IS NOT NULL)
SELECT 'ret_5d' AS "column", round(any_value(lo), 6) AS low, round(any_value(hi), 6) AS high, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x""")
def preprocessing_stats(spark, sf_dir):
    return rounded(models.preprocessing(_features(spark, sf_dir), ["ret_5d"]))


@query("""SELECT event_type AS entity, CAST(CAST(ts AS DATE) AS DATE) AS day, count(*) AS n, round(first(value ORDER BY ts, event_id), 6) AS open, round(last(value ORDER BY ts, event_id), 6) AS close, round(max(value), 6) AS high, round(min(value), 6) AS low FROM events GROUP BY 1, 2""")
def event_bars(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.struct("ts", "event_id")
    return rounded(e.groupBy(c("event_type").alias("entity"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min_by("value", key).alias("open"), F.max_by("value", key).alias("close"), F.max("value").alias("high"), F.min("value").alias("low")))


@query("""WITH x AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS s FROM events),
y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n_events, round(sum(value), 4) AS value FROM y GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy(F.session_window("ts", "2 hours").alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value"))
    return rounded(s.select("user_id", c("s.start").alias("start"), c("s.end").alias("end"), "n_events", "value"), 4)


@query(q.base(upto="feats") + """ SELECT entity, trade_date, concat_ws(',', CASE WHEN drawdown <= -0.3 THEN 'drawdown' END, CASE WHEN vol_20d >= 1.5 THEN 'volatile' END, CASE WHEN amount_z < -1 THEN 'thin' END) AS flags,
  CAST((CASE WHEN drawdown <= -0.3 THEN 1 ELSE 0 END) + (CASE WHEN vol_20d >= 1.5 THEN 1 ELSE 0 END) + (CASE WHEN amount_z < -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_flags FROM feats""")
def risk_flags(spark, sf_dir):
    rules = [("drawdown", c("drawdown") <= -0.3), ("volatile", c("vol_20d") >= 1.5), ("thin", c("amount_z") < -1)]
    return ranking.risk_flags(_features(spark, sf_dir), rules).select("entity", "trade_date", F.array_join("flags", ",").alias("flags"), "n_flags")


@query(q.base() + " SELECT entity, trade_date, round(100 * close / first_value(close) OVER (PARTITION BY entity ORDER BY trade_date), 6) AS level FROM bars WHERE trade_date >= DATE '2000-01-01'")
def overlay_normalised(spark, sf_dir):
    return rounded(ranking.overlay(panel(spark, sf_dir), F.lit("2000-01-01").cast("date")))


@query("""SELECT o_orderpriority AS source, sum(k)::BIGINT AS n_rows, count(*) AS n_keys, (sum(k) - count(*))::BIGINT AS n_repeats FROM (SELECT o_orderpriority, o_custkey, count(*) AS k FROM orders GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def source_summary(spark, sf_dir):
    return ranking.source_summary(table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("source"), "o_custkey"), "source", ["o_custkey"])


@query("""WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN DATE '1998-01-01' + CAST(c_custkey % 900 AS INTEGER) END AS a, CASE WHEN c_custkey % 3 > 0 THEN DATE '1999-01-01' + CAST(c_custkey % 700 AS INTEGER) END AS b FROM customer)
SELECT c_custkey FROM m WHERE (a IS NULL OR a <= DATE '1999-06-30') AND (b IS NULL OR b > DATE '1999-06-30')""")
def as_of_membership(spark, sf_dir):
    k = c("c_custkey")
    day = lambda d, n: F.date_add(F.lit(d).cast("date"), n.cast("int"))
    m = table(spark, sf_dir, "customer").select(k, F.when(k % 4 > 0, day("1998-01-01", k % 900)).alias("valid_from"), F.when(k % 3 > 0, day("1999-01-01", k % 700)).alias("valid_to"))
    return ranking.as_of_members(m, F.lit("1999-06-30").cast("date")).select("c_custkey")


@query(q.base(upto="segs") + """, n AS (SELECT label, next_label, count(*) AS n FROM segs WHERE next_label IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, next_label DESC) AS k, sum(n) OVER (PARTITION BY label) AS t FROM n)
SELECT label, CAST(t AS BIGINT) AS n, next_label AS top_label, round(n * 1.0 / t, 6) AS top_share, CASE WHEN t < 100 THEN 'insufficient' WHEN n * 1.0 / t >= 0.45 THEN 'strong' WHEN n * 1.0 / t >= 0.35 THEN 'weak' ELSE 'open' END AS tendency FROM r WHERE k = 1""")
def next_state_profile(spark, sf_dir):
    return rounded(segments.next_state_profile(_segments(spark, sf_dir), 100))


@query(q.base(upto="states") + """, x AS (SELECT *, lead(label) OVER (PARTITION BY entity ORDER BY trade_date) AS nx FROM states)
SELECT label, count(*) AS n, round(avg(CASE WHEN nx IS NOT NULL THEN CASE WHEN nx != label THEN 1.0 ELSE 0.0 END END), 6) AS exit_share, round(quantile_cont(ret_20d, 0.5), 6) + 0.0 AS median, round(avg(ret_20d), 6) + 0.0 AS mean, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS occupancy FROM x GROUP BY 1""")
def state_signatures(spark, sf_dir):
    return rounded(segments.state_signatures(_states(spark, sf_dir), "ret_20d"))


@query(q.base(upto="segs") + """, d AS (SELECT * FROM segs WHERE next_label IS NOT NULL), y AS (SELECT end_date, row_number() OVER (ORDER BY end_date) <= count(*) OVER () * 0.6 AS early FROM (SELECT DISTINCT end_date FROM d)),
r AS (SELECT d.*, early FROM d JOIN y ON d.end_date = y.end_date), m AS (SELECT label, next_label AS p, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, next_label DESC) AS k FROM r WHERE early GROUP BY 1, 2)
SELECT r.label, count(*) AS n, round(avg(CASE WHEN p = next_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON r.label = m.label WHERE NOT early GROUP BY 1""")
def transition_validation(spark, sf_dir):
    return rounded(segments.transition_validation(_segments(spark, sf_dir)))


@query(SIGNAL_SQL + " SELECT CAST(year(trade_date) AS BIGINT) AS year, count(*) AS n, round(avg(fwd_5), 6) + 0.0 AS mean, round(avg(CASE WHEN fwd_5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM sig WHERE fwd_5 IS NOT NULL GROUP BY 1")
def period_breakdown(spark, sf_dir):
    return rounded(evaluation.period_breakdown(_signal(spark, sf_dir), "fwd_5"))


@query(SIGNAL_SQL + """, k AS (SELECT quantile_cont(vol_20d, 0.75) AS a, quantile_cont(vol_20d, 0.9) AS b FROM sig), e AS (SELECT trade_date, fwd_5, CASE WHEN vol_20d >= b THEN 0.5 WHEN vol_20d >= a THEN 0.75 ELSE 1.0 END AS x FROM sig, k WHERE vol_20d IS NOT NULL AND fwd_5 IS NOT NULL)
SELECT trade_date, round(avg(fwd_5), 6) + 0.0 AS "full", round(avg(fwd_5 * x), 6) + 0.0 AS cut, round(avg(x), 6) AS exposure FROM e GROUP BY 1""")
def downshift_exposure(spark, sf_dir):
    return rounded(evaluation.downshift(_signal(spark, sf_dir), "vol_20d", "fwd_5"))


@query(f"""WITH lv AS ({ORACLE_SQL['break_warnings']}), x AS (SELECT *, level IN ('watch', 'elevated', 'high') AS warn, lag(trade_date) OVER (ORDER BY trade_date) AS before FROM lv),
y AS (SELECT *, sum(CASE WHEN NOT warn OR before IS NULL OR trade_date - before > 1 OR NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (ORDER BY trade_date) AS run FROM (SELECT *, lag(warn) OVER (ORDER BY trade_date) AS was FROM x)),
z AS (SELECT run, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS n_dates, count(CASE WHEN level = 'watch' THEN 1 END) AS n_watch, count(CASE WHEN level = 'elevated' THEN 1 END) AS n_elevated,
  count(CASE WHEN level = 'high' THEN 1 END) AS n_high, arg_min(drivers, trade_date) AS first_drivers FROM y WHERE warn GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY start_date) AS BIGINT) AS episode, start_date, end_date, n_dates, CAST(CASE WHEN n_high > 0 THEN 3 WHEN n_elevated > 0 THEN 2 ELSE 1 END AS BIGINT) AS severity, n_watch, n_elevated, n_high, first_drivers,
  end_date = (SELECT max(trade_date) FROM lv) AS active, CASE WHEN n_high > 0 THEN 'high' WHEN n_elevated > 0 THEN 'elevated' ELSE 'watch' END AS peak FROM z""")
def warning_episodes(spark, sf_dir):
    return evaluation.warning_episodes(break_warnings(spark, sf_dir), 1)


EPISODE_SQL = """, d AS (SELECT trade_date, avg(CASE WHEN event THEN 1.0 ELSE 0.0 END) AS share FROM ev GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS pos FROM d),
a AS (SELECT *, pos - lag(pos) OVER (ORDER BY trade_date) AS gap FROM p WHERE share >= 0.75), b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 5 THEN 1 ELSE 0 END) OVER (ORDER BY trade_date) AS block FROM a),
blocks AS (SELECT block, min(trade_date) AS a, max(trade_date) AS b FROM b GROUP BY 1), ep AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY trade_date) AS pos FROM ev WHERE event IS NOT NULL),
eg AS (SELECT *, pos - lag(pos) OVER (PARTITION BY entity ORDER BY trade_date) AS gap FROM ep WHERE event), es AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY trade_date) AS episode FROM eg),
episodes AS (SELECT entity, CAST(episode AS BIGINT) AS episode, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS n_dates FROM es GROUP BY 1, 2),
marked AS (SELECT *, EXISTS (SELECT 1 FROM blocks WHERE blocks.a <= episodes.end_date AND blocks.b >= episodes.start_date) AS in_market_block FROM episodes)"""


def _episodes(spark, sf_dir):
    e = _events(spark, sf_dir)
    blocks = evaluation.market_blocks(e, 0.75, 5)
    return e, blocks, evaluation.idiosyncratic_episodes(e, blocks, 5)


@query(EVENT_SQL + EPISODE_SQL + " SELECT * FROM marked")
def idiosyncratic_episodes(spark, sf_dir):
    return _episodes(spark, sf_dir)[2]


@query(EVENT_SQL + EPISODE_SQL + """, one AS (SELECT (SELECT count(event) FROM ev) AS n_labelled, (SELECT count(*) FROM ev WHERE event) AS n_events, (SELECT count(*) FROM blocks) AS n_blocks, (SELECT count(*) FROM marked WHERE NOT in_market_block) AS n_idiosyncratic)
SELECT *, CAST(n_blocks + 0.25 * n_idiosyncratic AS DOUBLE) AS evidence_25, CAST(n_blocks + 0.5 * n_idiosyncratic AS DOUBLE) AS evidence_50, CASE WHEN n_labelled = 0 THEN 'short_history' WHEN n_blocks + 0.25 * n_idiosyncratic < 5 THEN CASE WHEN n_events > 0 THEN 'drop' ELSE 'short_history' END
  WHEN n_blocks + 0.25 * n_idiosyncratic < 10 OR n_blocks < 2 THEN 'diagnostic' ELSE 'eligible' END AS verdict FROM one""")
def event_evidence(spark, sf_dir):
    return rounded(evaluation.event_evidence(*_episodes(spark, sf_dir), [0.25, 0.5]))


def _spread_sql() -> str:
    parts, out = [], []
    for i, (a, b) in enumerate(SPREADS):
        parts.append(f"""t{i} AS (SELECT trade_date, sum(CASE WHEN label = '{a}' THEN fwd_5 END) AS ls, count(CASE WHEN label = '{a}' THEN fwd_5 END) AS ln, sum(CASE WHEN label = '{b}' THEN fwd_5 END) AS rs, count(CASE WHEN label = '{b}' THEN fwd_5 END) AS rn FROM ss GROUP BY 1 HAVING ln > 0 AND rn > 0),
k{i} AS (SELECT *, row_number() OVER (ORDER BY trade_date) - 1 AS k, count(*) OVER () AS n FROM t{i}), w{i} AS (SELECT r, CAST('0x' || substr(md5('42:' || r || ':' || k), 1, 8) AS BIGINT) % n AS k FROM k{i}, range(1, 201) g(r)),
b{i} AS (SELECT r, sum(ls) / sum(ln) - sum(rs) / sum(rn) AS d FROM w{i} JOIN k{i} USING (k) GROUP BY 1)""")
        out.append(f"""SELECT '{a}-{b}' AS spread, count(CASE WHEN label = '{a}' THEN fwd_5 END) AS n_left, count(CASE WHEN label = '{b}' THEN fwd_5 END) AS n_right, round(avg(CASE WHEN label = '{a}' THEN fwd_5 END) - avg(CASE WHEN label = '{b}' THEN fwd_5 END), 6) + 0.0 AS mean,
  round(quantile_cont(CASE WHEN label = '{a}' THEN fwd_5 END, 0.5) - quantile_cont(CASE WHEN label = '{b}' THEN fwd_5 END, 0.5), 6) + 0.0 AS median, (SELECT round(quantile_cont(d, 0.025), 6) + 0.0 FROM b{i}) AS low, (SELECT round(quantile_cont(d, 0.975), 6) + 0.0 FROM b{i}) AS high,
  (SELECT round(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), 6) FROM b{i}) AS p_not_above FROM ss""")
    return SIGNAL_SQL + SIGNAL_STATES + ", " + ", ".join(parts) + " " + " UNION ALL ".join(out)


SPREADS = [("up", "down"), ("up", "flat"), ("flat", "down")]


@query(_spread_sql())
def state_spreads(spark, sf_dir):
    label = F.when(c("ret_20d") > 0.2, "up").when(c("ret_20d") < -0.2, "down").when(c("ret_20d").isNotNull(), "flat")
    return rounded(evaluation.state_spreads(_signal(spark, sf_dir).withColumn("label", label), "fwd_5", SPREADS))


@query(SIGNAL_SQL + """, x AS (SELECT entity, 1 / (1 + exp(-rs_20d)) AS p, CASE WHEN fwd_5 > 0 THEN 1 ELSE 0 END AS y FROM sig WHERE rs_20d IS NOT NULL AND fwd_5 IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY entity ORDER BY p) + (count(*) OVER (PARTITION BY entity, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY entity ORDER BY y) + (count(*) OVER (PARTITION BY entity, y) - 1) / 2.0 AS b FROM x),
st AS (SELECT entity, p, sum(y) AS pos, count(*) AS n FROM x GROUP BY 1, 2), cu AS (SELECT *, sum(pos) OVER (PARTITION BY entity ORDER BY p DESC) * 1.0 / sum(n) OVER (PARTITION BY entity ORDER BY p DESC) AS prec FROM st), ap AS (SELECT entity, sum(pos * prec) / nullif(sum(pos), 0) AS ap FROM cu GROUP BY 1)
SELECT rk.entity, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(any_value(ap), 6) AS average_precision, round(corr(a, b), 6) + 0.0 AS spearman FROM rk JOIN ap ON rk.entity = ap.entity GROUP BY 1""")
def score_metrics(spark, sf_dir):
    s = _signal(spark, sf_dir).where("rs_20d is not null and fwd_5 is not null")
    s = s.select("entity", scalars.sigmoid(c("rs_20d")).alias("p"), (c("fwd_5") > 0).alias("hit"))
    return rounded(evaluation.score_metrics(s, "p", "hit", "entity"))


OPEN_SQL = BACKTEST_SQL + """, pr AS (SELECT entity, trade_date, coalesce(open / nullif(lag(close) OVER (PARTITION BY entity ORDER BY trade_date), 0) - 1, 0) AS gap, coalesce(close / nullif(open, 0) - 1, 0) AS day FROM bars),
nd AS (SELECT d.trade_date, max(od.exec_date) OVER (ORDER BY d.trade_date) AS exec_date FROM (SELECT DISTINCT trade_date FROM feats) d LEFT JOIN od ON od.exec_date = d.trade_date),
ov AS (SELECT dy.trade_date, sum(weight * gap) AS o, sum(weight * day) AS i FROM dy JOIN ev ON ev.exec_date = dy.exec_date JOIN pr ON pr.entity = ev.entity AND pr.trade_date = dy.trade_date GROUP BY 1),
nw AS (SELECT nd.trade_date, sum(weight * day) AS i FROM nd JOIN ev ON ev.exec_date = nd.exec_date JOIN pr ON pr.entity = ev.entity AND pr.trade_date = nd.trade_date GROUP BY 1),
oc AS (SELECT cu.trade_date, coalesce(ov.o, 0) AS o, coalesce({i}, 0) AS i, turnover FROM cu LEFT JOIN ov ON cu.trade_date = ov.trade_date LEFT JOIN nw ON cu.trade_date = nw.trade_date)
SELECT trade_date, round(o, 6) + 0.0 AS overnight, round(i, 6) + 0.0 AS intraday, round((1 + o) * (1 + i) - 1, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round((1 + o) * (1 + i) * (1 - turnover * 0.001) - 1, 6) + 0.0 AS net FROM oc"""


@query(OPEN_SQL.replace("{i}", "ov.i"))
def portfolio_curve_open(spark, sf_dir):
    p, events = _rebalanced(spark, sf_dir)
    return rounded(backtest.simulate_open(p, events, 0.001))


@query(OPEN_SQL.replace("{i}", "nw.i"))
def portfolio_curve_open_entry_day(spark, sf_dir):
    p, events = _rebalanced(spark, sf_dir)
    return rounded(backtest.simulate_open(p, events, 0.001, entry_day=True))


@query(q.base(upto="states") + """, x AS (SELECT entity, trade_date, CASE WHEN day(trade_date) != 13 THEN label END AS label, row_number() OVER (PARTITION BY entity ORDER BY trade_date) AS pos, count(*) OVER (PARTITION BY entity) AS n, max(trade_date) OVER (PARTITION BY entity) AS run_end FROM states),
y AS (SELECT *, CASE WHEN label != lag(label) OVER (PARTITION BY entity ORDER BY pos) THEN pos END AS hit FROM x WHERE label IS NOT NULL), z AS (SELECT entity, pos, min(hit) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hit FROM y),
e AS (SELECT x.*, z.hit, t.trade_date AS exit_date, t.label AS next_label FROM x LEFT JOIN z ON x.entity = z.entity AND x.pos = z.pos LEFT JOIN x t ON z.entity = t.entity AND z.hit = t.pos),
h AS (SELECT e.*, g.h, f.trade_date AS hor FROM e CROSS JOIN (SELECT unnest([5, 20]) AS h) g LEFT JOIN x f ON f.entity = e.entity AND f.pos = e.pos + g.h),
o AS (SELECT *, least(coalesce(hor, run_end), DATE '1998-06-30') AS seen, DATE '1998-06-30' < coalesce(hor, run_end) AS cut FROM h),
s AS (SELECT *, CASE WHEN label IS NULL THEN 'missing_state' WHEN hit - pos <= h AND exit_date <= seen THEN 'positive' WHEN hor IS NOT NULL AND NOT cut THEN 'negative' WHEN cut THEN 'censored_by_cutoff' ELSE 'censored_by_run_end' END AS status FROM o)
SELECT entity, trade_date, label, next_label, exit_date, CAST(h AS BIGINT) AS horizon, status, CASE WHEN label IS NULL THEN trade_date ELSE seen END AS observed_until, CAST(CASE status WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS BIGINT) AS exit_within, CAST(CASE WHEN status IN ('positive', 'negative') THEN 1 ELSE 0 END AS DOUBLE) AS weight FROM s""")
def exit_dataset(spark, sf_dir):
    s = _states(spark, sf_dir).withColumn("label", F.when(F.dayofmonth("trade_date") != 13, c("label")))
    return segments.exit_dataset(s, [5, 20], "1998-06-30")


@query(q.base(upto="segs") + """, x AS (SELECT entity, trade_date, label, strftime(trade_date, '%Y-%m') AS cp, (row_number() OVER (PARTITION BY entity, segment ORDER BY trade_date) - 1) % 40 + 1 AS age FROM runs),
y AS (SELECT *, lag(label) OVER w = label AS same, coalesce(lag(cp) OVER w != cp, false) AS moved, lag(age) OVER w > age AS fell FROM x WINDOW w AS (PARTITION BY entity ORDER BY trade_date)),
z AS (SELECT coalesce(entity, '__ALL__') AS entity, count(CASE WHEN same THEN 1 END) AS n_pairs, count(CASE WHEN same AND fell THEN 1 END) AS n_resets, count(CASE WHEN same AND moved THEN 1 END) AS n_boundary_pairs, count(CASE WHEN same AND fell AND moved THEN 1 END) AS n_boundary_resets, max(age) AS max_age FROM y GROUP BY ROLLUP (entity)),
r AS (SELECT *, coalesce(n_resets * 1.0 / nullif(n_pairs, 0), 0) AS a, coalesce(n_boundary_resets * 1.0 / nullif(n_boundary_pairs, 0), 0) AS b FROM z)
SELECT entity, n_pairs, n_resets, n_boundary_pairs, n_boundary_resets, CAST(max_age AS BIGINT) AS max_age, round(a, 6) AS reset_rate, round(b, 6) AS boundary_reset_rate, a <= 0.05 AND b <= 0.05 AS passed FROM r""")
def state_age_stability(spark, sf_dir):
    from panelforge.panel import in_time, islands

    aged = islands(_states(spark, sf_dir), "label").withColumn("age", ((F.row_number().over(in_time("entity", "segment")) - 1) % 40 + 1).cast("bigint"))
    return rounded(segments.age_stability(aged.withColumn("checkpoint", scalars.period_key(c("trade_date"), "month"))))


PHASE_SQL = """, ph0 AS (SELECT *, row_number() OVER (PARTITION BY entity, segment ORDER BY trade_date) AS age FROM runs), pc AS (SELECT label, count(*) AS n, quantile_cont(n_days, 0.33) AS a, quantile_cont(n_days, 0.66) AS b FROM segs WHERE prev_label IS NOT NULL AND next_label IS NOT NULL GROUP BY 1),
ph AS (SELECT entity, trade_date, ph0.label, age, CASE WHEN n IS NULL OR n < 3 THEN 'unknown' WHEN age <= a THEN 'early' WHEN age <= b THEN 'mature' ELSE 'late' END AS phase FROM ph0 LEFT JOIN pc ON ph0.label = pc.label)"""
FORWARD_SQL = f""", dm AS (SELECT trade_date, avg(r) AS m FROM rets GROUP BY 1), bm AS (SELECT trade_date, {', '.join(f"CASE WHEN count(m) OVER (ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN product(1 + m) OVER (ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) - 1 END AS b{h}" for h in (5, 20))} FROM dm),
fw AS (SELECT bars.entity, bars.trade_date, {', '.join(f"lead(close, {h}) OVER w / close - 1 AS fwd_ret_{h}, lead(close, {h}) OVER w / close - 1 - b{h} AS fwd_excess_{h}, min(close) OVER (PARTITION BY entity ORDER BY bars.trade_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1 AS fwd_mae_{h}" for h in (5, 20))}
  FROM bars JOIN bm ON bars.trade_date = bm.trade_date WINDOW w AS (PARTITION BY entity ORDER BY bars.trade_date))"""
FORWARD = [f"fwd_{k}_{h}" for h in (5, 20) for k in ("ret", "excess", "mae")]


@query(q.base(upto="segs") + PHASE_SQL + " SELECT entity, trade_date, label, age, phase FROM ph")
def state_phases(spark, sf_dir):
    return segments.state_phases(_states(spark, sf_dir).select("entity", "trade_date", "label"))


@query(q.base() + ", " + q.RETURNS + FORWARD_SQL + " SELECT entity, trade_date, " + ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in FORWARD) + " FROM fw")
def forward_frame(spark, sf_dir):
    return rounded(targets.forward_frame(panel(spark, sf_dir), [5, 20]))


@query(q.base(upto="segs") + PHASE_SQL + FORWARD_SQL + " SELECT label, phase, count(*) AS n, round(avg(age), 6) AS mean_age, " + ", ".join(f"round(avg({x}), 6) + 0.0 AS {x}" for x in FORWARD) + " FROM ph LEFT JOIN fw ON ph.entity = fw.entity AND ph.trade_date = fw.trade_date GROUP BY 1, 2")
def state_phase_profile(spark, sf_dir):
    return rounded(segments.phase_profile(state_phases(spark, sf_dir), targets.forward_frame(panel(spark, sf_dir), [5, 20]), FORWARD))


@query(q.base(upto="feats") + """, per AS (SELECT entity, count(*) AS d FROM bars GROUP BY 1), b AS (SELECT bars.*, ret_20d, amount_z FROM bars JOIN feats ON bars.entity = feats.entity AND bars.trade_date = feats.trade_date)
SELECT min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS n_rows, count(CASE WHEN open <= 0 THEN 1 END) AS non_positive_open, count(CASE WHEN close <= 0 THEN 1 END) AS non_positive_close, count(CASE WHEN open IS NULL THEN 1 END) AS missing_open, count(CASE WHEN close IS NULL THEN 1 END) AS missing_close,
  count(CASE WHEN amount IS NULL THEN 1 END) AS missing_amount, count(CASE WHEN ret_20d IS NOT NULL AND amount_z IS NOT NULL THEN 1 END) AS n_complete, round(avg(CASE WHEN ret_20d IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share_ret_20d, round(avg(CASE WHEN amount_z IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share_amount_z,
  (SELECT count(*) FROM per) AS n_entities, CAST(0 AS BIGINT) AS n_repeats, (SELECT round(quantile_cont(d, 0.1), 6) FROM per) AS days_p10, (SELECT round(quantile_cont(d, 0.5), 6) FROM per) AS days_median, (SELECT round(quantile_cont(d, 0.9), 6) FROM per) AS days_p90, count(DISTINCT trade_date) AS n_dates FROM b""")
def data_audit(spark, sf_dir):
    both = panel(spark, sf_dir).join(_features(spark, sf_dir).select("entity", "trade_date", "ret_20d", "amount_z"), ["entity", "trade_date"])
    return rounded(quality.data_audit(both, ["ret_20d", "amount_z"]))


@query("""WITH x AS (SELECT o_orderkey AS day, CASE o_orderpriority WHEN '1-URGENT' THEN 'full_market' WHEN '2-HIGH' THEN 'local_sample' WHEN '3-MEDIUM' THEN 'other' END AS m, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 10) / 10.0 END AS cr, CASE WHEN o_orderkey % 5 = 0 THEN 0.9 END AS fr, CASE WHEN o_orderkey % 7 = 0 THEN 0.5 END AS lr, o_orderkey % 11 AS e, o_orderkey % 13 AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'full_market' END AS level FROM orders),
y AS (SELECT day, coalesce(CASE WHEN m IN ('full_market', 'local_sample') THEN m END, 'unknown') AS mode, cr, fr, lr, e, t, level FROM x), z AS (SELECT *, CASE WHEN mode = 'full_market' THEN coalesce(fr, cr) ELSE fr END AS f, CASE WHEN mode = 'local_sample' THEN coalesce(lr, cr, e * 1.0 / nullif(t, 0)) ELSE lr END AS l FROM y)
SELECT day, mode, round(f, 6) AS full_ratio, round(l, 6) AS local_ratio, coalesce(mode = 'full_market' AND level = 'full_market' AND f >= 0.8, false) AS usable FROM z""")
def breadth_coverage(spark, sf_dir):
    k, mode = c("o_orderkey"), F.when(c("o_orderpriority") == "1-URGENT", " full_market").when(c("o_orderpriority") == "2-HIGH", "local_sample").when(c("o_orderpriority") == "3-MEDIUM", "other")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("day"), mode.alias("mode"), F.when(k % 3 > 0, k % 10 / 10.0).alias("coverage_ratio"), F.when(k % 5 == 0, 0.9).alias("full_ratio"), F.when(k % 7 == 0, 0.5).alias("local_ratio"),
        (k % 11).alias("effective"), (k % 13).alias("total"), F.when(k % 2 == 0, "full_market").alias("level"),
    )
    return rounded(quality.breadth_coverage(rows).select("day", "mode", "full_ratio", "local_ratio", "usable"))


@query("""WITH x AS (SELECT o_custkey AS a, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 3 AS INTEGER) AS u, CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END AS m FROM orders)
SELECT count(*) AS n_rows, count(DISTINCT (a, d)) AS n_keys, count(*) - count(DISTINCT (a, d)) AS n_repeats, count(CASE WHEN u > d THEN 1 END) AS late_train_end, count(CASE WHEN m IS NULL THEN 1 END) AS missing_source FROM x""")
def cache_audit(spark, sf_dir):
    k = c("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("trade_date"), F.date_add(F.to_date("o_orderdate"), (k % 5 - 3).cast("int")).alias("train_end"), F.when(k % 9 > 0, c("o_orderstatus")).alias("source"))
    return quality.cache_audit(rows, ["o_custkey", "trade_date"], ["train_end"], ["source"])


@query(q.base() + f""", x AS (SELECT *, {q.pct('close', 1)} AS r, row_number() OVER (PARTITION BY entity ORDER BY trade_date DESC) AS k FROM bars),
y AS (SELECT entity, max(trade_date) AS trade_date, {', '.join(f"CASE WHEN count(CASE WHEN k <= {n} THEN r END) >= 10 THEN stddev_pop(CASE WHEN k <= {n} THEN r END) * sqrt({n}) END AS vol_{n}, sqrt(avg(CASE WHEN k <= {n} AND r IS NOT NULL THEN least(r, 0) * least(r, 0) END)) AS downside_{n}, sqrt(avg(CASE WHEN k <= {n} AND r IS NOT NULL THEN least(r, 0) * least(r, 0) END)) / nullif(stddev_pop(CASE WHEN k <= {n} THEN r END), 0) AS downside_share_{n}, avg(CASE WHEN k <= {n} AND r IS NOT NULL THEN CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END END) AS falling_share_{n}" for n in (20, 60))} FROM x GROUP BY 1)
SELECT entity, trade_date, {', '.join(f"round({m}_{n}, 6) + 0.0 AS {m}_{n}" for n in (20, 60) for m in ('vol', 'downside', 'downside_share', 'falling_share'))}, round(CASE WHEN vol_20 IS NOT NULL THEN rank() OVER (ORDER BY vol_20) * 1.0 / count(vol_20) OVER () END, 6) AS volatility_rank FROM y""")
def signal_baseline(spark, sf_dir):
    return rounded(features.signal_baseline(panel(spark, sf_dir)))


@query(q.base(upto="feats") + " SELECT * FROM (SELECT 'ret_20d' AS \"column\", count(ret_20d) AS n FROM feats UNION ALL SELECT 'vol_20d', count(vol_20d) FROM feats UNION ALL SELECT 'rs_20d', count(rs_20d) FROM feats) WHERE n >= 20")
def usable_columns(spark, sf_dir):
    return features.usable_columns(_features(spark, sf_dir), ("_20d",))


@query("""WITH e AS (SELECT event_type, ts, value, event_id FROM events) SELECT event_type, max(ts) AS seen_at, count(*) AS hits, count(CASE WHEN value > 10 THEN 1 END) AS big, arg_max(value, (ts, value)) AS last_value FROM e GROUP BY 1""")
def counter_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", c("ts").alias("seen_at"), F.lit(1).cast("bigint").alias("hits"), (c("value") > 10).cast("bigint").alias("big"), c("value").alias("last_value"), "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    none = old.limit(0)
    stored = store.merge_counters(none, old, ["event_type"], ["hits", "big"], ["last_value"], "seen_at")
    return store.merge_counters(stored, new, ["event_type"], ["hits", "big"], ["last_value"], "seen_at")


@query("WITH " + q.bars("n_name") + """, a AS (SELECT trade_date, count(*) AS n_rows FROM bars WHERE volume > 30 GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS trade_date, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT coalesce(a.trade_date, b.trade_date) AS trade_date, n_rows, n_orders FROM a FULL OUTER JOIN b ON a.trade_date = b.trade_date""")
def outer_by_date(spark, sf_dir):
    a = panel(spark, sf_dir, "n_name").where("volume > 30").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_rows"))
    b = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("trade_date")).agg(F.count(F.lit(1)).alias("n_orders"))
    return features.outer_by_date(a, b)


@query("""SELECT n_nationkey, substr(sha256('{"n_name":' || CASE WHEN n_nationkey % 4 = 0 THEN 'null' ELSE '"' || n_name || '"' END || ',"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'), 1, 32) AS lineage FROM nation""")
def lineage_keys(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("n_name", F.when(c("n_nationkey") % 4 != 0, c("n_name")))
    return n.select("n_nationkey", scalars.lineage_key(["n_regionkey", "n_name", "n_nationkey"]).alias("lineage"))


@query(f"""WITH t AS ({ORACLE_SQL['exit_dataset']}), x AS (SELECT trade_date, status, exit_date, CASE WHEN day(trade_date) = 11 THEN 1 ELSE exit_within END AS v, CASE WHEN day(trade_date) = 12 THEN 1.0 ELSE weight END AS w, CASE WHEN day(trade_date) = 14 THEN trade_date - 1 ELSE observed_until END AS o FROM t),
y AS (SELECT unnest([CASE WHEN status = 'positive' AND v IS DISTINCT FROM 1 THEN 'positive_label' END, CASE WHEN status = 'negative' AND v IS DISTINCT FROM 0 THEN 'negative_label' END, CASE WHEN status LIKE 'censored%' AND v IS NOT NULL THEN 'censored_label' END,
  CASE WHEN status = 'missing_state' AND v IS NOT NULL THEN 'missing_label' END, CASE WHEN status LIKE 'censored%' AND w > 0 THEN 'censored_weight' END, CASE WHEN status = 'positive' AND exit_date > o THEN 'positive_exit_date' END, CASE WHEN status = 'negative' AND o < trade_date THEN 'negative_end' END]) AS "check" FROM x)
SELECT "check", count(*) AS n FROM y WHERE "check" IS NOT NULL GROUP BY 1""")
def target_violations(spark, sf_dir):
    on = lambda d: F.dayofmonth("trade_date") == d
    t = exit_dataset(spark, sf_dir).withColumn("exit_within", F.when(on(11), 1).otherwise(c("exit_within"))).withColumn("weight", F.when(on(12), 1.0).otherwise(c("weight")))
    return quality.target_violations(t.withColumn("observed_until", F.when(on(14), F.date_sub("trade_date", 1)).otherwise(c("observed_until"))))


@query(q.base("n_name") + ", g AS (SELECT entity, trade_date - lag(trade_date) OVER (PARTITION BY entity ORDER BY trade_date) AS g FROM bars) SELECT entity, count(*) AS n_gaps, CAST(max(g) AS BIGINT) AS longest FROM g WHERE g > 3 GROUP BY 1")
def silent_breaks(spark, sf_dir):
    return quality.silent_breaks(panel(spark, sf_dir, "n_name"), 3)


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey + 50 AS k FROM orders), j AS (SELECT a.k AS x, b.k AS y FROM a FULL OUTER JOIN b ON a.k = b.k)
SELECT count(CASE WHEN x = y THEN 1 END) AS n_both, count(CASE WHEN y IS NULL THEN 1 END) AS n_missing, count(CASE WHEN x IS NULL THEN 1 END) AS n_extra, round(count(CASE WHEN x = y THEN 1 END) * 1.0 / count(x), 6) AS share FROM j""")
def key_coverage(spark, sf_dir):
    return rounded(quality.key_coverage(table(spark, sf_dir, "customer").select(c("c_custkey").alias("k")), table(spark, sf_dir, "orders").select((c("o_custkey") + 50).alias("k")), ["k"]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, benchmark, features, latest rows, score and tag: the dashboard of the panel."""
    last = ranking.latest(_features(spark, sf_dir).where("ret_20d is not null"))
    scored = ranking.sector_scores(_probabilities(last))
    return scored.select("entity", "trade_date", "close", "ret_20d", "rs_20d", "score", "tag").orderBy(F.desc("score"), "entity")
