"""Pieces of DuckDB SQL shared by the registered queries' oracles."""

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def bars(level: str = "r_name", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT {level} AS entity, any_value(r_name) AS sector, CAST(l_shipdate AS DATE) AS trade_date,
    first(price ORDER BY {ORDER}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {ORDER}) AS close, sum(l_quantity) AS volume, sum(price) AS amount
  FROM (SELECT *, 50 + l_extendedprice / 1000 AS price FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY 1, 3)"""


def over(rows: str = "", by: str = "entity") -> str:
    return f"OVER ({'PARTITION BY ' + by if by else ''} ORDER BY trade_date {rows})"


def roll(fn: str, x: str, n: int, least: int, by: str = "entity", skip: int = 0) -> str:
    w = over(f"ROWS BETWEEN {n - 1 + skip} PRECEDING AND {str(skip) + ' PRECEDING' if skip else 'CURRENT ROW'}", by)
    return f"CASE WHEN count({x}) {w} >= {least} THEN {fn}({x}) {w} END"


def lag(x: str, k: int = 1, by: str = "entity") -> str:
    return f"lag({x}, {k}) {over(by=by)}"


def lead(x: str, k: int = 1, by: str = "entity") -> str:
    return f"lead({x}, {k}) {over(by=by)}"


def pct(x: str, k: int, by: str = "entity") -> str:
    return f"({x} / nullif({lag(x, k, by)}, 0) - 1)"


def z(x: str, n: int, least: int, by: str = "entity") -> str:
    return f"(({x}) - {roll('avg', x, n, least, by)}) / nullif({roll('stddev_pop', x, n, least, by)}, 0)"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


RETURNS = f"rets AS (SELECT *, {pct('close', 1)} AS r FROM bars)"
BENCH = f"""daily AS (SELECT trade_date, avg(r) AS m FROM rets GROUP BY 1),
bench AS (SELECT trade_date, {roll('product', '1 + m', 20, 20, by='')} - 1 AS b FROM daily)"""
FEATS = f"""feats0 AS (SELECT rets.*, b, {roll('avg', 'close', 20, 10)} AS ma20 FROM rets LEFT JOIN bench USING (trade_date)),
feats AS (
  SELECT entity, trade_date, close, r AS ret_1d, {pct('close', 5)} AS ret_5d, {pct('close', 20)} AS ret_20d, {roll('stddev_pop', 'r', 20, 10)} * sqrt(20) AS vol_20d,
    {z('amount', 20, 10)} AS amount_z, {pct('close', 20)} - b AS rs_20d, close / nullif({roll('max', 'close', 20, 10)}, 0) - 1 AS drawdown,
    ma20 / nullif({lag('ma20', 5)}, 0) - 1 AS ma20_slope, open / nullif({lag('close')}, 0) - 1 AS gap_1d, close / nullif(open, 0) - 1 AS intraday
  FROM feats0)"""
STATES = """states AS (
  SELECT * FROM (SELECT entity, trade_date, close, ret_20d, CASE WHEN ret_20d > 0.2 THEN 'up' WHEN ret_20d < -0.2 THEN 'down' WHEN ret_20d IS NOT NULL THEN 'flat' END AS label FROM feats)
  WHERE label IS NOT NULL)"""
SEGMENTS = """runs AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev != label THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY trade_date) AS segment
  FROM (SELECT *, lag(label) OVER (PARTITION BY entity ORDER BY trade_date) AS prev FROM states)),
dd AS (SELECT *, close / nullif(max(close) OVER (PARTITION BY entity, segment ORDER BY trade_date), 0) - 1 AS dd FROM runs),
segs0 AS (
  SELECT entity, segment, any_value(label) AS label, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS n_days,
    first(close ORDER BY trade_date) AS a, last(close ORDER BY trade_date) AS b, min(dd) AS max_drawdown FROM dd GROUP BY 1, 2),
segs AS (
  SELECT entity, CAST(segment AS BIGINT) AS segment, label, start_date, end_date, n_days, CAST(end_date - start_date + 1 AS BIGINT) AS calendar_days, b / nullif(a, 0) - 1 AS segment_return, max_drawdown,
    lag(label) OVER (PARTITION BY entity ORDER BY segment) AS prev_label, lead(label) OVER (PARTITION BY entity ORDER BY segment) AS next_label, lag(n_days) OVER (PARTITION BY entity ORDER BY segment) AS prev_days
  FROM segs0)"""


def base(level: str = "r_name", upto: str = "bars") -> str:
    """WITH clause up to a step: bars, feats, states or segs."""
    steps = [bars(level)]
    if upto != "bars":
        steps += [RETURNS, BENCH, FEATS]
    if upto in ("states", "segs"):
        steps.append(STATES)
    if upto == "segs":
        steps.append(SEGMENTS)
    return "WITH " + ",\n".join(steps)
