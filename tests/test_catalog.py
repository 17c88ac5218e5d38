"""Every registered panel query against its DuckDB SQL, row for row."""

import duckdb
import pandas as pd
import pytest

from panelforge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(df: pd.DataFrame) -> list:
    return sorted([plain(v) for v in r] for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0 or name in {"transition_screen", "interval_overlap", "market_event_blocks"}
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    got = catalog.flagship(spark, sf_dir).toPandas()
    assert len(got) and got["score"].is_monotonic_decreasing
