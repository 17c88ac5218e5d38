"""The pipeline's stages on their own inputs, and the registered queries against their SQL."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from panelforge.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, DATA, "documents")
    columns = docs.columns
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
        n = after.count()
        assert 0 < n <= before, name
        assert name not in ("line_dedup", "byte_bpe") or n == before
        assert name != "toxicity" or n < before
        docs, before = after, n
    assert docs.where("n_tokens is null or decoded_sha256 is null").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).fetchdf()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    text = lambda v: "" if pd.isna(v) else str(v)[:10] if hasattr(v, "isoformat") else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)  # noqa: E731  a null makes integers floats
    plain = lambda df: sorted(tuple(map(text, r)) for r in df[cols].itertuples(index=False))
    assert plain(got) == plain(want)
