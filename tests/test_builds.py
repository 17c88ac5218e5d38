"""Builds that are published in one step, and rebuilds of what changed factors move."""

import os

import pytest
from pyspark.sql import functions as F

from panelforge.operators import rebuild
from panelforge.plans.catalog import _factors
from panelforge.plans.tables import members, panel
from panelforge.sources.builds import Builds, part_of


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(sorted(df.columns)).collect())


def test_only_touched_partitions_are_written(spark, sf_dir, tmp_path):
    daily, old = panel(spark, sf_dir, "n_name").cache(), _factors(spark, sf_dir).cache()
    one = daily.agg(F.min("entity")).first()[0]
    new = old.withColumn("adj_factor", F.when((F.col("entity") == one) & (F.col("trade_date") >= "1997-01-01"), F.col("adj_factor") * 2).otherwise(F.col("adj_factor")))
    who = members(spark, sf_dir).select("entity", "sector").distinct().cache()
    part, whole = Builds(spark, f"{tmp_path}/part"), Builds(spark, f"{tmp_path}/whole")
    assert rebuild.build_all(part, daily, old, who, 8) == 1
    before, was = files(f"{tmp_path}/part"), part.manifest()
    done = rebuild.rebuild_changed(part, daily, old, new, who, 8)
    assert done["version"] == 2 and done["entities"] == 1 and done["sectors"] == 1
    assert {t: len(p) for t, p in done["parts"].items() if p} == {"prices": 1, "index": 1, "features": 1}
    after, now = files(f"{tmp_path}/part"), part.manifest()
    assert {f: after[f] for f in before} == before  # no file that was there is touched
    for table in ("prices", "index", "features"):
        moved = set(done["parts"][table])
        assert {p: f for p, f in now[table].items() if p not in moved} == {p: f for p, f in was[table].items() if p not in moved}
        assert all(now[table][p] != was[table][p] for p in moved)
    rebuild.build_all(whole, daily, new, who, 8)
    for table in ("prices", "index", "features", "breadth"):
        assert rows(part.read(table)) == rows(whole.read(table)), table
    # nothing changed: nothing is written
    assert rebuild.rebuild_changed(part, daily, new, new, who, 8)["parts"] == {} and part.version() == 2
    assert part.read("prices", part.manifest(1)).count() == daily.count()  # the version before is whole


def test_moved_entities(spark, day):
    schema = "entity string, trade_date date, adj_factor double"
    old = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 1.0), ("b", day(0), 1.0), ("c", day(0), 1.0), ("d", day(0), None)], schema)
    new = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 1.1), ("b", day(0), 1.0 + 1e-13), ("e", day(3), 2.0), ("d", day(0), None)], schema)
    assert sorted((r.entity, r.first_changed, r.n_changed) for r in rebuild.moved_entities(old, new).collect()) == [("a", day(1), 1), ("c", day(0), 1), ("e", day(3), 1)]


def test_publishing_is_one_step(spark, tmp_path):
    b = Builds(spark, f"{tmp_path}/t")
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    part = F.col("id").cast("int") % 4
    assert b.version() == 0 and b.read("x") is None and b.manifest() == {}
    first = b.start()
    b.stage(first, "x", df, part)
    assert b.read("x") is None  # staged rows aren't seen
    b.publish(first, {"x": None})
    one, two = b.start(), b.start()
    b.stage(one, "x", df.where("id % 4 = 1").withColumn("v", F.lit(0).cast("bigint")), part)
    b.stage(two, "x", df.where("id % 4 = 2").limit(0), part)
    assert b.publish(one, {"x": [1]}) == 2
    with pytest.raises(RuntimeError):
        b.publish(two, {"x": [2]})
    assert b.read("x").agg(F.sum("v")).first()[0] == sum(2 * i for i in range(20) if i % 4 != 1) and b.read("x").count() == 20
    three = b.start()
    b.stage(three, "x", df.limit(0), part)
    b.publish(three, {"x": [3]})  # a rewritten partition without rows is empty
    assert b.read("x").count() == 15 and b.read("x", b.manifest(2)).count() == 20
    four = b.start()
    b.stage(four, "x", df, part)
    with pytest.raises(ValueError):
        b.publish(four, {"x": [0]})
    assert set(b.vacuum()) == {two, three, four} and b.read("x").count() == 15


def test_parts_are_stable(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    a, b = ([r[0] for r in d.select(part_of(F.col("k"), 7)).collect()] for d in (df, df.repartition(3)))
    assert sorted(a) == sorted(b) and all(0 <= x < 7 for x in a)
