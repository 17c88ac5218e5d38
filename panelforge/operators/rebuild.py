"""Re-based prices and all that is derived from them, built whole or only where adjustment factors changed.

prices (by entity) feed the index of each sector, that feeds the sector's features; market breadth has a row a date. When
factors change, the entities that they move, the sectors that have such a member, and those sectors' features are made
anew; only the partitions that hold them are rewritten. All tables are published together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import etl, features
from panelforge.sources.builds import Builds, part_of

c = F.col
PARTS = 16


def moved_entities(old: DataFrame, new: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(entity, first_changed, n_changed): entities with a factor that was added, removed or changed beyond the tolerance.

    A removed date counts as changed there. The latest factor re-bases all earlier prices, so such an entity is rebuilt from
    its first row on.
    """
    o, n = old.select("entity", "trade_date", c("adj_factor").alias("o")), new.select("entity", "trade_date", c("adj_factor").alias("n"))
    both = o.join(n, ["entity", "trade_date"], "full")
    differs = c("o").isNull() != c("n").isNull()
    differs = differs | F.coalesce(F.abs(c("n") - c("o")) > tolerance, F.lit(False))
    return both.where(differs).groupBy("entity").agg(F.min("trade_date").alias("first_changed"), F.count(F.lit(1)).alias("n_changed"))


def prices_of(daily: DataFrame, factors: DataFrame) -> DataFrame:
    return etl.adjust_prices(daily, factors, etl.reference_factors(factors)).select("entity", "trade_date", "open", "high", "low", "close", "volume", "amount")


def index_of(prices: DataFrame, members: DataFrame) -> DataFrame:
    index = etl.index_from_members(prices.join(members.select("entity", "sector"), "entity"))
    return index.withColumnRenamed("sector", "entity")


def features_of(index: DataFrame) -> DataFrame:
    return features.sector_features(index)


def build_all(builds: Builds, daily: DataFrame, factors: DataFrame, members: DataFrame, n_parts: int = PARTS) -> int:
    """Every table from scratch, published together."""
    b, every = builds.start(), {"prices": None, "index": None, "features": None, "breadth": None}
    part = part_of(c("entity"), n_parts)
    builds.stage(b, "prices", prices_of(daily, factors), part)
    staged = builds.overlay(b, {"prices": None})
    builds.stage(b, "index", index_of(builds.read("prices", staged), members), part)
    staged = builds.overlay(b, {"prices": None, "index": None})
    builds.stage(b, "features", features_of(builds.read("index", staged)), part)
    builds.stage(b, "breadth", etl.market_breadth(builds.read("prices", staged)), F.lit(0))
    return builds.publish(b, every, {"kind": "full"})


def rebuild_changed(builds: Builds, daily: DataFrame, old: DataFrame, new: DataFrame, members: DataFrame, n_parts: int = PARTS) -> dict:
    """What changed factors move, rebuilt and published; returns what was rewritten.

    Without a change nothing is written or published. Affected entities and sectors stay tables: joins leave out the rows
    of other keys; the driver only gets the numbers of the partitions that hold affected keys.
    """
    moved = moved_entities(old, new).select("entity")
    sectors = members.join(moved, "entity", "left_semi").select(c("sector").alias("entity")).distinct()
    part = part_of(c("entity"), n_parts)
    touched = lambda keys: sorted(r[0] for r in keys.select(part.alias("p")).distinct().collect())  # noqa: E731  n_parts numbers at most
    parts = {"prices": touched(moved), "index": touched(sectors), "features": touched(sectors)}
    if not parts["prices"]:
        return {"version": builds.version(), "entities": 0, "sectors": 0, "parts": {}}
    b = builds.start()

    def stage(table: str, fresh: DataFrame, keys: DataFrame) -> None:
        """A table's touched partitions: fresh rows, and the rows there of keys that aren't affected."""
        have = builds.read(table, parts=parts[table])
        rows = fresh if have is None else have.join(keys, "entity", "left_anti").unionByName(fresh.select(have.columns))
        builds.stage(b, table, rows, part)

    only = lambda df, keys: df.join(keys, "entity", "left_semi")
    stage("prices", prices_of(only(daily, moved), only(new, moved)), moved)
    view = builds.overlay(b, {"prices": parts["prices"]})
    prices = builds.read("prices", view)
    concerned = members.join(sectors.withColumnRenamed("entity", "sector"), "sector", "left_semi")
    stage("index", index_of(prices.join(concerned.select("entity").distinct(), "entity", "left_semi"), concerned), sectors)
    view = builds.overlay(b, {"prices": parts["prices"], "index": parts["index"]})
    stage("features", features_of(only(builds.read("index", view, parts["index"]), sectors)), sectors)
    builds.stage(b, "breadth", etl.market_breadth(prices), F.lit(0))
    replaced = parts | {"breadth": None}
    done = {"entities": moved.count(), "sectors": sectors.count(), "parts": replaced}
    return done | {"version": builds.publish(b, replaced, {"kind": "changed", **done})}
