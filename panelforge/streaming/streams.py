"""Streams: bars with late data, sessions, a causal state filter per entity, and a resumable audit of targets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import target_audit
from panelforge.operators.models import GaussianStates
from panelforge.sources.store import Table

c = F.col


def read_events(spark: SparkSession, path: str, schema, max_files: int = 8) -> DataFrame:
    """A stream of the Parquet files that appear under path; ts is a timestamp (watermarks take no other type)."""
    return _timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path))


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", c("ts").cast("timestamp"))


def window_bars(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling bars per event type; rows later than the watermark are dropped by design of the stream."""
    key = F.struct("ts", "event_id")
    out = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), c("event_type").alias("entity")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count(F.lit(1)).alias("volume"), F.sum("value").alias("amount"),
    )
    return out.select("entity", c("window.start").alias("start"), "open", "high", "low", "close", "volume", "amount")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions per user: events with no gap over the given one."""
    out = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value"))
    return out.select("user_id", c("s.start").alias("start"), c("s.end").alias("end"), "n_events", "value")


def upsert_sink(stream: DataFrame, table: Table, checkpoint: str):
    """Writes each micro-batch into a keyed table; a batch that is run again changes nothing."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: table.upsert(batch)).start()


def filtered_stream(stream: DataFrame, column: str, model: GaussianStates) -> DataFrame:
    """Causal state of each entity, carried from batch to batch: the state is one probability vector."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("ts")
        p = np.array(state.get[0]) if state.exists else None
        out = []
        for x in pdf[column].to_numpy(float):
            d = model.log_density(np.array([[x]]))[0]
            p = (model.start if p is None else p @ model.transition) * np.exp(d - d.max())
            p = p / p.sum()
            out.append(int(p.argmax()))
        state.update((p.tolist(),))
        yield pd.DataFrame({"entity": key[0], "ts": pdf["ts"], "state": out})

    keyed = _timed(stream).select(c("event_type").alias("entity"), "ts", column)
    return keyed.groupBy("entity").applyInPandasWithState(run, "entity string, ts timestamp, state int", "p array<double>", "append", "NoTimeout")


def audit_stream(stored: DataFrame, audit: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Counters of a stream of stored targets, kept under path: each micro-batch leaves its own (audit gives them).

    A batch that is run again after a loss overwrites what it left, so nothing is counted twice, and a query that is
    started again goes on from its checkpoint.
    """

    def each(batch: DataFrame, number: int) -> None:
        audit(batch).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()


def audit_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters of all batches so far, put together."""
    return target_audit.added(spark.read.parquet(path).drop("batch"))
