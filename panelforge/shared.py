"""Tables that a job writes in between: in the folder that driver and executors share, so that a lost executor costs a stage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = "panelforge.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a local one where all tasks run in this process.

    Spark doesn't let a running session set spark.checkpoint.dir, so a local folder is remembered under an own key.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_DIR, None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a shared folder on {master}")
        path = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set(_OWN_DIR, path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pf_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that materialize wrote and that nothing reads any more."""
    for t in tables:
        if t is not None and hasattr(t, "_pf_path"):
            path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._pf_path)
            path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
