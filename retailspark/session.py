"""SparkSession helpers.

The library never hard-codes a cluster layout.  ``get_session`` is only a
convenience for tests, the bench and local runs: on a cluster the caller's
session is used as-is and we merely read settings from it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on for correct semantics (not for speed).
SEMANTIC_CONF = {
    # naive timestamps: the data has no zone, results must not depend on one
    "spark.sql.session.timeZone": "UTC",
    # ANSI mode makes bad casts raise instead of silently producing NULL
    "spark.sql.ansi.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "retailspark") -> SparkSession:
    """Local/test session.  Adaptive execution on, UI off, UTC."""
    master = master or os.environ.get("RETAILSPARK_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RETAILSPARK_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SEMANTIC_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_semantic_conf(spark: SparkSession) -> None:
    for k, v in SEMANTIC_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Only a ``local`` master (tests, one machine: driver and tasks are one
    process) may leave it unset; a scratch folder is then made and set.  On a
    cluster a machine-local folder would be a different disk on every
    executor, so there it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="retailspark-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends
    there, and a lost executor's work is repeated from the written table."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/retailspark/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, name: str, rows_each: int = 100_000) -> DataFrame:
    """``stored``, read back in one partition per ``rows_each`` rows: for tables
    that an iterative fit passes over many times, where a task per nearly empty
    partition is all the cost.  A large table keeps as many partitions as its
    rows ask for."""
    rows = stored(df, name)
    return rows.coalesce(max(1, -(-rows.count() // rows_each)))


def on_workers(df: DataFrame) -> DataFrame:
    """``df``, after making sure that Python workers look for this package
    where the driver has it (a driver may have put it on its own path only)."""
    env = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return df
