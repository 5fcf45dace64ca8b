"""Shared helpers: working tables, gapless numbering, deterministic samples."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Settings for the time of one write in ``stored``; the caller's come back after it.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608b"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a ``local`` master, where all tasks run in one process, may leave it
    unset: then a scratch folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends
    there, and a lost executor's work is repeated from the written table.  The
    shuffle files of the write, which nothing reads any more, go with its end
    (else they stay until the driver's JVM happens to collect its garbage), and
    Arrow batches are kept small while it runs, for the Python workers' memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}/{name}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(rows: int, each: int = 200_000) -> int:
    return max(1, math.ceil(rows / each))


def number_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str, rows: int) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... without gaps within each group.

    A group may hold any share of the rows: rows are dealt to hash buckets of
    about 200,000 rows, numbered inside (group, bucket), and shifted by the
    counts of the group's earlier buckets.  ``rows``: how many ``df`` has.
    Rows equal in ``order`` go in any order among themselves.
    """
    n = partitions_for(rows)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    keys = [*groups, "_bucket"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        df.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def first_by_hash(df: DataFrame, groups: Sequence[str], key: str, n: int, buckets: int = 64) -> DataFrame:
    """The ``n`` rows of each group that come first by a hash of ``key``: a
    sample of bounded size, the same on every run.  Keep ``df`` narrow.  A
    group is cut in ``buckets`` first, by the same hash, so that none is one
    task's: the last step reads ``buckets`` * n rows of a group at most."""
    order = (F.xxhash64(F.lit("sample"), F.col(key)), F.col(key))
    df = df.withColumn("_bucket", F.pmod(order[0], F.lit(buckets)))
    for by in ([*groups, "_bucket"], [*groups]):
        df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")
    return df.drop("_bucket")


def one_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One text for each value of ``keys``: that of the smallest hash.  For
    samples whose ids may be repeated over any share of the rows."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
