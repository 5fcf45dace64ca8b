"""Raw line-item scans and phase-output sinks.

CSV is read with a fixed schema (dates as text, ids as text so leading zeros
survive) in FAILFAST mode; parquet phase outputs are plain parquet scans, so
Catalyst prunes columns and pushes filters into the reader.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.LongType()),
    T.StructField("InvoiceDate", T.StringType()),
    T.StructField("Price", T.DoubleType()),
    T.StructField("Customer ID", T.StringType()),
    T.StructField("Country", T.StringType()),
])

CLEAN_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
                 "UnitPrice", "CustomerID", "Country", "TotalPrice"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def load_raw(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV scan with the fixed raw schema; a missing file is an error.  Quoted
    fields hold commas and doubled quotes as RFC 4180 has them; ``multi_line``
    lets them hold line breaks (a file is then read by one task)."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"raw data not found at {path}")
    return (spark.read.schema(RAW_SCHEMA)
            .option("header", True)
            .option("mode", "FAILFAST")
            .option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line)
            .csv(path))


def load_clean(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan of the cleaned table; missing → error naming the producer."""
    if not _exists(spark, path):
        raise FileNotFoundError(
            f"clean transactions not found at {path}; write the result of "
            "retailspark.operators.clean.clean_transactions there first")
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Phase-output sink (parquet).  Array and struct columns are native."""
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header (campaign export)."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


#: The column by which each serving table is looked up.
LOOKUP_KEYS = {"customers": "customer_id", "customer_top_product": "customer_id", "products": "stock_code"}


def keyed_writer(df: DataFrame, key: str | None):
    """A Parquet writer that gives every row group a bloom filter on ``key``,
    sized by the keys that it has.  The column is not dictionary coded: almost
    every value is its own, and Parquet drops the filter of such a column."""
    if key is None:
        return df.write
    return (df.write.option(f"parquet.bloom.filter.enabled#{key}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option(f"parquet.enable.dictionary#{key}", "false"))


def load_all(spark: SparkSession, frames: dict, root: str, view_prefix: str | None = None,
             keys: dict[str, str] = LOOKUP_KEYS) -> DataFrame:
    """Replace all serving tables at once and return (table, rows).

    The tables go to a new folder under ``root``; a manifest that names it is
    swapped last.  A reader (``serving_table``) sees either all old tables or
    all new ones, also when a load fails half way.  Rows are counted from the
    written files' footers.  With ``view_prefix`` each table gets a temp view, named
    by the prefix and the table.  ``keys``: the columns that get bloom filters."""
    root = root.rstrip("/")
    version = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    rows = []
    for name, df in frames.items():
        path = f"{root}/versions/{version}/{name}"
        keyed_writer(df, keys.get(name)).parquet(path)
        rows.append((name, spark.read.schema(df.schema).parquet(path).count()))
    _swap_manifest(spark, root, version)
    if view_prefix is not None:
        for name in frames:
            serving_table(spark, root, name).createOrReplaceTempView(f"{view_prefix}{name}")
    return spark.createDataFrame(rows, "table string, rows bigint")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _swap_manifest(spark: SparkSession, root: str, version: str) -> None:
    """Manifests are files named by version, made by a rename; the last one counts."""
    fs, path = _file_system(spark, root)
    made = path(f"{root}/manifest/.{version}")
    out = fs.create(made, True)
    out.write(bytearray(version.encode()))
    out.close()
    if not fs.rename(made, path(f"{root}/manifest/{version}")):
        raise OSError(f"the manifest of {root} could not be swapped")


def serving_version(spark: SparkSession, root: str) -> str:
    """The version that the manifest names."""
    root = root.rstrip("/")
    fs, path = _file_system(spark, root)
    if not fs.exists(path(f"{root}/manifest")):
        raise FileNotFoundError(f"no serving tables at {root}; run load_all first")
    names = [x.getPath().getName() for x in fs.listStatus(path(f"{root}/manifest"))]
    return max(n for n in names if not n.startswith("."))


def serving_table(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A serving table of the current version (or of the one given, for
    several tables of one load)."""
    return spark.read.parquet(f"{root.rstrip('/')}/versions/{version or serving_version(spark, root)}/{name}")


def lookup(spark: SparkSession, root: str, name: str, value, key: str | None = None, version: str | None = None) -> DataFrame:
    """The rows of a serving table whose key equals ``value``, which is bound
    as a parameter, never put into the statement.  Row groups whose range or
    bloom filter rules the value out are not read.  NULL finds nothing."""
    key = key or LOOKUP_KEYS[name]
    return spark.sql("SELECT * FROM {rows} WHERE {key} = :value", args={"value": value},
                     rows=serving_table(spark, root, name, version), key=F.col(key))
