"""Cleaning raw line items into the analysis-ready transactions table.

Order matters (it changes the audit): rename → parse dates → normalise
customer id → drop exact duplicates → not cancelled → product code →
quantity > 0 → price > 0 → customer id present → TotalPrice.

The audit is computed in **one** pass: after the duplicate collapse every
distinct row is tagged with the first rule it fails, and a single grouped
count gives all step sizes — no re-counting after every filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's for identical results.
COLUMN_RENAME = {
    "Invoice": "InvoiceNo",
    "StockCode": "StockCode",
    "Description": "Description",
    "Quantity": "Quantity",
    "InvoiceDate": "InvoiceDate",
    "Price": "UnitPrice",
    "Customer ID": "CustomerID",
    "Country": "Country",
}
CANCELLATION_PREFIX = "C"
# Java's `$` also matches before a final newline, so the full match ends in \z.
PRODUCT_STOCKCODE_PATTERN = r"^[0-9]{5}[A-Za-z]{0,3}\z"

AUDIT_STEPS = [
    (0, "raw rows"),
    (1, "drop exact duplicates"),
    (2, "drop cancellations (invoice C*)"),
    (3, "drop non-product stock codes"),
    (4, "drop non-positive quantity"),
    (5, "drop non-positive unit price"),
    (6, "drop missing customer id"),
]


def standardize_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in COLUMN_RENAME.items() if k in df.columns})


def parse_dates(df: DataFrame) -> DataFrame:
    """Text → timestamp_ntz; already-timestamp columns are left alone.
    Under ANSI mode unparseable text raises."""
    dt = df.schema["InvoiceDate"].dataType
    if isinstance(dt, T.TimestampNTZType):
        return df
    if isinstance(dt, (T.TimestampType, T.DateType)):
        return df.withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp_ntz"))
    return df.withColumn("InvoiceDate", F.to_timestamp_ntz(F.col("InvoiceDate")))


def normalize_customer_id(df: DataFrame) -> DataFrame:
    """"13085.0" → "13085", exactly, up to 38 digits ("1.3085E4" too, up to
    2**53).  What is no whole number becomes NULL: text, 'NaN', infinities,
    fractions ("13085.7" is not customer 13085) and anything longer.  Ids in
    plain form ("13085", "13085.0", up to 18 digits) need no pattern."""
    text = "CAST(CustomerID AS STRING)"
    whole = f"substring_index({text}, '.', 1)"
    plain = (f"CAST(try_cast({whole} AS BIGINT) AS STRING) = {whole} AND length({whole}) <= 18"
             f" AND ({text} = {whole} OR {text} = concat({whole}, '.0'))")
    return df.withColumn("CustomerID", F.expr(
        f"CASE WHEN {plain} THEN {whole}"
        " WHEN regexp_extract(trim(CAST(CustomerID AS STRING)), '^([+-]?[0-9]{1,38})(?:[.]0*)?$', 1) <> ''"
        " THEN CAST(CAST(regexp_extract(trim(CAST(CustomerID AS STRING)), '^([+-]?[0-9]{1,38})', 1)"
        "           AS DECIMAL(38, 0)) AS STRING)"
        " WHEN trim(CAST(CustomerID AS STRING)) RLIKE '[0-9][eE][+-]?[0-9]'"
        "  AND abs(try_cast(CustomerID AS DOUBLE)) <= 9007199254740992D"
        "  AND try_cast(CustomerID AS DOUBLE) = rint(try_cast(CustomerID AS DOUBLE))"
        " THEN CAST(CAST(try_cast(CustomerID AS DOUBLE) AS BIGINT) AS STRING) END"))


def add_total_price(df: DataFrame) -> DataFrame:
    return df.withColumn("TotalPrice", F.col("Quantity") * F.col("UnitPrice"))


def is_cancellation(c: Column | None = None) -> Column:
    c = F.col("InvoiceNo") if c is None else c
    return F.coalesce(c.startswith(CANCELLATION_PREFIX), F.lit(False))


def is_product_stockcode(c: Column | None = None) -> Column:
    c = F.col("StockCode") if c is None else c
    return F.coalesce(c.rlike(PRODUCT_STOCKCODE_PATTERN), F.lit(False))


def _first_failed_rule() -> Column:
    """0 = row survives, else the AUDIT_STEPS index of the first failing rule."""
    return (F.when(is_cancellation(), 2)
            .when(~is_product_stockcode(), 3)
            .when(~F.coalesce(F.col("Quantity") > 0, F.lit(False)), 4)
            .when(~F.coalesce(F.col("UnitPrice") > 0, F.lit(False)), 5)
            .when(F.col("CustomerID").isNull(), 6)
            .otherwise(0))


def normalized(raw: DataFrame) -> DataFrame:
    return normalize_customer_id(parse_dates(standardize_columns(raw)))


def tagged(raw: DataFrame, partitions: int | None = None, near: str | None = None) -> DataFrame:
    """Every distinct normalised row with ``_copies`` and ``_rule`` (0: it
    stays, else the AUDIT_STEPS index of the first rule it fails).  One
    shuffle; the cleaned table and the audit both come from it.

    Rows go to their task before they are grouped: few are equal, so a table
    of groups ahead of the shuffle would hold a whole task's input.
    ``partitions``: number of tasks (default: what the session shuffles with).
    ``near``: a further column of ``raw``, of one value in equal rows, by which
    the rows were shuffled already; they are grouped where they are."""
    norm = normalized(raw)
    if near is None:
        norm = norm.repartition(partitions, *norm.columns) if partitions else norm.repartition(*norm.columns)
    distinct_rows = norm.groupBy(*norm.columns).agg(F.count(F.lit(1)).alias("_copies"))
    if near is not None:
        distinct_rows = distinct_rows.drop(near)
    return distinct_rows.withColumn("_rule", _first_failed_rule())


def cleaned(rows: DataFrame) -> DataFrame:
    """Cleaned transactions (canonical schema, TotalPrice added) of ``tagged`` rows."""
    return add_total_price(rows.filter(F.col("_rule") == 0).drop("_copies", "_rule"))


def audit(rows: DataFrame) -> DataFrame:
    """(step_no, step, rows_removed, rows_remaining) of ``tagged`` rows: 7 lines
    from one aggregation, unrolled."""
    totals = rows.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_raw"),
        F.count(F.lit(1)).alias("n_distinct"),
        *[F.count(F.when(F.col("_rule") == i, 1)).alias(f"r{i}") for i in range(2, 7)])
    removed = {0: F.lit(0).cast("bigint"), 1: F.col("n_raw") - F.col("n_distinct")}
    removed.update({i: F.col(f"r{i}") for i in range(2, 7)})
    lines, running = [], F.col("n_raw")
    for no, label in AUDIT_STEPS:
        running = running - removed[no]
        lines.append(F.struct(F.lit(no).alias("step_no"), F.lit(label).alias("step"),
                              removed[no].cast("bigint").alias("rows_removed"),
                              running.cast("bigint").alias("rows_remaining")))
    return totals.select(F.inline(F.array(*lines)))


def clean_transactions(raw: DataFrame) -> DataFrame:
    return cleaned(tagged(raw))


def clean_audit(raw: DataFrame) -> DataFrame:
    return audit(tagged(raw))
