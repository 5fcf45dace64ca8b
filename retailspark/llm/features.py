"""Bounded labelled samples for the two classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, one_each


def labelled_sample(docs: DataFrame, label: str, usable: Column, per_label: int, most: int) -> DataFrame:
    """doc_id, text and ``label`` of at most ``per_label`` rows of each label
    and at most ``most`` in all, chosen by a hash of doc_id among the rows that
    are ``usable`` and have a text.  The choice shuffles ids and labels only.
    A doc_id that occurs in several rows is used once, with the smallest of its
    labels and then the text of the smallest hash."""
    ok = usable & F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    ids = first_by_hash(docs.filter(ok).groupBy("doc_id").agg(F.min(label).alias(label)), [label], "doc_id", per_label)
    ids = ids.orderBy(F.xxhash64(F.lit("all"), F.col("doc_id")), "doc_id").limit(most)
    # at most ``most`` ids of 8 bytes: a bounded broadcast
    rows = docs.filter(ok).select("doc_id", label, "text").join(F.broadcast(ids.select("doc_id", label)), ["doc_id", label], "left_semi")
    return one_each(rows, ["doc_id", label])


def collected(df: DataFrame) -> pa.Table:
    """A bounded sample, at the driver, in an order that doesn't depend on tasks."""
    table = df.toArrow()
    return table.sort_by([(c, "ascending") for c in ("doc_id",) if c in table.column_names])
