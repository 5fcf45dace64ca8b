"""A training corpus from ``documents``: quality, language, near duplicates, repeats, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of docs; the last returns the packed pieces.  Empty tables pass
through; null texts count as empty and go at the language stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.llm import jaccard, langid, packing, quality, substrings
from retailspark.llm.common import documents, stored
from retailspark.llm.queries import END, doc_crc


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of score 0.3 or more stay; learned from the labels of the learning folds."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_crc(5) != 0)
    return quality.accepted(docs, model, 0.3)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose best language scores below 0.3."""
    return langid.accepted(docs, langid.fit(docs, doc_crc(4) != 2), 0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id."""
    return jaccard.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that repeat are taken out; n_chars follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    out = substrings.remove_repeats(docs, 35, rest)
    made = {"text": F.col("result"), "n_chars": F.char_length("result").cast("long")}
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END, 1024)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: Trained classifiers decide in the first two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
