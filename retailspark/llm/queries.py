"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, hardneg, jaccard, langid, packing, quality, sharding, substrings, syncmers, tokenfile, topk, toxicity
from .common import documents


#: The id that ends each document.
END = 2


def doc_crc(mod: int):
    """crc32 of doc_id as text, modulo ``mod``: the folds of the classifiers."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def held_out(mod: int, fold: int):
    """Whether doc_id is in the fold that isn't learned from.  A row without a
    doc_id isn't learned from either: true."""
    return F.coalesce(doc_crc(mod) == fold, F.lit(True)).alias("held_out")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, 5)


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), sharding.tree(sharding.EIGHT), sharding.tree(sharding.NINE))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), END)
    return tokenfile.read_tokens(spark, path, with_ids=False)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = langid.fit(docs, doc_crc(4) != 2)
    return langid.identify(docs, net).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(documents(spark, sf_dir), 35, ["doc_id"], digest=True)
    return out.select("row.doc_id", "n_words", "n_removed", F.col("result").alias("kept_sha256"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), END, 1024)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_crc(5) != 0)
    return quality.predictions(docs, model, 0.3).select("doc_id", held_out(5, 0), "score", "predicted")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_crc(5) != 0)
    return toxicity.predictions(docs, model, 0.5).select("doc_id", held_out(5, 0), "score", "predicted")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, label, 5, 3)


QUERIES = {f.__name__: f for f in (op1_topk, op2_shard, op3_bpe, op4_tokenfile, op5_langid, op6_substrings, op7_syncmers, op8_packing, op9_quality, op10_jaccard, op11_toxicity, op12_alignment, op13_hardneg)}

ORACLES = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_substrings": r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT rid, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35
), s AS (
  SELECT p.rid, p.i, md5(array_to_string(w.ws[p.i:p.i + 34], ' ')) AS h FROM p JOIN w USING (rid)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1
), gone AS (
  SELECT DISTINCT rid, i + j.j AS i FROM r, (SELECT unnest(range(35)) AS j) j
), words AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)""",
    "op10_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM p
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), edge AS MATERIALIZED (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(b) FROM reach WHERE reach.a = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)""",
    "op13_hardneg": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS MATERIALIZED (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.rid <> c.rid WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.arid = s.arid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
