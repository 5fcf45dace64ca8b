"""Chunked campaign drafts."""

import json

from pyspark.sql import functions as F

from retailspark.operators import campaign as cp

SCHEMA = "approval_id int, customer_id string, segment string, predicted_clv double, discount double, offer string"


def _rows(n, approval):
    return [(approval, f"c{i}", None if i % 7 == 0 else "At Risk", i / 3, 0.1, None if i % 5 == 0 else 'a "b", 喚醒') for i in range(n)]


def test_drafts_come_back_whole_from_bounded_chunks(spark):
    rows = _rows(1000, 1) + _rows(3, 2)
    docs = cp.draft_document(spark.createDataFrame(rows, SCHEMA), each=50)
    assert sorted(map(repr, map(tuple, cp.draft_candidates(docs).collect()))) == sorted(map(repr, rows))
    assert {r["approval_id"]: r["count"] for r in cp.draft_heads(docs).collect()} == {1: 1000, 2: 3}
    chunks = docs.filter("chunk > 0").collect()
    assert {r["chunks"] for r in chunks if r["approval_id"] == 1} == {21}
    assert max(len(json.loads(r["document"])) for r in chunks) <= 100  # 50 on average
    assert all(1 <= r["chunk"] < r["chunks"] for r in chunks)


def test_no_candidates_make_no_document(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cp.draft_document(none).collect() == []
    assert cp.draft_candidates(cp.draft_document(none)).collect() == []


def test_revision_is_a_step_of_the_job(spark):
    c = spark.createDataFrame(_rows(10, 1), SCHEMA).drop("approval_id").fillna("x", ["segment"])
    gone = spark.createDataFrame([("c1",), ("c2",)], "customer_id string")
    new = spark.createDataFrame([("c3", 0.05)], "customer_id string, discount double")
    row = cp.campaign_build(c, "t", excluded=gone, overrides=new).first()
    assert row["candidate_count"] == 8
    assert row["brief"] == cp.campaign_build(cp.campaign_revision(c, gone, new), "t").first()["brief"] != cp.campaign_build(c, "t").first()["brief"]
    assert cp.campaign_build(c.filter(F.lit(False)), "t", excluded=gone, overrides=new).first()["candidate_count"] == 0
