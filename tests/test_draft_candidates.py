"""The draft that campaign_build makes holds its candidates and their offers."""

import pytest

from retailspark.plans import registry as R

OFFERS = "customer_id string, rank int, consequents string"
CUSTOMERS = "customer_id string, segment string, predicted_clv double, recency int, prob_alive double"


@pytest.fixture
def built(spark, tmp_path, monkeypatch):
    def run(name, customers, offers):
        monkeypatch.setattr(R, "_winback", lambda *_: spark.createDataFrame(customers, CUSTOMERS))
        monkeypatch.setattr(R, "_offers", lambda *_: spark.createDataFrame(offers, OFFERS))
        folder = tmp_path / name
        folder.mkdir()
        return R.QUERIES["campaign_build"](spark, str(folder))
    return run


def test_offers_reach_the_draft(built):
    people = [(f"c{i}", "At Risk", 100.0 - i, 10, 0.9) for i in range(6)]
    some = [("c0", 1, "tea"), ("c0", 2, "cup"), ("c4", 1, "jug")]
    draft = built("some", people, some)
    got = {r["customer_id"]: (r["predicted_clv"], r["discount"], r["offer"]) for r in draft.collect()}
    assert got == {"c0": (100.0, 0.2, "tea"), "c1": (99.0, 0.2, None), "c2": (98.0, 0.15, None),
                   "c3": (97.0, 0.15, None), "c4": (96.0, 0.1, "jug"), "c5": (95.0, 0.1, None)}
    head = draft.select("thread_id", "brief", "status", "candidate_count", "created_at").distinct().collect()
    assert len(head) == 1 and head[0]["candidate_count"] == 6 and head[0]["status"] == "pending"
    other = built("other", people, [("c0", 1, "pot")])
    assert [r["offer"] for r in other.filter("offer is not null").collect()] == ["pot"]


def test_repeated_and_null_candidates_are_kept(built):
    twice = [("c1", "At Risk", 5.0, 10, 0.9)] * 2 + [(None, None, None, None, None)]
    rows = built("twice", twice, [("c1", 1, "tea")]).collect()
    assert [r["candidate_count"] for r in rows] == [3] * 3
    assert sorted((r["customer_id"] or "", r["offer"]) for r in rows) == [("", None), ("c1", "tea"), ("c1", "tea")]


def test_no_candidates_make_a_draft_of_none(built):
    rows = built("none", [], [("c1", 1, "tea")]).collect()
    assert [(r["candidate_count"], r["customer_id"], r["offer"]) for r in rows] == [(0, None, None)]
