"""Hand-computable fixtures (modelled on the reference's own unit tests)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailspark.operators import basket, campaign, clean, clv, eda, rfm
from retailspark.sources.retail import RAW_SCHEMA


def ts(s):
    return dt.datetime.fromisoformat(s)


RAW = [
    ("489434", "85048", "LIGHT", 12, "2009-12-01 07:45:00", 6.95, "13085.0", "United Kingdom"),
    ("489434", "85048", "LIGHT", 12, "2009-12-01 07:45:00", 6.95, "13085.0", "United Kingdom"),
    ("489435", "79323P", "PINK", 6, "2009-12-01 07:46:00", 2.10, "13085.0", "United Kingdom"),
    ("489436", "22423", "CAKE", 2, "2009-12-01 09:06:00", 12.75, "14911.0", "EIRE"),
    ("C489437", "22423", "CAKE", -3, "2009-12-01 09:08:00", 12.75, "14911.0", "EIRE"),
    ("489438", "21232", "MUG", -2, "2009-12-01 09:24:00", 1.25, "14911.0", "EIRE"),
    ("489439", "POST", "POSTAGE", 1, "2009-12-01 09:28:00", 18.0, "12680.0", "France"),
    ("489440", "21212", "CASES", 10, "2009-12-01 09:30:00", 0.0, "12680.0", "France"),
    ("489441", "21213", "CASES", 4, "2009-12-01 09:31:00", 0.55, None, "United Kingdom"),
    ("489442", "22041", "CARD", 24, "2009-12-01 09:33:00", 0.65, "12680.0", "France"),
    ("489443", "M", "Manual", 1, "2009-12-01 09:34:00", 2.0, "12680.0", "France"),
    ("489444", "22041", "CARD", 12, "2009-12-01 09:35:00", 0.65, "12680.0", "France"),
]


def test_clean_keeps_five_and_audit_adds_up(spark):
    raw = spark.createDataFrame(RAW, RAW_SCHEMA)
    out = clean.clean_transactions(raw)
    rows = out.collect()
    assert len(rows) == 5
    assert {r.CustomerID for r in rows} == {"13085", "14911", "12680"}
    assert all(abs(r.TotalPrice - r.Quantity * r.UnitPrice) < 1e-12 for r in rows)
    audit = {r.step_no: r for r in clean.clean_audit(raw).collect()}
    assert [audit[i].rows_removed for i in range(7)] == [0, 1, 1, 2, 1, 1, 1]
    assert audit[6].rows_remaining == 5


def test_product_pattern_full_match(spark):
    df = spark.createDataFrame([("85048",), ("79323P",), ("84997BLXY",), ("POST",), ("85048\n",),
                                (None,)], "StockCode string")
    got = [r.p for r in df.select(clean.is_product_stockcode().alias("p")).collect()]
    assert got == [True, True, False, False, False, False]


def test_rfm_hand_computed(spark):
    tx = spark.createDataFrame([
        ("A", "1001", ts("2024-01-10 00:00:00"), 10.0), ("A", "1002", ts("2024-01-30 00:00:00"), 20.0),
        ("B", "2001", ts("2024-01-20 00:00:00"), 21.0), ("B", "2001", ts("2024-01-20 00:00:00"), 14.0),
        ("C", "3001", ts("2024-01-31 00:00:00"), 100.0)],
        "CustomerID string, InvoiceNo string, InvoiceDate timestamp_ntz, TotalPrice double")
    got = {r.CustomerID: (r.Recency, r.Frequency, r.Monetary) for r in rfm.compute_rfm(tx).collect()}
    assert got == {"A": (2, 2, 30.0), "B": (12, 1, 35.0), "C": (1, 1, 100.0)}


def test_day_gap_floors_exact_timestamps(spark):
    tx = spark.createDataFrame([("A", "1", ts("2024-01-01 23:00:00"), 1.0),
                                ("B", "2", ts("2024-01-03 01:00:00"), 1.0)],
                               "CustomerID string, InvoiceNo string, InvoiceDate timestamp_ntz, TotalPrice double")
    got = {r.CustomerID: r.Recency for r in rfm.compute_rfm(tx).collect()}
    # snapshot 2024-01-04 01:00: A is 2 days 2 hours back → 2 (not 3 calendar days)
    assert got == {"A": 2, "B": 1}


@pytest.mark.parametrize("n", [5, 7, 12, 200])
def test_rfm_bins_match_quantile_cut_of_ranks(spark, n):
    import numpy as np
    df = spark.createDataFrame([(i,) for i in range(1, n + 1)], "rank int")
    got = [r.b for r in df.select(rfm.quantile_bin(F.col("rank"), F.lit(n)).alias("b"))
           .orderBy("rank").collect()]
    edges = np.quantile(np.arange(1, n + 1), np.linspace(0, 1, 6))
    want = [max(1, int(np.searchsorted(edges, r, side="left"))) for r in range(1, n + 1)]
    assert got == want


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("ascending", [True, False])
def test_global_rank_equals_one_sort(spark, partitions, ascending):
    """Heavy ties and NULLs: first in ascending, last in descending order."""
    from retailspark.functions.rank import SortKey, with_global_rank
    rows = [(f"c{i:04d}", None if i % 5 == 0 else i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, v int")
    r = with_global_rank(df, [SortKey("v", ascending), SortKey("id")], "r", partitions)
    assert dict(r.dtypes)["r"] == "bigint"
    got = {x.id: x.r for x in r.collect()}
    def key(t):
        null = t[1] is None
        return (not null, t[1] or 0, t[0]) if ascending else (null, -(t[1] or 0), t[0])
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=key))}


def test_global_rank_of_nothing(spark):
    from retailspark.functions.rank import SortKey, with_global_rank
    df = spark.createDataFrame([], "id string, v int")
    assert with_global_rank(df, [SortKey("v"), SortKey("id")], "r").collect() == []


def test_quantile_bins_of_billions(spark):
    """No INT overflow: the last of 5e9 customers is in the top bin."""
    df = spark.createDataFrame([(1,), (2_500_000_000,), (5_000_000_000,)], "rank bigint")
    n = F.lit(5_000_000_000)
    assert [r.b for r in df.select(rfm.quantile_bin(F.col("rank"), n).alias("b")).collect()] == [1, 3, 5]


def test_score_segments_grid(spark):
    import random
    random.seed(0)
    data = [(f"{i:03d}", random.randint(1, 400), random.randint(1, 30), random.uniform(10, 5000))
            for i in range(200)]
    df = spark.createDataFrame(data, "CustomerID string, Recency int, Frequency bigint, Monetary double")
    s = rfm.score_rfm(df, partitions=4).collect()
    assert all(1 <= r.R <= 5 and 1 <= r.F <= 5 and 1 <= r.M <= 5 and 1 <= r.FM <= 5 for r in s)
    assert all(r.Segment is not None and r.Action is not None for r in s)
    summ = rfm.summarize_segments(spark.createDataFrame(s)).collect()
    assert abs(sum(r.customer_share for r in summ) - 1) < 1e-9
    assert abs(sum(r.revenue_share for r in summ) - 1) < 1e-9


def test_fm_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "F int, M int")
    got = [r.fm for r in df.select(F.bround((F.col("F") + F.col("M")) / 2.0, 0).alias("fm")).collect()]
    assert got == [2.0, 2.0]


def test_top_product_ties_and_null_customers(spark):
    tx = spark.createDataFrame([
        ("C1", "AAA", 10.0), ("C1", "BBB", 50.0), ("C1", "BBB", 5.0),
        ("C2", "ZZZ", 20.0), ("C2", "YYY", 20.0), (None, "AAA", 999.0)],
        "CustomerID string, StockCode string, TotalPrice double")
    got = {r.customer_id: (r.stock_code, r.revenue) for r in eda.build_customer_top_product(tx).collect()}
    assert got == {"C1": ("BBB", 55.0), "C2": ("YYY", 20.0)}


def test_historical_clv(spark):
    tx = spark.createDataFrame([
        ("A", "1", ts("2024-01-01 00:00:00"), 100.0), ("A", "2", ts("2024-01-31 00:00:00"), 300.0),
        ("B", "3", ts("2024-01-10 00:00:00"), 50.0)],
        "CustomerID string, InvoiceNo string, InvoiceDate timestamp_ntz, TotalPrice double")
    h = {r.CustomerID: r for r in clv.historical_clv(tx).collect()}
    assert (h["A"].total_revenue, h["A"].n_orders, h["A"].avg_order_value, h["A"].tenure_days) == (400.0, 2, 200.0, 30)
    assert h["B"].tenure_days == 0 and h["B"].annual_value == 50 * 365


def test_basket_planted_rule(spark):
    rows = []
    for i in range(10):
        rows += [(f"i{i}", "A"), (f"i{i}", "B")]
    for i in range(10, 15):
        rows += [(f"i{i}", "C"), (f"i{i}", "D")]
    for i in range(15, 20):
        rows += [(f"i{i}", "A")]
    tx = spark.createDataFrame(rows, "InvoiceNo string, StockCode string")
    keep = {r.StockCode for r in basket.frequent_products(tx, 0.3).collect()}
    assert keep == {"A", "B"}
    rules = basket.mine_rules(tx, 0.01, 0.01).collect()
    ab = [r for r in rules if r.antecedents == ["A"] and r.consequents == ["B"]][0]
    assert abs(ab.support - 0.5) < 1e-12
    assert abs(ab.confidence - 10 / 15) < 1e-12
    assert abs(ab.lift - (10 / 15) / (10 / 20)) < 1e-12
    recs = basket.recommend_for_baskets(
        basket.mine_rules(tx, 0.01, 0.01),
        spark.createDataFrame([("b", ["A"]), ("x", ["ZZZ"])], "basket_id string, items array<string>")).collect()
    assert [(r.basket_id, r.StockCode) for r in recs] == [("b", "B")]


def test_multi_item_consequents(spark):
    rows = [(f"i{i}", x) for i in range(10) for x in ("A", "B", "C")]
    tx = spark.createDataFrame(rows, "InvoiceNo string, StockCode string")
    rules = basket.mine_rules(tx, 0.01, 0.01).collect()
    assert any(len(r.consequents) == 2 for r in rules)
    assert len(rules) == 12  # 3 pairs × 2 + 6 splits of the triple


def test_discount_tiers_and_revision(spark):
    c = spark.createDataFrame([(f"C{i}", "At Risk" if i <= 4 else "Can't Lose Them", float(v))
                               for i, v in enumerate([900, 700, 500, 300, 200, 100], start=1)],
                              "customer_id string, segment string, predicted_clv double")
    t = {r.customer_id: r.discount for r in campaign.discount_tiers(c).collect()}
    assert t == {"C1": .2, "C2": .2, "C3": .15, "C4": .15, "C5": .1, "C6": .1}
    rev = campaign.campaign_revision(
        campaign.discount_tiers(c), spark.createDataFrame([("C1",), ("C3",)], "customer_id string"),
        spark.createDataFrame([("C6", 0.05)], "customer_id string, discount double"))
    got = {r.customer_id: r.discount for r in rev.collect()}
    assert got == {"C2": .2, "C4": .15, "C5": .1, "C6": .05}
    s = campaign.campaign_summary(rev).first()
    assert s["count"] == 4 and s["by_segment"] == {"At Risk": 2, "Can't Lose Them": 2}
    empty = campaign.campaign_summary(rev.limit(0)).first()
    assert empty["count"] == 0 and empty["avg_predicted_clv"] == 0.0


def test_campaign_review(spark):
    """revise → approve, approve → revise, reject, two drafts a thread, no decision."""
    rows = [(a, f"t{a // 2}", ts(f"2024-01-0{a + 1} 00:00:00"), f"C{i}", "At Risk", 100.0 * i, 0.2, None)
            for a in range(5) for i in range(1, 4)]
    cands = spark.createDataFrame(rows, "approval_id bigint, thread_id string, created_at timestamp_ntz, customer_id string, "
                                        "segment string, predicted_clv double, discount double, offer string")
    drafts = campaign.campaign_drafts(cands)
    assert {r.approval_id: r.candidate_count for r in drafts.collect()} == {a: 3 for a in range(5)}
    dec = spark.createDataFrame([
        (0, "revised", "bob", "drop C3", ts("2024-01-02 00:00:00"), ["C3"], {"C1": 0.05}),
        (0, "revised", "bob", "less", ts("2024-01-02 01:00:00"), [], {"C1": 0.07}),
        (0, "approved", "alice", "ok", ts("2024-01-03 00:00:00"), [], {}),
        (0, "rejected", "eve", "late", ts("2024-01-04 00:00:00"), ["C1"], {}),
        (1, "approved", "alice", "fine", ts("2024-01-03 00:00:00"), None, None),
        (1, "revised", "bob", "too late", ts("2024-01-05 00:00:00"), ["C1", "C2", "C3"], {}),
        (2, "rejected", "carol", "no", ts("2024-01-02 00:00:00"), [], {}),
        (3, "revised", "dan", "all", ts("2024-01-02 00:00:00"), ["C1", "C2", "C3"], {}),
        (9, "approved", "x", "unknown", ts("2024-01-02 00:00:00"), [], {})],
        "approval_id bigint, action string, reviewer string, review_note string, decided_at timestamp_ntz, "
        "excluded array<string>, overrides map<string,double>")
    after, left = campaign.campaign_decisions(drafts, cands, dec)
    got = {r.approval_id: (r.status, r.reviewer, r.review_note, r.candidate_count) for r in after.collect()}
    assert got == {0: ("approved", "alice", "ok", 2), 1: ("approved", "alice", "fine", 3), 2: ("rejected", "carol", "no", 3),
                   3: ("pending", None, "all", 0), 4: ("pending", None, None, 3)}
    briefs = {r.approval_id: r.brief for r in after.collect()}
    assert "喚醒 2 位" in briefs[0] and "喚醒 0 位" in briefs[3] and "喚醒 3 位" in briefs[4]
    kept = {(r.approval_id, r.customer_id): r.discount for r in left.collect()}
    assert kept[0, "C1"] == 0.07 and kept[0, "C2"] == 0.2 and (0, "C3") not in kept and (1, "C1") in kept
    assert not any(a == 3 for a, _ in kept)
    again, _ = campaign.campaign_decisions(after, left, dec)  # decided rows stay as they are
    assert {r.approval_id: r.status for r in again.collect()} == {k: v[0] for k, v in got.items()}
    assert {r.thread_id: r.approval_id for r in campaign.campaign_latest(after).collect()} == {"t0": 1, "t1": 3, "t2": 4}
    assert [r.approval_id for r in campaign.campaign_list(after, "pending").collect()] == [4, 3]
    assert len(campaign.campaign_list(after, limit=2).collect()) == 2


def test_conversation_append_upserts_threads(spark):
    threads = spark.createDataFrame([("a", "c1"), ("b", None)], "thread_id string, customer_id string")
    cols = "thread_id string, turn int, role string, content string"
    old = spark.createDataFrame([("a", 0, "human", "hi")], cols)
    new = spark.createDataFrame([("a", 1, "ai", "x", None), ("b", 2, "ai", "y", "late"), ("b", 1, "ai", "z", "c2"), ("n", 0, "human", "q", None)],
                                cols + ", customer_id string")
    t, m = campaign.conversation_append(threads, old, new)
    assert {r.thread_id: r.customer_id for r in t.collect()} == {"a": "c1", "b": "c2", "n": None}
    assert m.count() == 5
    pos = [(r.thread_id, r.position, r.content) for r in campaign.conversation_history(m).orderBy("thread_id", "position").collect()]
    assert pos == [("a", 1, "hi"), ("a", 2, "x"), ("b", 1, "z"), ("b", 2, "y"), ("n", 1, "q")]


def test_violations_are_found(spark):
    df = spark.createDataFrame([("human",), ("robot",), (None,), ("robot",)], "role string")
    assert {r.value: r.rows for r in campaign.role_violations(df).collect()} == {"robot": 2, None: 1}
    assert campaign.status_violations(spark.createDataFrame([("pending",), ("done",)], "status string")).collect()[0].value == "done"


def test_offer_limit_is_checked(spark):
    from retailspark.operators import serving
    rules = spark.createDataFrame([], "antecedents_codes string, consequents_codes string, antecedents string, consequents string, "
                                      "lift double, support double, confidence double")
    for bad in (0, 21):
        with pytest.raises(ValueError):
            serving.offers_per_antecedent(rules, bad)
    assert serving.offers_per_antecedent(rules, 20).collect() == []


def test_bgnbd_recovers_parameters(spark):
    """Simulate BG/NBD customers with known parameters and refit."""
    import numpy as np
    rng = np.random.default_rng(7)
    r, alpha, a, b, n, T = 0.7, 20.0, 0.5, 1.5, 4000, 200.0
    lam = rng.gamma(r, 1 / alpha, n)
    p = rng.beta(a, b, n)
    rows = []
    for i in range(n):
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / lam[i])
            if t > T:
                break
            x, last = x + 1, t
            if rng.random() < p[i]:
                break
        rows.append((str(i), float(x), float(last), T, 10.0 if x else 0.0))
    s = spark.createDataFrame(rows, "CustomerID string, frequency double, recency double, T double, monetary_value double")
    fit = clv.fit_bgnbd(s, penalizer=0.0)
    est = dict(zip(fit.names, fit.coef))
    assert abs(est["r"] - r) / r < 0.25
    assert abs(est["alpha"] - alpha) / alpha < 0.35


def test_kmeans_blobs_and_scaling(spark):
    import random
    from retailspark.operators import kmeans
    random.seed(1)
    rows = [(f"L{i:03d}", 300 + random.randint(0, 20), 1 + random.randint(0, 1), 50 + random.random() * 10)
            for i in range(100)]
    rows += [(f"H{i:03d}", 5 + random.randint(0, 3), 20 + random.randint(0, 5), 5000 + random.random() * 500)
             for i in range(100)]
    df = spark.createDataFrame(rows, "CustomerID string, Recency int, Frequency int, Monetary double")
    feat = kmeans.scaled_features(df)
    m = feat.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(kmeans.FEATURES)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(kmeans.FEATURES)]).first()
    assert all(abs(m[f"m{i}"]) < 1e-9 and abs(m[f"s{i}"] - 1) < 1e-9 for i in range(3))
    out = kmeans.attach_clusters(spark, df, k=2)
    names = {r.CustomerID[0]: r.ClusterName for r in out.collect()}
    assert names == {"H": "High-Value Active", "L": "Dormant Low-Value"}
    rows_k, _ = kmeans.sweep(feat, k_values=[2, 3, 4], n_init=3)
    inertia = [r[1] for r in rows_k]
    assert inertia[0] >= inertia[1] >= inertia[2]


def test_choose_k_window(spark):
    from retailspark.operators import kmeans
    m = spark.createDataFrame([(k, 0.0, s) for k, s in zip(range(2, 11),
                               [0.9, 0.5, 0.7, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05])],
                              "k int, inertia double, silhouette double")
    assert kmeans.choose_k(m).first()["k"] == 4


@pytest.mark.parametrize("t,x,T,want", [(180.0, 600.0, 700.0, 133.7967), (180.0, 700.0, 739.0, 148.8727),
                                        (365.25, 500.0, 700.0, 215.6364)])
def test_expected_purchases_of_heavy_buyers(spark, t, x, T, want):
    df = spark.createDataFrame([(x, T - 1.0, T)], "x double, tx double, T double")
    got = df.select(clv.expected_purchases(t, clv.BGNBD(*clv.FIXED_BG), F.col("x"), F.col("tx"), F.col("T"))).first()[0]
    assert abs(got - want) < 1e-4


def expected_by_integral(t, bg, x, tx, T, steps=300):
    """E[purchases] from its definition: given a dropout probability p, the
    purchases of an alive customer with rate lambda in t days are
    (1 - exp(-lambda p t)) / p on average; lambda ~ Gamma(r + x, alpha + T) is
    integrated in closed form and p ~ Beta(a, b + x) by quadrature."""
    import numpy as np
    from math import lgamma
    r, al, a, b = bg
    u, w = np.polynomial.legendre.leggauss(steps)
    p = (u + 1) / 2
    logbeta = lgamma(a) + lgamma(b + x) - lgamma(a + b + x)
    dens = np.exp((a - 1) * np.log(p) + (b + x - 1) * np.log1p(-p) - logbeta)
    mean = (1 - ((al + T) / (al + T + p * t)) ** (r + x)) / p
    alive = 1 / (1 + a / (b + x - 1) * ((al + T) / (al + tx)) ** (r + x))
    return float((w / 2 * dens * mean).sum() * alive)


@pytest.mark.parametrize("bg", [(0.67, 64.0, 2.5, 1.2), (0.3, 10.0, 3.0, 4.0), (1.5, 200.0, 1.5, 0.9)])
def test_expected_purchases_equal_their_integral(spark, bg):
    rows = [(1.0, 3.0, 40.0), (7.0, 90.0, 100.0), (40.0, 300.0, 310.0), (300.0, 500.0, 510.0)]
    df = spark.createDataFrame(rows, "x double, tx double, T double")
    for t in (30.0, 365.25):
        got = [r[0] for r in df.select(clv.expected_purchases(t, clv.BGNBD(*bg), F.col("x"), F.col("tx"), F.col("T"))).collect()]
        for g, row in zip(got, rows):
            assert abs(g - expected_by_integral(t, bg, *row)) < 1e-4 * max(1, g)


def test_series_length_follows_the_tolerance():
    from retailspark.functions.special import terms_needed
    assert terms_needed(1.03, -0.5, 0.7, 0.2) < 40 < terms_needed(1.03, -0.5, 0.7, 0.85) < 400
    with pytest.raises(ValueError):
        terms_needed(1.0, 1.0, 1.0, 1.0)


def test_negative_counts_stop_the_job(spark):
    df = spark.createDataFrame([(-0.5,)], "v double")
    with pytest.raises(Exception, match="negative expected purchases"):
        df.select(clv._checked(F.col("v"))).collect()
    assert spark.createDataFrame([(-1e-9,)], "v double").select(clv._checked(F.col("v"))).first()[0] == 0.0


def test_optimiser_reports_convergence():
    import numpy as np
    from retailspark.functions.optim import bfgs
    def fg(x):
        return float(((x - 3) ** 2).sum()), 2 * (x - 3)
    x, f, it, ok = bfgs(fg, np.array([0.0, 10.0]))
    assert ok and np.allclose(x, 3)
    assert bfgs(lambda x: (float(np.exp(-x[0])), -np.exp(-x)), np.array([0.0]), max_iter=2, ftol=0.0)[3] is False


def test_customer_ids_are_whole_numbers_or_null(spark):
    given = ["13085.0", " 42 ", "007", "1.3085E4", "NaN", "1e30", "13085.7", "13085.00004", "abc", "", None,
             "9007199254740993", "12345678901234567890123.0", "Infinity", "+5", "-3."]
    df = spark.createDataFrame([(x,) for x in given], "CustomerID string")
    got = [r[0] for r in clean.normalize_customer_id(df).collect()]
    assert got == ["13085", "42", "7", "13085", None, None, None, None, None, None, None,
                   "9007199254740993", "12345678901234567890123", None, "5", "-3"]


def test_csv_with_doubled_quotes(spark, tmp_path):
    from retailspark.sources import retail
    f = tmp_path / "raw.csv"
    f.write_text('Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n'
                 '489434,85048,"SET OF 3 ""LOVE"", RED",12,2009-12-01 07:45:00,6.95,13085.0,United Kingdom\n'
                 '489435,85049,"back\\slash",1,2009-12-01 07:45:00,1.5,,EIRE\n')
    rows = retail.load_raw(spark, str(f)).collect()
    assert rows[0].Description == 'SET OF 3 "LOVE", RED' and rows[0].Quantity == 12
    assert rows[1].Description == "back\\slash" and rows[1]["Customer ID"] is None
    out = str(tmp_path / "again")
    retail.write_csv(spark.createDataFrame(rows, RAW_SCHEMA), out)
    assert sorted(retail.load_raw(spark, out).collect()) == sorted(rows)
    (tmp_path / "lines.csv").write_text('Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n'
                                        '1,2,"a\nb",1,2009-12-01 07:45:00,1.5,3,EIRE\n')
    assert retail.load_raw(spark, str(tmp_path / "lines.csv"), multi_line=True).first().Description == "a\nb"


def test_stages_follow_their_input(spark, tmp_path):
    from retailspark.plans.stages import Stages
    spark.range(3).write.parquet(str(tmp_path / "in" / "t.parquet"))
    a = Stages.of(spark, str(tmp_path / "in"))
    assert Stages.of(spark, str(tmp_path / "in")) is a
    spark.range(9).write.mode("overwrite").parquet(str(tmp_path / "in" / "t.parquet"))
    assert Stages.of(spark, str(tmp_path / "in")) is not a
    own = Stages(spark, str(tmp_path / "in"), root=str(tmp_path / "out"))
    own.table("x", lambda: spark.range(4))
    assert spark.read.parquet(str(tmp_path / "out" / "x")).count() == 4


def test_probing_an_id_twice_answers_twice(spark):
    from retailspark.operators import serving
    known = spark.createDataFrame([("a",), ("a",), ("b",)], "customer_id string")
    probes = spark.createDataFrame([("a",), ("a",), ("a",), ("z",)], "customer_id string")
    got = sorted(tuple(r) for r in serving.customer_exists(known, probes).collect())
    assert got == [("a", True)] * 3 + [("z", False)]


def test_tree_attribution_adds_up_and_equals_brute_force(spark):
    """Against the definition: average over orders of the change in the
    path-dependent expectation when a feature becomes known."""
    import itertools
    import math
    import numpy as np
    from retailspark.operators import propensity as pr
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (240, len(pr.FEATURE_COLUMNS))).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(int)
    df = spark.createDataFrame([(str(i), *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "CustomerID string, " + ", ".join(f"{c} double" for c in pr.FEATURE_COLUMNS) + ", label int")
    fitted = pr.fit_gbt(df, n_estimators=6, num_leaves=6)
    rows = pr.tree_attribution_rows(fitted, df).collect()
    score = {r.CustomerID: r.score for r in pr.predict_proba(fitted, df).collect()}
    for r in rows:
        margin = math.log(score[r.CustomerID] / (1 - score[r.CustomerID]))
        assert abs(r.base + sum(r.attributions) - margin) < 1e-6
    leaves = pr.tree_leaves(fitted)
    used = sorted({j for leaf in leaves for j in leaf.features})

    def expected(known, row):
        total = 0.0
        for leaf in leaves:
            p = leaf.value
            for j, lo, hi, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                p *= float(lo < row[j] <= hi) if j in known else share
            total += p
        return total

    got = {r.CustomerID: r.attributions for r in rows}
    for i in (0, 17, 101):
        want = np.zeros(len(pr.FEATURE_COLUMNS))
        for j in used:
            rest = [k for k in used if k != j]
            for n in range(len(rest) + 1):
                for s in itertools.combinations(rest, n):
                    w = math.factorial(n) * math.factorial(len(used) - n - 1) / math.factorial(len(used))
                    want[j] += w * (expected({*s, j}, x[i]) - expected(set(s), x[i]))
        assert np.allclose(got[str(i)], want, atol=1e-9)
