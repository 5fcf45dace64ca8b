"""Baskets and itemsets on rows of their own."""

from itertools import combinations

from retailspark.operators import basket

BASKETS = [list(s) for s in ["abc", "abc", "abd", "ab", "bcd", "a", "cde", "abcde", "e", "bd", "abc"]]


def _counts(baskets, least):
    out = {}
    for b in baskets:
        for k in range(1, len(b) + 1):
            for c in combinations(sorted(b), k):
                out[c] = out.get(c, 0) + 1
    return {c: n for c, n in out.items() if n >= least}


def test_itemsets_are_whole(spark):
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(BASKETS)], "InvoiceNo string, items array<string>")
    for share, least in ((0.0, 0), (0.25, 3), (0.5, 6), (1.0, 11)):
        got = basket.frequent_itemsets(df, share).collect()
        assert {tuple(r["items"]): r["freq"] for r in got} == _counts(BASKETS, least)
        assert len(got) == len({tuple(r["items"]) for r in got})
        assert all(r["support"] == r["freq"] / len(BASKETS) for r in got)
    none = basket.frequent_itemsets(df.limit(0))
    assert none.count() == 0 and none.dtypes == [("items", "array<string>"), ("freq", "bigint"), ("support", "double")]


def test_equal_baskets_are_counted_as_one_row(spark, monkeypatch):
    seen = {}
    kept = basket.stored
    monkeypatch.setattr(basket, "stored", lambda df, name: seen.setdefault(name, kept(df, name)))
    df = spark.createDataFrame([(str(i), ["x", "y"]) for i in range(500)], "InvoiceNo string, items array<string>")
    assert {tuple(r["items"]): r["freq"] for r in basket.frequent_itemsets(df).collect()} == {("x",): 500, ("y",): 500, ("x", "y"): 500}
    assert seen["baskets"].count() == 1


def test_basket_matrix_keeps_frequent_codes(spark):
    rows = [(str(i), c) for i, b in enumerate(BASKETS) for c in b + b[:1]] + [(None, "a"), ("99", None)]
    got = basket.basket_matrix(spark.createDataFrame(rows, "InvoiceNo string, StockCode string"), 0.4).collect()
    n = {c: sum(c in b for b in BASKETS) for c in "abcde"}
    keep = {c for c in n if n[c] >= 0.4 * 12}  # the invoice without a code is a basket too
    want = {str(i): sorted(set(b) & keep) for i, b in enumerate(BASKETS)} | {None: ["a"]}
    assert {r["InvoiceNo"]: r["items"] for r in got} == {k: v for k, v in want.items() if v}
