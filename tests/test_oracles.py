"""Registered queries vs their DuckDB oracles on the smallest data set."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from retailspark.sources.testdata import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["clean_transactions", "clean_audit", "compute_rfm", "score_rfm", "segment_summary_eda",
        "eda_monthly", "eda_order_stats", "sum_products", "customer_top_product", "clv_summary",
        "clv_predict_fixed", "association_rules", "recommend_basket", "training_table",
        "evaluate_roc_auc", "evaluate_pr_auc", "rules_flat", "nbo_for_customer",
        "conversation_history"]


def _rows(df):
    cols = sorted(df.columns)
    out = []
    for t in df[cols].itertuples(index=False):
        out.append(tuple(None if (isinstance(v, float) and math.isnan(v)) else
                         (tuple(v.tolist()) if hasattr(v, "tolist") and not isinstance(v, (int, float)) else v)
                         for v in t))
    return cols, sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("test data not present")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF).toPandas()
    odf = con.execute(E.oracle_sql()[key]).df()
    sc, sr = _rows(sdf)
    oc, orr = _rows(odf)
    assert sc == oc
    assert len(sr) == len(orr)
    assert repr(sr) == repr(orr) or all(
        all((a == b) or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9))
            for a, b in zip(x, y)) for x, y in zip(sr, orr))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
