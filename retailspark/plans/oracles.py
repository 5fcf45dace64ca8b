"""DuckDB oracle SQL for every registered query.

Each oracle is written independently of the Spark code, in plain SQL over
the driver's pre-registered views.  Shared CTEs (the adapter and the cleaning
rules) are spelled out once here and prefixed to each statement.
"""

from __future__ import annotations

RAW_CTE = """
raw_base AS (
  SELECT
    CASE WHEN l.l_returnflag = 'R' AND l.l_orderkey % 10 = 0 THEN 'C' ELSE '' END
      || CAST(l.l_orderkey AS VARCHAR) AS "Invoice",
    CASE WHEN l.l_partkey % 97 = 0 THEN 'POST'
         ELSE CASE WHEN length(CAST(l.l_partkey AS VARCHAR)) >= 5 THEN CAST(l.l_partkey AS VARCHAR)
                   ELSE lpad(CAST(l.l_partkey AS VARCHAR), 5, '0') END
              || CASE l.l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN '' ELSE 'BL' END
    END AS "StockCode",
    CASE WHEN l.l_partkey % 41 = 0 THEN NULL ELSE p.p_name END AS "Description",
    CASE WHEN l.l_linenumber = 7 THEN -CAST(l.l_quantity AS BIGINT)
         ELSE CAST(l.l_quantity AS BIGINT) END AS "Quantity",
    strftime(CAST(o.o_orderdate AS TIMESTAMP) + to_minutes(CAST((o.o_orderkey * 37) % 1440 AS BIGINT)),
             '%Y-%m-%d %H:%M:%S') AS "InvoiceDate",
    CASE WHEN l.l_partkey % 53 = 0 THEN 0.0 ELSE p.p_retailprice END AS "Price",
    CASE WHEN o.o_custkey % 11 = 0 THEN NULL ELSE CAST(o.o_custkey AS VARCHAR) || '.0' END AS "Customer ID",
    n.n_name AS "Country",
    l.l_orderkey AS _ok, l.l_linenumber AS _ln
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
raw AS (
  SELECT "Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"
  FROM raw_base
  UNION ALL
  SELECT "Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"
  FROM raw_base WHERE _ok % 50 = 0 AND _ln = 1
),
norm AS (
  SELECT "Invoice" AS InvoiceNo, "StockCode" AS StockCode, "Description" AS Description,
         "Quantity" AS Quantity, CAST("InvoiceDate" AS TIMESTAMP) AS InvoiceDate,
         "Price" AS UnitPrice,
         CAST(CAST(TRY_CAST("Customer ID" AS DOUBLE) AS BIGINT) AS VARCHAR) AS CustomerID,
         "Country" AS Country
  FROM raw
),
dedup AS (SELECT DISTINCT * FROM norm),
tagged AS (
  SELECT *,
    CASE WHEN coalesce(starts_with(InvoiceNo, 'C'), false) THEN 2
         WHEN NOT coalesce(regexp_full_match(StockCode, '[0-9]{5}[A-Za-z]{0,3}'), false) THEN 3
         WHEN NOT coalesce(Quantity > 0, false) THEN 4
         WHEN NOT coalesce(UnitPrice > 0, false) THEN 5
         WHEN CustomerID IS NULL THEN 6
         ELSE 0 END AS rule
  FROM dedup
),
tx AS (
  SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country,
         Quantity * UnitPrice AS TotalPrice
  FROM tagged WHERE rule = 0
)"""


def _materialized(cte_text: str) -> str:
    """Shared CTEs are referenced several times downstream; materialise each
    once instead of letting the engine inline and recompute it."""
    import re
    return re.sub(r"(?m)^(\s*)(\w+) AS \(", r"\1\2 AS MATERIALIZED (", cte_text)


def with_ctes(body: str, *extra: str) -> str:
    seen, ctes = set(), []
    for e in (RAW_CTE, *extra):
        e = e.strip()
        if e not in seen:  # the same CTE block listed twice would define names twice
            seen.add(e)
            ctes.append(_materialized(e))
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


ORACLES: dict[str, str] = {}


def oracle(name: str, *extra_ctes: str):
    def deco(body: str) -> str:
        if body.strip().upper().startswith("WITH"):
            body = f"SELECT * FROM ({body.strip()}) q"
        ORACLES[name] = with_ctes(body, *extra_ctes)
        return body
    return deco


oracle("clean_transactions")("""
SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country,
       TotalPrice FROM tx""")

oracle("clean_audit")("""
SELECT step_no, step, rows_removed,
       (SELECT count(*) FROM raw) - sum(rows_removed) OVER (ORDER BY step_no) AS rows_remaining
FROM (
  SELECT 0 AS step_no, 'raw rows' AS step, CAST(0 AS BIGINT) AS rows_removed
  UNION ALL SELECT 1, 'drop exact duplicates', (SELECT count(*) FROM raw) - (SELECT count(*) FROM dedup)
  UNION ALL SELECT 2, 'drop cancellations (invoice C*)', (SELECT count(*) FROM tagged WHERE rule = 2)
  UNION ALL SELECT 3, 'drop non-product stock codes', (SELECT count(*) FROM tagged WHERE rule = 3)
  UNION ALL SELECT 4, 'drop non-positive quantity', (SELECT count(*) FROM tagged WHERE rule = 4)
  UNION ALL SELECT 5, 'drop non-positive unit price', (SELECT count(*) FROM tagged WHERE rule = 5)
  UNION ALL SELECT 6, 'drop missing customer id', (SELECT count(*) FROM tagged WHERE rule = 6)
) s""")


RFM_CTE = """
rfm AS (
  SELECT CustomerID,
         CAST(floor((epoch_us((SELECT max(InvoiceDate) FROM tx) + INTERVAL 1 DAY)
                     - epoch_us(max(InvoiceDate))) / 86400000000.0) AS INTEGER) AS Recency,
         count(DISTINCT InvoiceNo) AS Frequency,
         SUM(CAST(floor(TotalPrice * 10000 + 0.5) AS BIGINT)) / 10000.0 AS Monetary
  FROM tx GROUP BY CustomerID
)"""


def _segment_case(r: str, fm: str) -> str:
    from retailspark.functions.labels import SEGMENT_GRID
    arms = " ".join(f"WHEN {r} = {a} AND {fm} = {b} THEN '{n.replace(chr(39), chr(39) * 2)}'"
                    for (a, b), n in SEGMENT_GRID.items())
    return f"CASE {arms} END"


def _action_case(seg: str) -> str:
    from retailspark.functions.labels import SEGMENT_ACTIONS
    arms = " ".join(f"WHEN {seg} = '{k.replace(chr(39), chr(39) * 2)}' "
                    f"THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in SEGMENT_ACTIONS.items())
    return f"CASE {arms} END"


def _bin(rank: str) -> str:
    return (f"CASE WHEN n <= 1 THEN 1 ELSE CAST(greatest(1, floor((({rank} - 1) * 5 + (n - 2)) "
            f"/ (n - 1))) AS INTEGER) END")


SCORED_CTE = f"""
ranked AS (
  SELECT *, count(*) OVER () AS n,
         row_number() OVER (ORDER BY Recency DESC, CustomerID) AS rr,
         row_number() OVER (ORDER BY Frequency, CustomerID) AS rf,
         row_number() OVER (ORDER BY Monetary, CustomerID) AS rm
  FROM rfm
),
scored1 AS (
  SELECT CustomerID, Recency, Frequency, Monetary,
         {_bin('rr')} AS R, {_bin('rf')} AS F, {_bin('rm')} AS M
  FROM ranked
),
scored2 AS (
  SELECT *, CAST(least(5, greatest(1, round_even((F + M) / 2.0, 0))) AS INTEGER) AS FM
  FROM scored1
),
scored3 AS (
  SELECT *, CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS RFM_Score,
         {_segment_case('R', 'FM')} AS Segment
  FROM scored2
),
scored AS (SELECT *, {_action_case('Segment')} AS Action FROM scored3)"""

oracle("snapshot_date")("SELECT max(InvoiceDate) + INTERVAL 1 DAY AS snapshot_date FROM tx")
oracle("compute_rfm", RFM_CTE)("SELECT * FROM rfm")
oracle("score_rfm", RFM_CTE, SCORED_CTE)("SELECT * FROM scored")
oracle("segment_summary_eda", RFM_CTE, SCORED_CTE)("""
SELECT Segment, count(*) AS customers, avg(Recency) AS avg_recency,
       avg(Frequency) AS avg_frequency,
       SUM(CAST(floor(Monetary * 10000 + 0.5) AS BIGINT)) / 10000.0 / count(*) AS avg_monetary,
       SUM(CAST(floor(Monetary * 10000 + 0.5) AS BIGINT)) / 10000.0 AS total_revenue,
       count(*) / sum(count(*)) OVER () AS customer_share,
       SUM(CAST(floor(Monetary * 10000 + 0.5) AS BIGINT))
         / sum(SUM(CAST(floor(Monetary * 10000 + 0.5) AS BIGINT))) OVER () AS revenue_share
FROM scored GROUP BY Segment""")
oracle("segment_actions", RFM_CTE, SCORED_CTE)("SELECT DISTINCT Segment, Action FROM scored")


def msum(expr: str) -> str:
    return f"(SUM(CAST(floor(({expr}) * 10000 + 0.5) AS BIGINT)) / 10000.0)"


def munits(expr: str) -> str:
    return f"SUM(CAST(floor(({expr}) * 10000 + 0.5) AS BIGINT))"


oracle("eda_overview")(f"""
SELECT count(*) AS n_line_items, count(DISTINCT CustomerID) AS n_customers,
       count(DISTINCT InvoiceNo) AS n_invoices, count(DISTINCT StockCode) AS n_products,
       count(DISTINCT Country) AS n_countries, min(InvoiceDate) AS date_min,
       max(InvoiceDate) AS date_max, {msum('TotalPrice')} AS total_revenue
FROM tx""")

oracle("eda_monthly")(f"""
SELECT date_trunc('month', InvoiceDate) AS month, {msum('TotalPrice')} AS revenue,
       count(DISTINCT InvoiceNo) AS orders, count(DISTINCT CustomerID) AS customers,
       {msum('TotalPrice')} / count(DISTINCT InvoiceNo) AS avg_order_value
FROM tx GROUP BY 1""")

_COUNTRY = f"""
SELECT Country, {msum('TotalPrice')} AS revenue, count(DISTINCT InvoiceNo) AS orders,
       count(DISTINCT CustomerID) AS customers,
       {munits('TotalPrice')} / sum({munits('TotalPrice')}) OVER () AS revenue_share
FROM tx GROUP BY Country"""
oracle("eda_country")(_COUNTRY)
oracle("eda_country_top10")(f"SELECT * FROM ({_COUNTRY}) c ORDER BY revenue DESC, Country LIMIT 10")


def _describe_sql(vals_sql: str, out: str) -> str:
    pct = [(0.25, "25%"), (0.5, "50%"), (0.75, "75%"), (0.9, "90%"), (0.99, "99%")]
    qs = ", ".join(f"quantile_cont(v, {p}) AS q{i}" for i, (p, _) in enumerate(pct))
    parts = [f"SELECT 0 AS stat_no, 'count' AS stat, CAST(c AS DOUBLE) AS {out} FROM s",
             f"SELECT 1, 'mean', mean FROM s", f"SELECT 2, 'std', round(sd, 6) FROM s",
             f"SELECT 3, 'min', mn FROM s"]
    parts += [f"SELECT {4 + i}, '{lab}', q{i} FROM s" for i, (_, lab) in enumerate(pct)]
    parts.append(f"SELECT 9, 'max', mx FROM s")
    return (f"SELECT * FROM (WITH vals AS ({vals_sql}), s AS (SELECT count(v) AS c, "
            f"{munits('v')} / 10000.0 / count(v) AS mean, stddev_samp(v) AS sd, min(v) AS mn, "
            f"max(v) AS mx, {qs} FROM vals) " + " UNION ALL ".join(parts) + ") d")


oracle("eda_order_stats")(_describe_sql(
    f"SELECT InvoiceNo, {msum('TotalPrice')} AS v FROM tx GROUP BY InvoiceNo", "order_value"))
oracle("eda_customer_dist")(_describe_sql(
    f"SELECT CustomerID, {msum('TotalPrice')} AS v FROM tx GROUP BY CustomerID", "customer_spend"))

# modal text: highest count, ties → smallest text
MODAL_CTE = """
desc_counts AS (
  SELECT StockCode, Description, count(*) AS c FROM tx
  WHERE Description IS NOT NULL GROUP BY StockCode, Description
),
modal_desc AS (
  SELECT StockCode, Description FROM (
    SELECT *, row_number() OVER (PARTITION BY StockCode ORDER BY c DESC, Description) AS rn
    FROM desc_counts) WHERE rn = 1
)"""

oracle("modal_description", MODAL_CTE)("""
SELECT p.StockCode, coalesce(m.Description, '') AS description
FROM (SELECT DISTINCT StockCode FROM tx) p LEFT JOIN modal_desc m USING (StockCode)""")

oracle("eda_top_products", MODAL_CTE)(f"""
SELECT t.StockCode, {msum('TotalPrice')} AS revenue, sum(Quantity) AS units,
       coalesce(any_value(m.Description), '') AS description
FROM tx t LEFT JOIN modal_desc m USING (StockCode)
GROUP BY t.StockCode ORDER BY revenue DESC, t.StockCode LIMIT 20""")

oracle("product_descriptions", MODAL_CTE)("SELECT StockCode, Description FROM modal_desc")

PRODUCTS_CTE = f"""
products AS (
  SELECT t.StockCode AS stock_code, any_value(m.Description) AS description,
         {msum('TotalPrice')} AS revenue, sum(Quantity) AS quantity,
         count(DISTINCT InvoiceNo) AS orders, count(DISTINCT CustomerID) AS customers
  FROM tx t LEFT JOIN modal_desc m USING (StockCode) GROUP BY t.StockCode
),
monthly AS (
  SELECT strftime(InvoiceDate, '%Y-%m') AS month, {msum('TotalPrice')} AS revenue,
         count(DISTINCT InvoiceNo) AS orders, count(DISTINCT CustomerID) AS customers
  FROM tx GROUP BY 1
),
country AS (
  SELECT Country AS country, {msum('TotalPrice')} AS revenue,
         count(DISTINCT InvoiceNo) AS orders, count(DISTINCT CustomerID) AS customers
  FROM tx GROUP BY 1
),
cust_prod AS (
  SELECT CustomerID, StockCode, {munits('TotalPrice')} AS u FROM tx
  WHERE CustomerID IS NOT NULL GROUP BY 1, 2
),
customer_top_product AS (
  SELECT CustomerID AS customer_id, StockCode AS stock_code, u / 10000.0 AS revenue FROM (
    SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY u DESC, StockCode) AS rn
    FROM cust_prod) WHERE rn = 1
)"""

oracle("sum_products", MODAL_CTE, PRODUCTS_CTE)("SELECT * FROM products")
oracle("sum_monthly", MODAL_CTE, PRODUCTS_CTE)("SELECT * FROM monthly")
oracle("sum_country", MODAL_CTE, PRODUCTS_CTE)("SELECT * FROM country")
oracle("customer_top_product", MODAL_CTE, PRODUCTS_CTE)("SELECT * FROM customer_top_product")


# ---------------------------------------------------------------- CLV
def floor_days_sql(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS INTEGER)"


def summary_cte(name: str, src: str, obs_expr: str) -> str:
    return f"""
{name}_daily AS (
  SELECT CustomerID, date_trunc('day', InvoiceDate) AS day, {munits('TotalPrice')} AS u
  FROM {src} WHERE date_trunc('day', InvoiceDate) <= date_trunc('day', {obs_expr}) GROUP BY 1, 2
),
{name}_per AS (
  SELECT CustomerID, min(day) AS f, max(day) AS l, count(*) AS nd, sum(u) AS ua, arg_min(u, day) AS uf
  FROM {name}_daily GROUP BY 1
),
{name} AS (
  SELECT CustomerID, CAST(nd - 1 AS DOUBLE) AS frequency,
         CAST(date_diff('day', f, l) AS DOUBLE) AS recency,
         CAST(date_diff('day', f, date_trunc('day', {obs_expr})) AS DOUBLE) AS T,
         CASE WHEN nd > 1 THEN (ua - uf) / 10000.0 / (nd - 1) ELSE 0.0 END AS monetary_value
  FROM {name}_per
)"""


CLV_SUMMARY_CTE = summary_cte("clv_summary", "tx", "(SELECT max(InvoiceDate) FROM tx)")
PURCHASE_CTE = """
purchase_tx AS (
  SELECT CAST(user_id AS VARCHAR) AS CustomerID, CAST(event_id AS VARCHAR) AS InvoiceNo,
         CAST(ts AS TIMESTAMP) AS InvoiceDate, value AS TotalPrice
  FROM events WHERE event_type = 'purchase'
)"""

oracle("clv_historical")(f"""
SELECT CustomerID, {msum('TotalPrice')} AS total_revenue, count(DISTINCT InvoiceNo) AS n_orders,
       min(InvoiceDate) AS first_purchase, max(InvoiceDate) AS last_purchase,
       {msum('TotalPrice')} / count(DISTINCT InvoiceNo) AS avg_order_value,
       {floor_days_sql('min(InvoiceDate)', 'max(InvoiceDate)')} AS tenure_days,
       {msum('TotalPrice')} / greatest({floor_days_sql('min(InvoiceDate)', 'max(InvoiceDate)')}, 1) * 365
         AS annual_value
FROM tx GROUP BY CustomerID""")
oracle("clv_summary", CLV_SUMMARY_CTE)("SELECT * FROM clv_summary")
oracle("clv_summary_events", PURCHASE_CTE, summary_cte(
    "ev_summary", "purchase_tx", "(SELECT max(InvoiceDate) FROM purchase_tx)"))("SELECT * FROM ev_summary")
oracle("clv_eligible", CLV_SUMMARY_CTE)(
    "SELECT * FROM clv_summary WHERE frequency > 0 AND monetary_value > 0")
oracle("clv_corr", CLV_SUMMARY_CTE)("""
SELECT round(corr(frequency, monetary_value), 9) AS correlation FROM clv_summary
WHERE frequency > 0 AND monetary_value > 0""")

CAL_HOLDOUT_CTE = """
bounds AS (SELECT max(InvoiceDate) AS obs, max(InvoiceDate) - INTERVAL 180 DAY AS cal FROM tx),
cal_tx AS (SELECT * FROM tx WHERE InvoiceDate <= (SELECT cal FROM bounds))""" + "," + summary_cte(
    "cal_summary", "cal_tx", "(SELECT cal FROM bounds)") + """,
hold AS (
  SELECT CustomerID, CAST(count(DISTINCT date_trunc('day', InvoiceDate)) AS DOUBLE) AS fh FROM tx
  WHERE InvoiceDate > (SELECT cal FROM bounds) AND InvoiceDate <= (SELECT obs FROM bounds)
  GROUP BY 1
),
cal_holdout AS (
  SELECT c.CustomerID, c.frequency AS frequency_cal, c.recency AS recency_cal, c.T AS T_cal,
         coalesce(h.fh, 0.0) AS frequency_holdout,
         CAST(date_diff('day', date_trunc('day', (SELECT cal FROM bounds)),
                        date_trunc('day', (SELECT obs FROM bounds))) AS DOUBLE) AS duration_holdout
  FROM cal_summary c LEFT JOIN hold h USING (CustomerID)
)"""
oracle("clv_cal_holdout", CAL_HOLDOUT_CTE)("SELECT * FROM cal_holdout")
oracle("clv_method_counts", CLV_SUMMARY_CTE)("""
SELECT CASE WHEN frequency > 0 AND monetary_value > 0 THEN 'bg_nbd_gamma_gamma'
            ELSE 'fallback_pop_mean' END AS clv_method, count(*) AS customers
FROM clv_summary GROUP BY 1""")


def _f(v: float) -> str:
    return repr(float(v))


def scaled_series_sql(first: str, a: str, b: str, c: str, z: str, n: int = 1500) -> str:
    """``first`` times the untransformed 2F1 series (its terms carry the factor,
    so neither overflows); past the hump near n = x z / (1 - z) they fall like z**n."""
    t = f"acc.t * ({a} + k) * ({b} + k) / (({c} + k) * (k + 1.0)) * ({z})"
    return (f"list_reduce(range({n - 1}), lambda acc, k: {{'t': {t}, 's': acc.s + {t}}}, "
            f"{{'t': {first}, 's': {first}}}).s")


def expected_sql(t: float, x="frequency", tx="recency", T="T", bg=None) -> str:
    r, al, a, b = (_f(v) for v in bg)
    tt = _f(t)
    a1 = f"(({a} + {b} + {x} - 1.0) / ({a} - 1.0))"
    z = f"({tt} / ({al} + {T} + {tt}))"
    first = f"pow(({al} + {T}) / ({al} + {T} + {tt}), {r} + {x})"
    a2 = scaled_series_sql(first, f"({r} + {x})", f"({b} + {x})", f"({a} + {b} + {x} - 1.0)", z)
    den = f"(1.0 + CASE WHEN {x} > 0 THEN {a} / ({b} + {x} - 1.0) * pow(({al} + {T}) / ({al} + {tx}), {r} + {x}) ELSE 0.0 END)"
    return f"({a1} * (1.0 - {a2}) / {den})"


def alive_sql(x="frequency", tx="recency", T="T", bg=None) -> str:
    r, al, a, b = (_f(v) for v in bg)
    ld = f"(({r} + {x}) * ln(({al} + {T}) / ({al} + {tx})) + ln({a} / ({b} + greatest({x}, 1.0) - 1.0)))"
    return f"(CASE WHEN {x} = 0 THEN 1.0 ELSE 1.0 / (1.0 + exp({ld})) END)"


def avg_value_sql(x="frequency", m="monetary_value", gg=None) -> str:
    p, q, v = (_f(z) for z in gg)
    return f"({p} * ({v} + {x} * {m}) / ({p} * {x} + {q} - 1.0))"


FBG = (0.67, 64.0, 0.5, 1.2)
FGG = (6.0, 3.0, 100.0)
H_DAYS = 3 * 365.25 / 12


def _clean_sql(e: str) -> str:
    return f"greatest(coalesce(CASE WHEN isnan({e}) THEN 0.0 ELSE {e} END, 0.0), 0.0)"


PRED_FIXED_CTE = f"""
pred0 AS (
  SELECT CustomerID, frequency, recency, T, monetary_value,
         frequency > 0 AND monetary_value > 0 AS elig,
         {expected_sql(H_DAYS, bg=FBG)} AS purch,
         {alive_sql(bg=FBG)} AS prob_alive,
         {avg_value_sql(gg=FGG)} AS avgv,
         {expected_sql(30.0, bg=FBG)} AS e1, {expected_sql(60.0, bg=FBG)} AS e2,
         {expected_sql(90.0, bg=FBG)} AS e3
  FROM clv_summary
),
pop AS (SELECT avg(avgv) AS pop_avg FROM pred0 WHERE elig),
clv_pred_fixed AS (
  SELECT CustomerID,
         round({_clean_sql('purch')}, 6) AS predicted_purchases,
         round(prob_alive, 6) AS prob_alive,
         round(CASE WHEN elig THEN avgv ELSE (SELECT pop_avg FROM pop) END, 6) AS predicted_avg_value,
         CASE WHEN elig THEN 'bg_nbd_gamma_gamma' ELSE 'fallback_pop_mean' END AS clv_method,
         round({_clean_sql("CASE WHEN elig THEN avgv * (e1 - 0.0) / 1.01 + avgv * (e2 - e1) / (1.01 * 1.01) + avgv * (e3 - e2) / (1.01 * 1.01 * 1.01) ELSE purch * (SELECT pop_avg FROM pop) END")}, 6) AS predicted_clv
  FROM pred0
)"""

oracle("clv_expected_fixed", CLV_SUMMARY_CTE)(
    f"SELECT CustomerID, round({expected_sql(H_DAYS, bg=FBG)}, 6) AS predicted_purchases FROM clv_summary")
HEAVY_CTE = """
heavy_tx AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS CustomerID, CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(o_orderdate AS TIMESTAMP) AS InvoiceDate, o_totalprice AS TotalPrice
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
oracle("clv_expected_heavy", HEAVY_CTE, summary_cte("heavy", "heavy_tx", "(SELECT max(InvoiceDate) FROM heavy_tx)"))(
    f"""SELECT CustomerID, round(frequency, 6) AS frequency,
       round({expected_sql(180.0, bg=FBG)}, 6) AS purchases_180,
       round({expected_sql(365.25, bg=FBG)}, 6) AS purchases_365 FROM heavy""")
oracle("clv_alive_fixed", CLV_SUMMARY_CTE)(
    f"SELECT CustomerID, round({alive_sql(bg=FBG)}, 6) AS prob_alive FROM clv_summary")
oracle("clv_avg_value_fixed", CLV_SUMMARY_CTE)(
    f"SELECT CustomerID, round({avg_value_sql(gg=FGG)}, 6) AS predicted_avg_value FROM clv_summary")
oracle("clv_predict_fixed", CLV_SUMMARY_CTE, PRED_FIXED_CTE)("SELECT * FROM clv_pred_fixed")
oracle("clv_validate_fixed", CAL_HOLDOUT_CTE)(f"""
SELECT count(*) AS n_customers, 180 AS holdout_days,
       round(round(avg(abs(p - y)), 9), 6) AS mae, round(round(sqrt(avg((p - y) * (p - y))), 9), 6) AS rmse,
       round(round(corr(p, y), 9), 6) AS correlation, round(sum(y), 6) AS actual_total_purchases,
       round(round(sum(p), 6), 6) AS predicted_total_purchases
FROM (SELECT {expected_sql(180.0, 'frequency_cal', 'recency_cal', 'T_cal', bg=FBG)} AS p,
             frequency_holdout AS y FROM cal_holdout) v""")


HIST_CTE = f"""
hist AS (
  SELECT CustomerID, {msum('TotalPrice')} AS historical_clv, count(DISTINCT InvoiceNo) AS n_orders,
         {msum('TotalPrice')} / count(DISTINCT InvoiceNo) AS avg_order_value,
         {floor_days_sql('min(InvoiceDate)', 'max(InvoiceDate)')} AS tenure_days
  FROM tx GROUP BY CustomerID
),
customer_clv_fixed AS (
  SELECT s.CustomerID, round(s.frequency, 6) AS frequency, round(s.recency, 6) AS recency,
         round(s.T, 6) AS T, round(s.monetary_value, 6) AS monetary_value,
         p.predicted_purchases, p.prob_alive, p.predicted_avg_value, p.clv_method, p.predicted_clv,
         round(h.historical_clv, 6) AS historical_clv, h.n_orders,
         round(h.avg_order_value, 6) AS avg_order_value, h.tenure_days, g.Segment
  FROM clv_summary s
  LEFT JOIN clv_pred_fixed p USING (CustomerID)
  LEFT JOIN hist h USING (CustomerID)
  LEFT JOIN scored g USING (CustomerID)
)"""
_CLVF = (RFM_CTE, SCORED_CTE, CLV_SUMMARY_CTE, PRED_FIXED_CTE, HIST_CTE)

oracle("customer_clv_fixed", *_CLVF)("SELECT * FROM customer_clv_fixed")
oracle("clv_by_segment_fixed", *_CLVF)("""
SELECT Segment, count(*) AS customers, round(avg(predicted_clv), 4) AS avg_predicted_clv,
       round(sum(predicted_clv), 4) AS total_predicted_clv, round(avg(prob_alive), 4) AS avg_prob_alive
FROM customer_clv_fixed GROUP BY Segment""")
oracle("clv_top10_fixed", *_CLVF)("""
SELECT CustomerID, Segment, frequency, monetary_value, predicted_purchases, prob_alive, predicted_clv,
       historical_clv
FROM customer_clv_fixed ORDER BY predicted_clv DESC, CustomerID LIMIT 10""")
oracle("clv_histogram_fixed", *_CLVF)("""
WITH e AS (SELECT predicted_clv AS v FROM customer_clv_fixed
           WHERE clv_method = 'bg_nbd_gamma_gamma' AND predicted_clv > 0),
     p AS (SELECT quantile_cont(v, 0.99) AS p99 FROM e)
SELECT CAST(least(floor(v / ((SELECT p99 FROM p) / 60.0)), 59) AS INTEGER) AS bin,
       round(CAST(least(floor(v / ((SELECT p99 FROM p) / 60.0)), 59) AS INTEGER) * ((SELECT p99 FROM p) / 60.0), 4) AS bin_start,
       count(*) AS customers
FROM e WHERE v <= (SELECT p99 FROM p) GROUP BY 1, 2""")
oracle("clv_segment_median_fixed", *_CLVF)("""
SELECT Segment, round(median(predicted_clv), 4) AS median_clv FROM customer_clv_fixed GROUP BY Segment""")

# ---------------------------------------------------------------- K-means
KM_CTE = """
logged AS (SELECT CustomerID, Segment, R, ln(1 + Recency) AS lr, ln(1 + Frequency) AS lf,
                  ln(1 + Monetary) AS lm FROM scored),
mom AS (SELECT avg(lr) AS mr, stddev_pop(lr) AS sr, avg(lf) AS mf, stddev_pop(lf) AS sf,
               avg(lm) AS mm, stddev_pop(lm) AS sm FROM logged),
zs AS (SELECT CustomerID, Segment, R, (lr - mr) / sr AS zr, (lf - mf) / sf AS zf, (lm - mm) / sm AS zm
       FROM logged, mom)"""
oracle("km_features", RFM_CTE, SCORED_CTE, KM_CTE)("""
SELECT CustomerID, round(zr, 9) AS z_Recency, round(zf, 9) AS z_Frequency, round(zm, 9) AS z_Monetary
FROM zs""")
oracle("km_silhouette_by_segment", RFM_CTE, SCORED_CTE, KM_CTE)("""
WITH sizes AS (SELECT Segment, count(*) AS n FROM zs GROUP BY Segment),
d AS (
  SELECT a.CustomerID, a.Segment AS own, b.Segment AS other,
         avg((a.zr - b.zr) ^ 2 + (a.zf - b.zf) ^ 2 + (a.zm - b.zm) ^ 2) AS md
  FROM zs a, zs b GROUP BY 1, 2, 3
),
pt AS (
  SELECT d.CustomerID,
         max(CASE WHEN other = own THEN md * s.n / (s.n - 1) END) AS a,
         min(CASE WHEN other <> own THEN md END) AS b, max(s.n) AS n
  FROM d JOIN sizes s ON s.Segment = d.own GROUP BY d.CustomerID
)
SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 9)
       AS silhouette FROM pt""")
_PROF_R = f"""
SELECT R AS Cluster, count(*) AS customers, avg(Recency) AS avg_recency, avg(Frequency) AS avg_frequency,
       {munits('Monetary')} / 10000.0 / count(*) AS avg_monetary,
       {munits('Monetary')} / 10000.0 AS total_revenue,
       count(*) / sum(count(*)) OVER () AS customer_share,
       {munits('Monetary')} / sum({munits('Monetary')}) OVER () AS revenue_share
FROM scored GROUP BY R"""
oracle("km_profile_by_r", RFM_CTE, SCORED_CTE)(_PROF_R)
oracle("km_names_by_r", RFM_CTE, SCORED_CTE)(f"""
WITH p AS ({_PROF_R}),
m AS (SELECT median(avg_recency) AS mr, median(avg_frequency) AS mf, median(avg_monetary) AS mm FROM p)
SELECT Cluster, CASE
  WHEN avg_monetary >= mm AND avg_recency <= mr THEN 'High-Value Active'
  WHEN avg_monetary >= mm THEN 'High-Value Lapsing'
  WHEN avg_recency <= mr AND avg_frequency >= mf THEN 'Engaged Mid-Value'
  WHEN avg_recency <= mr THEN 'Recent Low-Value'
  ELSE 'Dormant Low-Value' END AS ClusterName
FROM p, m""")


# ---------------------------------------------------------------- basket
def basket_ctes(attr: str, p: str, min_item=0.01, min_sup=0.01, metric="lift", thr=1.0) -> str:
    """Itemsets by enumerating every non-empty subset of each basket's own
    (frequent) items — exact, and cheap because baskets are small — and
    rules by enumerating each itemset's own antecedent/consequent splits."""
    sub = "list_filter({l}, lambda x, i: ((mask >> (i - 1)) & 1) = {bit})"
    return f"""
{p}bt AS (SELECT DISTINCT CAST(l.l_orderkey AS VARCHAR) AS InvoiceNo, pa.{attr} AS StockCode
          FROM lineitem l JOIN part pa ON l.l_partkey = pa.p_partkey),
{p}nall AS (SELECT count(DISTINCT InvoiceNo) AS n FROM {p}bt),
{p}fp AS (SELECT StockCode FROM {p}bt GROUP BY 1
          HAVING count(DISTINCT InvoiceNo) >= {min_item} * (SELECT n FROM {p}nall)),
{p}bm AS (SELECT InvoiceNo, list_sort(list(StockCode)) AS items
          FROM {p}bt JOIN {p}fp USING (StockCode) GROUP BY 1),
{p}nb AS (SELECT count(*) AS n FROM {p}bm),
{p}subs AS (SELECT {sub.format(l='items', bit=1)} AS s
            FROM {p}bm, LATERAL (SELECT range AS mask FROM range(1, CAST(1 AS BIGINT) << len(items))) r),
{p}itemsets AS (SELECT s AS items, count(*) AS freq, count(*) / (SELECT n FROM {p}nb) AS support
                FROM {p}subs GROUP BY s HAVING count(*) >= ceil({min_sup} * (SELECT n FROM {p}nb))),
{p}rsplit AS (SELECT items, support, {sub.format(l='items', bit=1)} AS a, {sub.format(l='items', bit=0)} AS c
              FROM {p}itemsets,
                   LATERAL (SELECT range AS mask FROM range(1, (CAST(1 AS BIGINT) << len(items)) - 1)) r
              WHERE len(items) >= 2),
{p}rules AS (
  SELECT * FROM (
    SELECT r.a AS antecedents, r.c AS consequents, r.support,
           r.support / ia.support AS confidence, r.support / ia.support / ic.support AS lift
    FROM {p}rsplit r JOIN {p}itemsets ia ON ia.items = r.a JOIN {p}itemsets ic ON ic.items = r.c) q
  WHERE {metric} >= {thr}
)"""


T_CTE = basket_ctes("p_type", "t_")
B_CTE = basket_ctes("p_brand", "b_")

oracle("frequent_products", B_CTE)("SELECT StockCode FROM b_fp")
oracle("frequent_products_tx")(f"""
SELECT StockCode FROM tx GROUP BY 1
HAVING count(DISTINCT InvoiceNo) >= 0.01 * (SELECT count(DISTINCT InvoiceNo) FROM tx)""")
oracle("basket_matrix", T_CTE)("""
SELECT InvoiceNo, list_sort(list(DISTINCT StockCode)) AS items FROM t_bt JOIN t_fp USING (StockCode)
GROUP BY InvoiceNo""")
oracle("frequent_itemsets", T_CTE)("SELECT items, freq, support FROM t_itemsets")
oracle("frequent_itemsets_brand", B_CTE)("SELECT items, freq, support FROM b_itemsets")
oracle("association_rules", T_CTE)("SELECT * FROM t_rules")
oracle("association_rules_confidence", basket_ctes("p_type", "c_", metric="confidence", thr=0.5))(
    "SELECT * FROM c_rules")
oracle("mine_rules", B_CTE)("SELECT * FROM b_rules")


def item_desc_cte(attr: str, p: str) -> str:
    return f"""
{p}desc AS (
  SELECT StockCode, Description FROM (
    SELECT {attr} AS StockCode, p_name AS Description,
           row_number() OVER (PARTITION BY {attr} ORDER BY count(*) DESC, p_name) AS rn
    FROM part GROUP BY {attr}, p_name) WHERE rn = 1
)"""


def labelled_sql(p: str) -> str:
    lab = (lambda side: f"""(SELECT string_agg(coalesce(d.Description, u.code), ' + ' ORDER BY u.pos)
             FROM (SELECT unnest({side}) AS code, generate_subscripts({side}, 1) AS pos) u
             LEFT JOIN {p}desc d ON d.StockCode = u.code)""")
    return f"""SELECT {lab('r.antecedents')} AS antecedents, {lab('r.consequents')} AS consequents,
       r.antecedents AS antecedents_codes, r.consequents AS consequents_codes,
       r.support, r.confidence, r.lift FROM {p}rules r"""


oracle("rules_labelled", T_CTE, item_desc_cte("p_type", "t_"))(labelled_sql("t_"))
RULES_SERVING_CTE = f"""
rules_lab AS ({labelled_sql("b_")}),
rules AS (
  SELECT antecedents, consequents, array_to_string(antecedents_codes, ',') AS antecedents_codes,
         array_to_string(consequents_codes, ',') AS consequents_codes, support, confidence, lift
  FROM rules_lab
)"""
_RS = (B_CTE, item_desc_cte("p_brand", "b_"), RULES_SERVING_CTE)
oracle("rules_flat", *_RS)("SELECT * FROM rules")
oracle("rules_scatter", *_RS)("SELECT support, confidence, lift FROM rules")


def recommend_sql(p: str, baskets: str) -> str:
    return f"""
WITH fired AS (
  SELECT b.basket_id, b.items, r.* FROM ({baskets}) b JOIN {p}rules r
  ON list_has_all(b.items, r.antecedents)
),
cand AS (
  SELECT basket_id, unnest(list_filter(consequents, lambda x: NOT list_contains(items, x))) AS StockCode,
         lift, confidence, support, array_to_string(antecedents, ', ') AS from_rule,
         array_to_string(consequents, ',') AS ck
  FROM fired
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY basket_id, StockCode
                                               ORDER BY lift DESC, from_rule, ck) AS rn FROM cand)
  WHERE rn = 1
)
SELECT basket_id, rank, StockCode, lift, confidence, support, from_rule FROM (
  SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY lift DESC, StockCode) AS rank FROM best)
WHERE rank <= 5"""


oracle("recommend_basket", T_CTE)(recommend_sql(
    "t_", "SELECT InvoiceNo AS basket_id, list_sort(list(DISTINCT StockCode)) AS items FROM t_bt GROUP BY 1"))
_RP = recommend_sql("b_", "SELECT DISTINCT StockCode AS basket_id, [StockCode] AS items FROM b_bt")
oracle("recommend_product", B_CTE)(
    f"SELECT basket_id AS product, rank, StockCode, lift, confidence, support, from_rule FROM ({_RP}) x")
oracle("nbo_descriptions", B_CTE, item_desc_cte("p_brand", "b_"))(f"""
SELECT x.StockCode, basket_id AS product, rank, lift, confidence, support, from_rule,
       coalesce(d.Description, '') AS Description
FROM ({_RP}) x LEFT JOIN b_desc d ON d.StockCode = x.StockCode""")


# ---------------------------------------------------------------- propensity
TRAIN_CTE = f"""
pcut AS (SELECT max(InvoiceDate) - INTERVAL 90 DAY AS c FROM tx),
pagg AS (
  SELECT CustomerID,
         count(DISTINCT CASE WHEN InvoiceDate <= (SELECT c FROM pcut) THEN InvoiceNo END) AS frequency,
         sum(CASE WHEN InvoiceDate <= (SELECT c FROM pcut) THEN CAST(floor(TotalPrice * 10000 + 0.5) AS BIGINT) END) AS u,
         min(CASE WHEN InvoiceDate <= (SELECT c FROM pcut) THEN InvoiceDate END) AS f,
         max(CASE WHEN InvoiceDate <= (SELECT c FROM pcut) THEN InvoiceDate END) AS l,
         count(CASE WHEN InvoiceDate <= (SELECT c FROM pcut) THEN 1 END) AS lines,
         count(DISTINCT CASE WHEN InvoiceDate <= (SELECT c FROM pcut) THEN StockCode END) AS distinct_products,
         max(CASE WHEN InvoiceDate > (SELECT c FROM pcut)
                   AND InvoiceDate <= (SELECT c FROM pcut) + INTERVAL 90 DAY THEN 1 ELSE 0 END) AS label
  FROM tx GROUP BY CustomerID
),
training AS (
  SELECT CustomerID,
         {floor_days_sql('l', '(SELECT c FROM pcut)')} AS recency_days, frequency,
         u / 10000.0 AS monetary,
         {floor_days_sql('f', '(SELECT c FROM pcut)')} AS tenure_days,
         u / 10000.0 / frequency AS avg_order_value,
         CASE WHEN frequency > 1 THEN CAST(floor((epoch_us(l) - epoch_us(f)) / 86400000000.0) AS BIGINT) / (frequency - 1)
              ELSE CAST({floor_days_sql('f', '(SELECT c FROM pcut)')} AS DOUBLE) END AS avg_interpurchase_days,
         distinct_products, lines / frequency AS avg_basket_size,
         {floor_days_sql('l', '(SELECT c FROM pcut)')} / greatest({floor_days_sql('f', '(SELECT c FROM pcut)')}, 1)
           AS recency_over_tenure,
         CAST(label AS INTEGER) AS label
  FROM pagg WHERE lines > 0
),
scores AS (
  SELECT CustomerID, label,
         floor(frequency / (frequency + 1.0 + recency_days / 30.0) * 100 + 0.5) / 100.0 AS score
  FROM training
)"""

oracle("default_cutoff")("SELECT max(InvoiceDate) - INTERVAL 90 DAY AS cutoff FROM tx")
oracle("training_table", TRAIN_CTE)("SELECT * FROM training")
oracle("propensity_base_rate", TRAIN_CTE)(
    "SELECT count(*) AS n_customers, avg(label) AS positive_rate FROM training")
oracle("split_xy", TRAIN_CTE)("""
SELECT CustomerID, [CAST(recency_days AS DOUBLE), CAST(frequency AS DOUBLE), monetary,
       CAST(tenure_days AS DOUBLE), avg_order_value, avg_interpurchase_days,
       CAST(distinct_products AS DOUBLE), avg_basket_size, recency_over_tenure] AS features, label
FROM training""")
oracle("train_test", TRAIN_CTE)("""
SELECT CustomerID, label,
       row_number() OVER (PARTITION BY label ORDER BY md5(CustomerID || '|42'), CustomerID)
         <= ceil(0.25 * count(*) OVER (PARTITION BY label)) AS is_test
FROM training""")
_TEST_ROWS = """
SELECT count(*) AS rows, 0 AS off FROM (
  SELECT row_number() OVER (PARTITION BY label ORDER BY md5(CustomerID || '|42'), CustomerID)
           <= ceil(0.25 * count(*) OVER (PARTITION BY label)) AS is_test FROM training) WHERE is_test"""
oracle("shap_additivity", TRAIN_CTE)(_TEST_ROWS)
oracle("logistic_rows", TRAIN_CTE)(_TEST_ROWS)
oracle("evaluate_roc_auc", TRAIN_CTE)("""
WITH r AS (SELECT score, label, row_number() OVER (ORDER BY score, CustomerID) AS rn FROM scores),
g AS (SELECT score, (min(rn) + max(rn)) / 2.0 AS ar, sum(label) AS pos, count(*) AS cnt FROM r GROUP BY score)
SELECT (sum(ar * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(cnt) - sum(pos))) AS roc_auc FROM g""")
oracle("evaluate_pr_auc", TRAIN_CTE)("""
WITH g AS (SELECT score, count(*) AS c, sum(label) AS p FROM scores GROUP BY score),
cum AS (SELECT score, p, sum(c) OVER (ORDER BY score DESC) AS n_at, sum(p) OVER (ORDER BY score DESC) AS tp_at FROM g)
SELECT round(sum(p / (SELECT CAST(sum(label) AS DOUBLE) FROM scores) * (tp_at / n_at)), 9) AS pr_auc
FROM cum WHERE p > 0""")
oracle("evaluate_brier", TRAIN_CTE)("""
SELECT round(avg((score - label) * (score - label)), 9) AS brier, round(avg(label), 9) AS base_rate,
       count(*) AS n_test FROM scores""")
oracle("calibration_table", TRAIN_CTE)("""
WITH e AS (SELECT """ + ", ".join(f"quantile_cont(score, {i / 10}) AS e{i}" for i in range(1, 10)) + """ FROM scores)
SELECT bin, round(avg(score), 9) AS mean_predicted, round(avg(label), 9) AS fraction_positive FROM (
  SELECT score, label, """ + " + ".join(f"CAST(score > e{i} AS INTEGER)" for i in range(1, 10)) + """ AS bin
  FROM scores, e) GROUP BY bin""")


# ---------------------------------------------------------------- serving
CUSTOMERS_FIXED_CTE = """
rprof AS (
  SELECT R, avg(Recency) AS ar, avg(Frequency) AS af,
         SUM(CAST(floor(Monetary * 10000 + 0.5) AS BIGINT)) / 10000.0 / count(*) AS am
  FROM scored GROUP BY R
),
rmed AS (SELECT median(ar) AS mr, median(af) AS mf, median(am) AS mm FROM rprof),
rnames AS (
  SELECT R, CASE WHEN am >= mm AND ar <= mr THEN 'High-Value Active'
                 WHEN am >= mm THEN 'High-Value Lapsing'
                 WHEN ar <= mr AND af >= mf THEN 'Engaged Mid-Value'
                 WHEN ar <= mr THEN 'Recent Low-Value' ELSE 'Dormant Low-Value' END AS cluster_name
  FROM rprof, rmed
),
customers AS (
  SELECT s.CustomerID AS customer_id, s.Recency AS recency, s.Frequency AS frequency,
         s.Monetary AS monetary, s.RFM_Score AS rfm_score, s.Segment AS segment, s.Action AS action,
         n.cluster_name, round(c.predicted_clv, 6) AS predicted_clv, round(c.prob_alive, 6) AS prob_alive,
         round(c.predicted_purchases, 6) AS predicted_purchases,
         round(c.historical_clv, 6) AS historical_clv, c.clv_method, p.score AS propensity
  FROM scored s JOIN rnames n USING (R)
  LEFT JOIN customer_clv_fixed c USING (CustomerID)
  LEFT JOIN scores p USING (CustomerID)
)"""
_CF = (RFM_CTE, SCORED_CTE, CLV_SUMMARY_CTE, PRED_FIXED_CTE, HIST_CTE, TRAIN_CTE, CUSTOMERS_FIXED_CTE)
_PR = (MODAL_CTE, PRODUCTS_CTE)

oracle("customers_fixed", *_CF)("SELECT * FROM customers")
oracle("get_customer", *_CF)("SELECT * FROM customers WHERE customer_id = '100'")
_SEGSUM = f"""
SELECT segment, count(*) AS customers, {msum('monetary')} AS total_revenue,
       {msum('monetary')} / count(*) AS avg_monetary, round(avg(predicted_clv), 6) AS avg_predicted_clv,
       round(avg(prob_alive), 6) AS avg_prob_alive
FROM customers GROUP BY segment"""
oracle("segment_summary", *_CF)(_SEGSUM)
oracle("top_clv", *_CF)("""
SELECT customer_id, segment, predicted_clv, prob_alive, propensity FROM customers
ORDER BY predicted_clv DESC, customer_id LIMIT 20""")
_RSV = _RS
oracle("nbo_for_product", *_RSV)("""
SELECT * FROM (SELECT antecedents_codes,
  row_number() OVER (PARTITION BY antecedents_codes ORDER BY lift DESC, consequents_codes) AS rank,
  antecedents, consequents, consequents_codes, support, confidence, lift FROM rules) WHERE rank <= 5""")
CTB_CTE = f"""
ctb0 AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS customer_id, p.p_brand AS stock_code,
         {munits('l.l_extendedprice')} AS u
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2
),
ctb AS (SELECT customer_id, stock_code, u / 10000.0 AS revenue FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY u DESC, stock_code) AS rn FROM ctb0)
  WHERE rn = 1)"""
oracle("nbo_for_customer", *_RSV, CTB_CTE)("""
SELECT * FROM (SELECT c.customer_id,
  row_number() OVER (PARTITION BY c.customer_id ORDER BY r.lift DESC, r.consequents_codes) AS rank,
  r.antecedents, r.consequents, r.consequents_codes, r.support, r.confidence, r.lift
  FROM ctb c JOIN rules r ON r.antecedents_codes = c.stock_code) WHERE rank <= 5""")
oracle("win_back_candidates", *_CF)("""
SELECT customer_id, segment, recency, frequency, monetary, predicted_clv, prob_alive FROM customers
WHERE segment IN ('At Risk', 'Can''t Lose Them')""")
oracle("customer_exists", *_CF)("""
SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
       CAST(c_custkey AS VARCHAR) IN (SELECT customer_id FROM customers) AS "exists"
FROM customer""")
oracle("count_customers", *_CF)("SELECT count(*) AS customers FROM customers")
oracle("list_customers", *_CF)("""
SELECT customer_id, segment, recency, frequency, monetary, predicted_clv, propensity FROM customers
ORDER BY monetary DESC, customer_id LIMIT 100""")
oracle("top_products", *_PR)("SELECT * FROM products ORDER BY revenue DESC, stock_code LIMIT 20")
oracle("get_product", *_PR)("SELECT * FROM products WHERE stock_code = '00001'")
oracle("monthly_series", *_PR)("SELECT * FROM monthly")
oracle("country_top", *_PR)("SELECT * FROM country ORDER BY revenue DESC, country LIMIT 15")
oracle("product_overview", *_PR)(
    f"SELECT count(*) AS products, {msum('revenue')} AS revenue, sum(quantity) AS quantity FROM products")
oracle("sql_segment_rollup", *_CF)(f"""
SELECT segment, count(*) AS customers, round({msum('monetary')}, 0) AS total_revenue,
       round(avg(predicted_clv), 2) AS avg_predicted_clv, round(avg(prob_alive), 3) AS avg_prob_alive
FROM customers GROUP BY segment""")
oracle("sql_pareto_deciles", *_CF)(f"""
WITH ranked AS (SELECT predicted_clv, NTILE(10) OVER (ORDER BY predicted_clv DESC, customer_id) AS decile
                FROM customers)
SELECT decile, count(*) AS customers, round({msum('predicted_clv')}, 0) AS clv_in_decile,
       round(100.0 * {munits('predicted_clv')} / sum({munits('predicted_clv')}) OVER (), 1) AS pct_of_total_clv
FROM ranked GROUP BY decile""")
oracle("sql_valuable_at_risk", *_CF)("""
SELECT customer_id, segment, predicted_clv, prob_alive, propensity FROM customers
WHERE predicted_clv > (SELECT avg(predicted_clv) FROM customers) AND prob_alive < 0.5
ORDER BY predicted_clv DESC, customer_id LIMIT 50""")
oracle("sql_single_item_rules", *_RSV)("""
SELECT antecedents, consequents, support, confidence, lift FROM rules
WHERE antecedents_codes NOT LIKE '%,%' ORDER BY lift DESC, antecedents, consequents LIMIT 25""")
oracle("sql_targeting", *_CF)("""
SELECT customer_id, segment, propensity, predicted_clv FROM customers WHERE propensity > 0.7
ORDER BY predicted_clv DESC, customer_id LIMIT 100""")
oracle("kpi_weighted", *_CF)(f"""
WITH s AS ({_SEGSUM})
SELECT sum(customers) AS total_customers, {msum('coalesce(total_revenue, 0.0)')} AS total_revenue,
       round(sum(coalesce(avg_predicted_clv, 0.0) * customers) / greatest(sum(customers), 1), 6) AS avg_clv,
       round(sum(coalesce(avg_prob_alive, 0.0) * customers) / greatest(sum(customers), 1), 6) AS avg_alive
FROM s""")
oracle("segment_revenue_share", *_CF)(f"""
WITH s AS ({_SEGSUM})
SELECT segment, total_revenue,
       CAST(floor(total_revenue * 10000 + 0.5) AS BIGINT)
         / sum(CAST(floor(total_revenue * 10000 + 0.5) AS BIGINT)) OVER () AS revenue_share
FROM s""")
oracle("peak_month", *_PR)("""
SELECT count(*) AS months, max(revenue) AS peak_revenue, arg_min(month, (-revenue, month)) AS peak_month
FROM monthly""")
oracle("monthly_long", *_PR)("""
SELECT month, 'orders' AS metric, orders AS value FROM monthly
UNION ALL SELECT month, 'customers', customers FROM monthly""")
_ISO = {"United Kingdom": "GBR", "EIRE": "IRL", "Netherlands": "NLD", "Germany": "DEU", "France": "FRA",
        "Australia": "AUS", "Spain": "ESP", "Switzerland": "CHE", "Sweden": "SWE", "Denmark": "DNK",
        "Belgium": "BEL", "Portugal": "PRT", "Japan": "JPN", "Norway": "NOR", "Italy": "ITA", "Finland": "FIN",
        "Cyprus": "CYP", "Austria": "AUT", "Greece": "GRC", "Singapore": "SGP", "Unspecified": None,
        "European Community": None, "USA": "USA", "Canada": "CAN", "Brazil": "BRA"}
oracle("country_map", *_PR)(f"""
SELECT c.* EXCLUDE (country), m.name AS country, m.iso AS iso3 FROM country c
JOIN nation ON n_name = c.country
JOIN (VALUES {', '.join(f"({i}, '{n}', {repr(x) if x else 'NULL'})" for i, (n, x) in enumerate(_ISO.items()))}) m(k, name, iso)
  ON m.k = n_nationkey WHERE m.iso IS NOT NULL""")
oracle("product_label", *_PR)("""
SELECT stock_code, revenue, stock_code || ' ' || substring(coalesce(description, ''), 1, 22) AS label
FROM products ORDER BY revenue DESC, stock_code LIMIT 15""")


# ---------------------------------------------------------------- insight / campaign
def _zh_case(col: str, d: dict, empty: str, unknown_self: bool = True) -> str:
    arms = " ".join(f"WHEN {col} = '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in d.items())
    return f"(CASE WHEN {col} IS NULL OR {col} = '' THEN {empty} {arms} ELSE {col} END)"


def _labels():
    from retailspark.functions import labels as L
    return L


def seg_zh_sql(c):
    return _zh_case(c, _labels().SEGMENT_ZH, "'未知'")


def risk_zh_sql(c):
    return _zh_case(c, _labels().RISK_ZH, "'—'")


def action_zh_sql(c):
    return _zh_case(c, _labels().ACTION_ZH, "''")


def cluster_zh_sql(c):
    return _zh_case(c, _labels().CLUSTER_ZH, c)


def risk_sql(p):
    return (f"(CASE WHEN coalesce({p}, 0.0) < 0.4 THEN 'high' WHEN coalesce({p}, 0.0) < 0.7 "
            f"THEN 'medium' ELSE 'low' END)")


def money_txt(x):
    return f"('£' || format('{{:,.0f}}', {x}))"


def pct_txt(x):
    return f"(format('{{:,.0f}}', ({x}) * 100) || '%')"


OFFERS_CTE = f"""
offers AS (
  SELECT * FROM (SELECT c.customer_id,
    row_number() OVER (PARTITION BY c.customer_id ORDER BY r.lift DESC, r.consequents_codes) AS rank,
    r.consequents FROM ctb c JOIN rules r ON r.antecedents_codes = c.stock_code) WHERE rank <= 5
),
top3 AS (SELECT customer_id, list(consequents ORDER BY rank) AS nbo FROM offers WHERE rank <= 3 GROUP BY 1),
ictx AS (
  SELECT c.customer_id, CASE WHEN segment IS NULL OR segment = '' THEN 'Unknown' ELSE segment END AS segment,
         CAST(coalesce(recency, 0) AS INTEGER) AS recency_days, CAST(coalesce(frequency, 0) AS INTEGER) AS frequency,
         coalesce(monetary, 0.0) AS monetary, coalesce(predicted_clv, 0.0) AS predicted_clv,
         coalesce(prob_alive, 0.0) AS prob_alive, propensity, {risk_sql('prob_alive')} AS risk_level,
         coalesce(action, '') AS recommended_action,
         coalesce(t.nbo, CAST([] AS VARCHAR[])) AS next_best_offers
  FROM customers c LEFT JOIN top3 t USING (customer_id)
)"""
_IN = _CF + _RSV + (CTB_CTE, OFFERS_CTE)

oracle("risk_band", *_CF)(f"SELECT customer_id, prob_alive, {risk_sql('prob_alive')} AS risk_level FROM customers")
oracle("labels_zh", *_CF)(f"""
SELECT customer_id, {seg_zh_sql('segment')} AS segment_zh, {cluster_zh_sql('cluster_name')} AS cluster_zh,
       {risk_zh_sql(risk_sql('prob_alive'))} AS risk_zh, {action_zh_sql('action')} AS action_zh FROM customers""")
oracle("insight_context", *_IN)("SELECT * FROM ictx")
_TEMPLATE = f"""
SELECT customer_id, segment, risk_level,
  '「' || {seg_zh_sql('segment')} || '」客群|流失風險' || {risk_zh_sql('risk_level')} || '|預估價值 '
    || {money_txt('predicted_clv')} AS headline,
  list_filter(['最近一次購買在 ' || recency_days || ' 天前,共 ' || frequency || ' 筆訂單,累積消費 '
                 || {money_txt('monetary')} || '。',
               '仍為活躍客戶的機率:' || {pct_txt('prob_alive')} || '。',
               CASE WHEN propensity IS NOT NULL THEN '模型預估 90 天回購傾向:' || {pct_txt('propensity')} || '。' END],
              lambda x: x IS NOT NULL) AS observations,
  CASE WHEN len(list_filter([CASE WHEN {action_zh_sql('recommended_action')} <> '' THEN {action_zh_sql('recommended_action')} END,
                             CASE WHEN len(next_best_offers) > 0 THEN '交叉銷售推薦:' || array_to_string(next_best_offers[1:3], '、') || '。' END],
                            lambda x: x IS NOT NULL)) > 0
       THEN list_filter([CASE WHEN {action_zh_sql('recommended_action')} <> '' THEN {action_zh_sql('recommended_action')} END,
                         CASE WHEN len(next_best_offers) > 0 THEN '交叉銷售推薦:' || array_to_string(next_best_offers[1:3], '、') || '。' END],
                        lambda x: x IS NOT NULL)
       ELSE ['暫無特別建議,持續觀察即可。'] END AS recommended_actions
FROM ictx"""
oracle("insight_template", *_IN)(_TEMPLATE)
oracle("insight_constraints", *_IN)(f"""
SELECT count(*) AS insights,
       count(CASE WHEN length(headline) < 1 OR length(headline) > 240 OR len(observations) < 1
                    OR len(observations) > 6 OR len(recommended_actions) < 1 OR len(recommended_actions) > 6
                    OR risk_level NOT IN ('low', 'medium', 'high') THEN 1 END) AS violations
FROM ({_TEMPLATE}) t""")
_FACTS = f"""
SELECT c.customer_id, {seg_zh_sql('segment')} AS segment, recency AS recency_days, frequency, monetary,
       predicted_clv, coalesce(prob_alive, 0.0) AS prob_alive, {risk_zh_sql(risk_sql('prob_alive'))} AS risk_level,
       propensity, {action_zh_sql('action')} AS recommended_action,
       coalesce(t.nbo, CAST([] AS VARCHAR[])) AS next_best_offers
FROM customers c LEFT JOIN top3 t USING (customer_id)"""
oracle("chat_facts", *_IN)(_FACTS)
oracle("answer_template", *_IN)(f"""
SELECT customer_id,
  '客戶 ' || customer_id || ' 屬於「' || segment || '」客群,' || '最近一次購買在 '
  || coalesce(CAST(recency_days AS VARCHAR), 'None') || ' 天前,' || '預估終身價值 '
  || {money_txt('coalesce(predicted_clv, 0.0)')} || ',流失風險' || risk_level || '。'
  || CASE WHEN propensity IS NOT NULL THEN '90 天回購傾向 ' || {pct_txt('propensity')} || '。' ELSE '' END
  || CASE WHEN len(next_best_offers) > 0 THEN '推薦商品:' || array_to_string(next_best_offers, '、') || '。' ELSE '' END
  AS answer
FROM ({_FACTS}) f""")
WINBACK_CTE = """
wb AS (SELECT customer_id, segment, predicted_clv, recency, prob_alive FROM customers
       WHERE segment IN ('At Risk', 'Can''t Lose Them')),
tiers AS (
  SELECT *, [0.2, 0.15, 0.1][CAST(floor((row_number() OVER (ORDER BY predicted_clv DESC, customer_id) - 1) * 3
                                / (SELECT count(*) FROM wb)) AS INTEGER) + 1] AS discount
  FROM wb
),
cands AS (
  SELECT t.customer_id, t.segment, t.predicted_clv, t.discount, o.consequents AS offer
  FROM tiers t LEFT JOIN offers o ON o.customer_id = t.customer_id AND o.rank = 1
),
revised AS (
  SELECT c.customer_id, c.segment, c.predicted_clv,
         CASE WHEN w.prob_alive < 0.5 THEN 0.05 ELSE c.discount END AS discount, c.offer
  FROM cands c JOIN wb w USING (customer_id) WHERE NOT w.recency > 1500
),
csum AS (
  SELECT count(*) AS count, CASE WHEN count(*) > 0 THEN round(sum(predicted_clv) / count(*), 2) ELSE 0.0 END AS avg_predicted_clv,
         CASE WHEN count(*) > 0 THEN round(sum(discount) / count(*), 4) ELSE 0.0 END AS avg_discount,
         (SELECT map_from_entries(list((segment, n) ORDER BY segment)) FROM (SELECT segment, count(*) AS n FROM revised GROUP BY 1)) AS by_segment
  FROM revised
)"""
_CP = _IN + (WINBACK_CTE,)
oracle("discount_tiers", *_CP)("SELECT customer_id, segment, predicted_clv, recency, prob_alive, discount FROM tiers")
oracle("match_offers", *_CP)("SELECT * FROM cands")
oracle("campaign_revision", *_CP)("SELECT * FROM revised")
oracle("campaign_summary", *_CP)("SELECT * FROM csum")
oracle("campaign_brief", *_CP)(f"""
SELECT *, '喚醒 ' || count || ' 位沉睡的高價值客戶' AS headline,
       '這群客戶平均終身價值 ' || {money_txt('avg_predicted_clv')} || ',平均折扣 ' || {pct_txt('avg_discount')}
         || ',值得專屬的挽回活動。' AS message,
       ['依個人終身價值分層的折扣', '搭配客戶最常購買商品的推薦', '限時喚醒沉睡客戶'] AS selling_points
FROM csum""")
oracle("fetch_fan_in", *_IN)("""
SELECT c.customer_id,
       {'recency': recency, 'frequency': frequency, 'monetary': monetary, 'rfm_score': rfm_score, 'segment': segment, 'action': action} AS rfm,
       {'predicted_clv': predicted_clv, 'prob_alive': prob_alive, 'predicted_purchases': predicted_purchases,
        'historical_clv': historical_clv, 'clv_method': clv_method} AS clv,
       coalesce(t.nbo, CAST([] AS VARCHAR[])) AS nbo, propensity
FROM customers c LEFT JOIN (SELECT customer_id, list(consequents ORDER BY rank) AS nbo FROM offers GROUP BY 1) t USING (customer_id)""")


def _brief_json(count: str, clv: str, disc: str) -> str:
    points = '["依個人終身價值分層的折扣","搭配客戶最常購買商品的推薦","限時喚醒沉睡客戶"]'
    return (f"""('{{"headline":"喚醒 ' || {count} || ' 位沉睡的高價值客戶","message":"這群客戶平均終身價值 ' || {money_txt(clv)}"""
            f""" || ',平均折扣 ' || {pct_txt(disc)} || ',值得專屬的挽回活動。","selling_points":{points}}}')""")


oracle("campaign_build", *_CP)(f"""
SELECT 'win-back' AS thread_id, {_brief_json('n', 'a', 'd')} AS brief, 'pending' AS status, n AS candidate_count,
       TIMESTAMP '1970-01-01 00:00:00' AS created_at, c.customer_id, c.segment, c.predicted_clv, c.discount, c.offer
FROM (SELECT count(*) AS n, coalesce(round(sum(predicted_clv) / count(*), 2), 0.0) AS a,
             coalesce(round(sum(discount) / count(*), 4), 0.0) AS d FROM cands) s LEFT JOIN cands c ON true""")
oracle("campaign_build_revised", *_CP)(f"""
SELECT 'win-back' AS thread_id, {_brief_json('n', 'a', 'd')} AS brief, 'pending' AS status, n AS candidate_count,
       TIMESTAMP '1970-01-01 00:00:00' AS created_at
FROM (SELECT count(*) AS n, coalesce(round(sum(predicted_clv) / count(*), 2), 0.0) AS a,
             coalesce(round(sum(discount) / count(*), 4), 0.0) AS d FROM revised) s""")
DRAFTS_CTE = f"""
drafts AS (
  SELECT CAST(customer_id AS BIGINT) % 14 AS approval_id, 't' || CAST(floor((CAST(customer_id AS BIGINT) % 14) / 2) AS BIGINT) AS thread_id,
         TIMESTAMP '1995-01-01' + to_hours(CAST(CAST(customer_id AS BIGINT) % 14 AS INTEGER)) AS created_at, *
  FROM cands
),
log AS (
  SELECT o_custkey % 14 AS approval_id,
         CASE o_orderkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'revised' END AS action,
         'r' || (o_orderkey % 7) AS reviewer, 'order ' || o_orderkey AS review_note,
         CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS decided_at, o_custkey
  FROM orders WHERE o_custkey % 14 IN (SELECT approval_id FROM drafts)
),
ends AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY approval_id ORDER BY decided_at, action, reviewer, review_note) AS i
                 FROM log WHERE action <> 'revised') WHERE i = 1
),
revs AS (
  SELECT l.* FROM log l LEFT JOIN ends e USING (approval_id)
  WHERE l.action = 'revised' AND (e.decided_at IS NULL OR l.decided_at <= e.decided_at)
),
decided AS (
  SELECT d.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM revs r WHERE r.approval_id = d.approval_id
                           AND CAST(r.o_custkey + 1 AS VARCHAR) = d.customer_id) THEN 0.05 ELSE d.discount END AS discount)
  FROM drafts d WHERE NOT EXISTS (SELECT 1 FROM revs r WHERE r.approval_id = d.approval_id AND CAST(r.o_custkey AS VARCHAR) = d.customer_id)
),
approvals AS (
  SELECT g.approval_id, g.thread_id,
         CASE WHEN n.note IS NOT NULL THEN {_brief_json('coalesce(k.n, 0)', 'coalesce(k.a, 0.0)', 'coalesce(k.d, 0.0)')}
              ELSE {_brief_json('g.n', 'g.a', 'g.d')} END AS brief,
         CASE WHEN n.note IS NOT NULL THEN coalesce(k.n, 0) ELSE g.n END AS candidate_count,
         coalesce(e.action, 'pending') AS status, e.reviewer, coalesce(e.review_note, n.note) AS review_note,
         e.decided_at, g.created_at,
         CASE WHEN n.note IS NOT NULL THEN coalesce(k.n, 0) ELSE g.n END AS shown
  FROM (SELECT approval_id, min(thread_id) AS thread_id, min(created_at) AS created_at, count(*) AS n,
               round(sum(predicted_clv) / count(*), 2) AS a, round(sum(discount) / count(*), 4) AS d FROM drafts GROUP BY 1) g
  LEFT JOIN (SELECT approval_id, count(*) AS n, round(sum(predicted_clv) / count(*), 2) AS a,
                    round(sum(discount) / count(*), 4) AS d FROM decided GROUP BY 1) k USING (approval_id)
  LEFT JOIN ends e USING (approval_id)
  LEFT JOIN (SELECT approval_id, arg_max(review_note, (decided_at, review_note)) AS note FROM revs GROUP BY 1) n USING (approval_id)
)"""
_DR = _CP + (DRAFTS_CTE,)
oracle("campaign_decisions", *_DR)("SELECT * EXCLUDE (shown) FROM approvals")
oracle("campaign_decided_candidates", *_DR)("SELECT approval_id, customer_id, discount, offer FROM decided")
_LIST = """SELECT approval_id, thread_id, status, created_at, '喚醒 ' || shown || ' 位沉睡的高價值客戶' AS headline, candidate_count
FROM approvals {0} ORDER BY created_at DESC, thread_id, approval_id LIMIT 50"""
oracle("campaign_list", *_DR)(_LIST.format(""))
oracle("campaign_list_approved", *_DR)(_LIST.format("WHERE status = 'approved'"))
oracle("campaign_latest", *_DR)("""
SELECT thread_id, approval_id, status, candidate_count FROM (
  SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, approval_id DESC) AS i FROM approvals) WHERE i = 1""")
oracle("status_check", *_DR)("""
SELECT 'lost' AS value, count(*) AS rows FROM approvals WHERE reviewer = 'r3' HAVING count(*) > 0""")
MSG_CTE = """
messages AS (SELECT CAST(conv_id AS VARCHAR) AS thread_id, turn,
                    CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS role, text AS content
             FROM conversations)"""
oracle("conversation_history", MSG_CTE)("""
SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY turn, CASE role WHEN 'human' THEN 'human' ELSE 'ai' END, content) AS position,
       turn, CASE role WHEN 'human' THEN 'human' ELSE 'ai' END AS role, content FROM messages""")
oracle("message_role_check", MSG_CTE)("""
SELECT role AS value, count(*) AS rows FROM messages WHERE role IS NULL OR role NOT IN ('human', 'ai', 'tool')
GROUP BY role""")
oracle("thread_upsert", MSG_CTE)("""
SELECT t.thread_id, coalesce(n.c, CASE WHEN CAST(t.thread_id AS BIGINT) % 2 = 0 AND o.thread_id IS NOT NULL THEN 'c' || t.thread_id END) AS customer_id
FROM (SELECT DISTINCT thread_id FROM messages) t
LEFT JOIN (SELECT DISTINCT thread_id FROM messages WHERE turn < 1) o USING (thread_id)
LEFT JOIN (SELECT thread_id, 'n' || thread_id || '.' || min(turn) AS c FROM messages
           WHERE turn >= 1 AND turn % 4 <> 1 GROUP BY 1) n USING (thread_id)""")
oracle("conversation_append", MSG_CTE)("SELECT * FROM messages")
oracle("thread_cascade_delete", MSG_CTE)("""
SELECT thread_id, 'message' AS kind, turn, role FROM messages
WHERE thread_id IN (SELECT thread_id FROM messages WHERE role = 'ai')
UNION ALL SELECT thread_id, 'approval', max(turn), 'pending' FROM messages
GROUP BY thread_id HAVING count(CASE WHEN role = 'ai' THEN 1 END) > 0""")


# ---------------------------------------------------------------- sources / cleaning steps
_RAWCOLS = '"Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"'
oracle("src_raw_csv")(f"SELECT {_RAWCOLS} FROM raw")
oracle("src_clean_parquet")("SELECT * FROM tx")
oracle("clean_rename")("""
SELECT "Invoice" AS InvoiceNo, "StockCode" AS StockCode, "Description" AS Description, "Quantity" AS Quantity,
       "InvoiceDate" AS InvoiceDate, "Price" AS UnitPrice, "Customer ID" AS CustomerID, "Country" AS Country
FROM raw""")
oracle("clean_dates")("""
SELECT "Invoice" AS InvoiceNo, "StockCode" AS StockCode, "Description" AS Description, "Quantity" AS Quantity,
       CAST("InvoiceDate" AS TIMESTAMP) AS InvoiceDate, "Price" AS UnitPrice, "Customer ID" AS CustomerID,
       "Country" AS Country
FROM raw""")
oracle("clean_custid")("SELECT * FROM norm")
oracle("clean_dedup")("SELECT * FROM dedup")
oracle("clean_total")("SELECT *, Quantity * UnitPrice AS TotalPrice FROM dedup")
oracle("is_cancel")("""
SELECT coalesce(starts_with(InvoiceNo, 'C'), false) AS is_cancel, count(*) AS rows FROM dedup GROUP BY 1""")
oracle("is_product")("""
SELECT StockCode, coalesce(regexp_full_match(StockCode, '[0-9]{5}[A-Za-z]{0,3}'), false) AS is_product
FROM (SELECT DISTINCT StockCode FROM dedup) s""")
oracle("clean_filters")("""
SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country FROM tx""")
oracle("sink_rules", T_CTE, item_desc_cte("p_type", "t_"))(labelled_sql("t_"))
oracle("load_all", *_CF, *_RS, *_PR)("""
SELECT 'customers' AS "table", count(*) AS rows FROM customers
UNION ALL SELECT 'rules', count(*) FROM rules
UNION ALL SELECT 'products', count(*) FROM products
UNION ALL SELECT 'monthly', count(*) FROM monthly
UNION ALL SELECT 'country', count(*) FROM country
UNION ALL SELECT 'customer_top_product', count(*) FROM customer_top_product""")
_SUMMARIES = """
SELECT 'products' AS "table", stock_code AS key, description AS text, revenue, CAST(quantity AS BIGINT) AS quantity, orders, customers FROM products
UNION ALL SELECT 'monthly', month, '', revenue, 0, orders, customers FROM monthly
UNION ALL SELECT 'country', country, '', revenue, 0, orders, customers FROM country
UNION ALL SELECT 'customer_top_product', customer_id, stock_code, revenue, 0, 0, 0 FROM customer_top_product"""
oracle("tbl_passthrough", *_PR)(_SUMMARIES)
oracle("sink_summaries", *_PR)(_SUMMARIES)
oracle("sink_segments_fitted", RFM_CTE, SCORED_CTE)("SELECT count(*) AS rows, 0 AS off FROM scored")
oracle("sink_clv_fitted", *_CLVF)("SELECT count(*) AS rows, 0 AS off FROM customer_clv_fixed")
oracle("sink_scores_fitted", TRAIN_CTE)("SELECT count(*) AS rows, 0 AS off FROM training")
oracle("limit_bounds", *_CF, *_RS, *_PR)("""
SELECT b.endpoint, b.low, b.high, least(b.high, n.rows) AS rows, 2 AS refused
FROM (VALUES ('list_customers', 1, 1000), ('top_clv', 1, 200), ('top_products', 1, 500), ('country_top', 1, 100), ('next_best_offers', 1, 20)) b(endpoint, low, high)
JOIN (SELECT 'list_customers' AS endpoint, count(*) AS rows FROM customers UNION ALL SELECT 'top_clv', count(*) FROM customers
      UNION ALL SELECT 'top_products', count(*) FROM products UNION ALL SELECT 'country_top', count(*) FROM country
      UNION ALL SELECT 'next_best_offers', count(*) FROM rules) n USING (endpoint)""")
oracle("sink_clean")("SELECT * FROM tx")
oracle("sink_segments", RFM_CTE, SCORED_CTE)("SELECT * FROM scored")
oracle("sink_clv", *_CLVF)("SELECT * FROM customer_clv_fixed")
oracle("sink_scores", TRAIN_CTE)("SELECT * FROM scores")
oracle("json_draft", *_CP)(f"""
SELECT '喚醒 ' || count || ' 位沉睡的高價值客戶' AS headline,
       '這群客戶平均終身價值 ' || {money_txt('avg_predicted_clv')} || ',平均折扣 ' || {pct_txt('avg_discount')}
         || ',值得專屬的挽回活動。' AS message,
       ['依個人終身價值分層的折扣', '搭配客戶最常購買商品的推薦', '限時喚醒沉睡客戶'] AS selling_points, count
FROM csum""")
oracle("sink_campaign_csv", *_CP)("SELECT * FROM revised")
oracle("json_draft_candidates", *_CP)("SELECT * FROM revised")
