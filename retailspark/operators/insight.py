"""Grounded per-customer facts and the deterministic insight / answer text,
for EVERY customer in one projection (no per-customer queries).

Numbers and bands are computed here; the text only restates them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions.labels import action_zh, risk_band, risk_zh, segment_zh

# ---- fixed values: Traditional-Chinese text templates -----------------------
HEADLINE = "「{seg}」客群|流失風險{risk}|預估價值 {clv}"
OBS_ACTIVITY = "最近一次購買在 {rec} 天前,共 {freq} 筆訂單,累積消費 {mon}。"
OBS_ALIVE = "仍為活躍客戶的機率:{alive}。"
OBS_PROPENSITY = "模型預估 90 天回購傾向:{prop}。"
ACTION_OFFERS = "交叉銷售推薦:{offers}。"
ACTION_DEFAULT = "暫無特別建議,持續觀察即可。"
ANSWER_SEG = "客戶 {cid} 屬於「{seg}」客群,"
ANSWER_REC = "最近一次購買在 {rec} 天前,"
ANSWER_CLV = "預估終身價值 {clv},流失風險{risk}。"
ANSWER_PROP = "90 天回購傾向 {prop}。"
ANSWER_OFFERS = "推薦商品:{offers}。"
OFFER_SEP = "、"
MAX_OFFERS = 3
RISK_LEVELS = ("low", "medium", "high")


def money(c: Column) -> Column:
    """£#,##0"""
    return F.concat(F.lit("£"), F.format_number(c, 0))


def pct(c: Column) -> Column:
    """0% (whole percent)"""
    return F.concat(F.format_number(c * 100, 0), F.lit("%"))


def _fill(template: str, **parts: Column) -> Column:
    """Template with {name} slots → concat of literal pieces and columns."""
    import re
    pieces, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        pieces.append(parts[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces)


def top_offers(offers: DataFrame, key: str = "customer_id", limit: int = MAX_OFFERS) -> DataFrame:
    """key → array of the first ``limit`` offer names by rank (one groupBy;
    each group holds one customer's ≤ limit offers)."""
    return (offers.filter(F.col("rank") <= limit).groupBy(key)
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "consequents"))),
                             lambda s: s["consequents"]).alias("next_best_offers")))


def insight_context(customers: DataFrame, offers: DataFrame) -> DataFrame:
    prob = F.coalesce(F.col("prob_alive"), F.lit(0.0))
    c = customers.join(top_offers(offers), "customer_id", "left")
    return c.select(
        "customer_id",
        F.when(F.col("segment").isNull() | (F.col("segment") == ""), F.lit("Unknown"))
         .otherwise(F.col("segment")).alias("segment"),
        F.coalesce(F.col("recency"), F.lit(0)).cast("int").alias("recency_days"),
        F.coalesce(F.col("frequency"), F.lit(0)).cast("int").alias("frequency"),
        F.coalesce(F.col("monetary"), F.lit(0.0)).alias("monetary"),
        F.coalesce(F.col("predicted_clv"), F.lit(0.0)).alias("predicted_clv"),
        prob.alias("prob_alive"),
        F.col("propensity"),
        risk_band(F.col("prob_alive")).alias("risk_level"),
        F.coalesce(F.col("action"), F.lit("")).alias("recommended_action"),
        F.coalesce(F.col("next_best_offers"), F.array().cast("array<string>")).alias("next_best_offers"))


def insight_template(ctx: DataFrame) -> DataFrame:
    offers = F.slice(F.col("next_best_offers"), 1, MAX_OFFERS)
    headline = _fill(HEADLINE, seg=segment_zh(F.col("segment")), risk=risk_zh(F.col("risk_level")),
                     clv=money(F.col("predicted_clv")))
    obs = F.array_compact(F.array(
        _fill(OBS_ACTIVITY, rec=F.col("recency_days"), freq=F.col("frequency"),
              mon=money(F.col("monetary"))),
        _fill(OBS_ALIVE, alive=pct(F.col("prob_alive"))),
        F.when(F.col("propensity").isNotNull(),
               _fill(OBS_PROPENSITY, prop=pct(F.col("propensity"))))))
    act_zh = action_zh(F.col("recommended_action"))
    acts = F.array_compact(F.array(
        F.when(act_zh != "", act_zh),
        F.when(F.size(offers) > 0, _fill(ACTION_OFFERS, offers=F.array_join(offers, OFFER_SEP)))))
    acts = F.when(F.size(acts) > 0, acts).otherwise(F.array(F.lit(ACTION_DEFAULT)))
    return ctx.select("customer_id", "segment", "risk_level", headline.alias("headline"),
                      obs.alias("observations"), acts.alias("recommended_actions"))


def insight_violations(insights: DataFrame) -> DataFrame:
    """Rows breaking the output contract (expected: none)."""
    bad = ((F.length("headline") < 1) | (F.length("headline") > 240)
           | (F.size("observations") < 1) | (F.size("observations") > 6)
           | (F.size("recommended_actions") < 1) | (F.size("recommended_actions") > 6)
           | ~F.col("risk_level").isin(*RISK_LEVELS))
    return insights.agg(F.count(F.lit(1)).alias("insights"),
                        F.count(F.when(bad, 1)).alias("violations"))


def chat_facts(customers: DataFrame, offers: DataFrame) -> DataFrame:
    prob = F.coalesce(F.col("prob_alive"), F.lit(0.0))
    c = customers.join(top_offers(offers), "customer_id", "left")
    return c.select(
        "customer_id", segment_zh(F.col("segment")).alias("segment"),
        F.col("recency").alias("recency_days"), "frequency", "monetary", "predicted_clv",
        prob.alias("prob_alive"), risk_zh(risk_band(F.col("prob_alive"))).alias("risk_level"),
        "propensity", action_zh(F.col("action")).alias("recommended_action"),
        F.coalesce(F.col("next_best_offers"), F.array().cast("array<string>")).alias("next_best_offers"))


def answer_template(facts: DataFrame) -> DataFrame:
    text = F.concat(
        _fill(ANSWER_SEG, cid=F.col("customer_id"), seg=F.col("segment")),
        _fill(ANSWER_REC, rec=F.coalesce(F.col("recency_days").cast("string"), F.lit("None"))),
        _fill(ANSWER_CLV, clv=money(F.coalesce(F.col("predicted_clv"), F.lit(0.0))),
              risk=F.col("risk_level")),
        F.when(F.col("propensity").isNotNull(), _fill(ANSWER_PROP, prop=pct(F.col("propensity"))))
         .otherwise(F.lit("")),
        F.when(F.size("next_best_offers") > 0,
               _fill(ANSWER_OFFERS, offers=F.array_join("next_best_offers", OFFER_SEP)))
         .otherwise(F.lit("")))
    return facts.select("customer_id", text.alias("answer"))


def fetch_fan_in(customers: DataFrame, offers: DataFrame) -> DataFrame:
    """The four per-customer fact groups (rfm, clv, nbo, propensity) merged in
    one join instead of four lookups."""
    c = customers.join(top_offers(offers, limit=5), "customer_id", "left")
    return c.select(
        "customer_id",
        F.struct("recency", "frequency", "monetary", "rfm_score", "segment", "action").alias("rfm"),
        F.struct("predicted_clv", "prob_alive", "predicted_purchases", "historical_clv",
                 "clv_method").alias("clv"),
        F.coalesce(F.col("next_best_offers"), F.array().cast("array<string>")).alias("nbo"),
        F.col("propensity"))
