"""Fixed lookup tables.

The values below must equal the reference's for identical results (segment
grid, actions, localized display labels, risk thresholds, discount tiers,
country codes).  They are small literal maps, applied as ``create_map``
column lookups — no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: RFM (Recency score, FM score) grid → segment ------------
#        FM=5              FM=4              FM=3                 FM=2                 FM=1
SEGMENT_GRID = {
    (5, 5): "Champions", (5, 4): "Champions", (5, 3): "Potential Loyalist",
    (5, 2): "Potential Loyalist", (5, 1): "New Customers",
    (4, 5): "Champions", (4, 4): "Loyal Customers", (4, 3): "Loyal Customers",
    (4, 2): "Potential Loyalist", (4, 1): "New Customers",
    (3, 5): "Loyal Customers", (3, 4): "Loyal Customers", (3, 3): "Need Attention",
    (3, 2): "Promising", (3, 1): "Promising",
    (2, 5): "At Risk", (2, 4): "At Risk", (2, 3): "Need Attention",
    (2, 2): "About to Sleep", (2, 1): "About to Sleep",
    (1, 5): "Can't Lose Them", (1, 4): "Can't Lose Them", (1, 3): "At Risk",
    (1, 2): "Hibernating", (1, 1): "Lost",
}

# ---- fixed values: segment → recommended action -----------------------------
SEGMENT_ACTIONS = {
    "Champions": "Reward loyalty; early access, referrals, VIP perks.",
    "Loyal Customers": "Upsell higher-value lines; ask for reviews.",
    "Potential Loyalist": "Membership / loyalty programme to deepen the habit.",
    "New Customers": "Strong onboarding; make the second purchase easy.",
    "Promising": "Nurture with targeted offers to build frequency.",
    "Need Attention": "Time-limited offers on recently browsed / bought lines.",
    "About to Sleep": "Reactivation nudges before they churn.",
    "At Risk": "Win-back: personalised offers, remind them of value.",
    "Can't Lose Them": "High-touch win-back; they were valuable, don't lose them.",
    "Hibernating": "Low-cost reactivation; otherwise deprioritise spend.",
    "Lost": "Minimal spend; only broad, cheap campaigns.",
}

# ---- fixed values: localized (Traditional Chinese) display labels -----------
SEGMENT_ZH = {
    "Champions": "核心客戶",
    "Loyal Customers": "忠誠客戶",
    "Potential Loyalist": "潛在忠誠客戶",
    "New Customers": "新進客戶",
    "Promising": "看好客戶",
    "Need Attention": "需關注客戶",
    "About to Sleep": "即將沉睡",
    "At Risk": "流失風險客戶",
    "Can't Lose Them": "不能流失的客戶",
    "Hibernating": "沉睡客戶",
    "Lost": "已流失客戶",
}
CLUSTER_ZH = {
    "High-Value Active": "高價值・活躍",
    "High-Value Lapsing": "高價值・流失中",
    "Recent Low-Value": "近期・低價值",
    "Dormant Low-Value": "沉睡・低價值",
}
RISK_ZH = {"low": "低", "medium": "中", "high": "高"}
ACTION_ZH = {
    "Reward loyalty; early access, referrals, VIP perks.": "獎勵忠誠:搶先體驗、推薦獎勵、VIP 禮遇。",
    "Upsell higher-value lines; ask for reviews.": "推升至高價值商品線,並邀請留下評價。",
    "Membership / loyalty programme to deepen the habit.": "以會員/忠誠方案深化購買習慣。",
    "Strong onboarding; make the second purchase easy.": "強化新手引導,讓第二次購買更容易。",
    "Nurture with targeted offers to build frequency.": "以精準優惠培養,逐步提升回購頻率。",
    "Time-limited offers on recently browsed / bought lines.": "對近期瀏覽/購買的商品提供限時優惠。",
    "Reactivation nudges before they churn.": "在流失前以喚醒訊息促使回訪。",
    "Win-back: personalised offers, remind them of value.": "挽回:個人化優惠,提醒他們的價值。",
    "High-touch win-back; they were valuable, don't lose them.": "高接觸挽回:他們曾極具價值,務必留住。",
    "Low-cost reactivation; otherwise deprioritise spend.": "低成本喚醒;否則降低投放優先度。",
    "Minimal spend; only broad, cheap campaigns.": "投入最小化,僅用廣泛、低成本的活動。",
}
UNKNOWN_ZH = "未知"
NO_VALUE = "—"

# ---- fixed values: churn-risk thresholds on P(alive), discount tiers -------
HIGH_RISK_BELOW = 0.4
MEDIUM_RISK_BELOW = 0.7
DISCOUNT_TIERS = (0.20, 0.15, 0.10)
WIN_BACK_SEGMENTS = ("At Risk", "Can't Lose Them")


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def lookup(d: dict, key: Column) -> Column:
    """``d[key]`` as a column (NULL when absent or key NULL)."""
    return F.element_at(literal_map(d), key) if d else F.lit(None)


def segment_of(r: Column, fm: Column) -> Column:
    grid = {r_ * 10 + fm_: name for (r_, fm_), name in SEGMENT_GRID.items()}
    return F.element_at(literal_map(grid), (r * 10 + fm).cast("int"))


def action_of(segment: Column) -> Column:
    return F.try_element_at(literal_map(SEGMENT_ACTIONS), segment)


def risk_band(prob_alive: Column) -> Column:
    """NULL P(alive) counts as 0 → high risk."""
    p = F.coalesce(prob_alive, F.lit(0.0))
    return (F.when(p < HIGH_RISK_BELOW, "high").when(p < MEDIUM_RISK_BELOW, "medium")
            .otherwise("low"))


def _localize(d: dict, c: Column, when_empty: Column | str) -> Column:
    """``d.get(c or "", c or when_empty)``: known → label, unknown → itself,
    NULL/empty → the fallback."""
    empty = c.isNull() | (c == "")
    fallback = when_empty if isinstance(when_empty, Column) else F.lit(when_empty)
    return F.when(empty, fallback).otherwise(
        F.coalesce(F.try_element_at(literal_map(d), c), c))


def segment_zh(c: Column) -> Column:
    return _localize(SEGMENT_ZH, c, UNKNOWN_ZH)


def cluster_zh(c: Column) -> Column:
    return _localize(CLUSTER_ZH, c, c)


def risk_zh(c: Column) -> Column:
    return _localize(RISK_ZH, c, NO_VALUE)


def action_zh(c: Column) -> Column:
    return _localize(ACTION_ZH, c, "")
