"""Market basket: frequent products, frequent itemsets, association rules
with multi-item consequents, and next-best-offer recommendations.

* item pruning keeps codes present in ≥ min_item_support of ALL baskets;
  itemset support is then relative to the baskets that kept ≥ 1 item.
* itemsets: pattern growth over projected baskets, one step a length, equal
  baskets merged (Spark ML's FP-Growth keeps a tree of baskets in each task).
* rules: every non-empty proper subset of every itemset (bitmask over
  ``sequence(1, 2^k - 2)``) — Spark's own ``associationRules`` only emits
  single-item consequents.  Supports of antecedent and consequent come from
  two equi-joins back to the itemset table on a canonical (sorted) key.  The
  enumeration is proportional to the itemset table itself (every subset of a
  frequent itemset is frequent), so no length cap is needed.
* recommendations are batched over all baskets / all products as a
  relational division: rules exploded by antecedent item ⋈ basket items,
  a rule fires when all ``size(antecedent)`` items matched.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailspark.session import stored

DEFAULT_MIN_ITEM_SUPPORT = 0.01
DEFAULT_MIN_SUPPORT = 0.01
DEFAULT_MIN_LIFT = 1.0
KEY_SEP = "\u0001"


def frequent_products(tx: DataFrame, min_item_support: float = DEFAULT_MIN_ITEM_SUPPORT) -> DataFrame:
    n_baskets = tx.select(F.count_distinct("InvoiceNo")).scalar()
    by_product = tx.groupBy("StockCode").agg(F.count_distinct("InvoiceNo").alias("baskets"))
    return by_product.filter(F.col("baskets") >= F.lit(min_item_support) * n_baskets).select("StockCode")


def basket_matrix(tx: DataFrame, min_item_support: float = DEFAULT_MIN_ITEM_SUPPORT) -> DataFrame:
    """InvoiceNo, items (sorted distinct frequent codes); invoices with none drop out.

    The baskets are put together once, written, and counted and pruned from
    there.  The frequent codes are at most the mean basket size over
    ``min_item_support``, whatever the number of baskets."""
    whole = stored(tx.groupBy("InvoiceNo").agg(F.array_sort(F.collect_set("StockCode")).alias("items")), "whole_baskets")
    named = whole.filter(F.col("InvoiceNo").isNotNull())
    n_baskets = named.count()
    keep = (named.select(F.explode("items").alias("StockCode")).groupBy("StockCode").agg(F.count(F.lit(1)).alias("baskets"))
            .filter(F.col("baskets") >= F.lit(min_item_support) * n_baskets))
    kept = F.array_intersect("items", keep.agg(F.collect_list("StockCode")).scalar())
    return whole.select("InvoiceNo", kept.alias("items")).filter(F.size("items") > 0)


def _key(arr: Column) -> Column:
    return F.array_join(F.array_sort(arr), KEY_SEP)


def frequent_itemsets(baskets: DataFrame, min_support: float = DEFAULT_MIN_SUPPORT) -> DataFrame:
    """items (sorted), freq, support (over the baskets given).

    Pattern growth over projected baskets: equal baskets are one row with their
    number; a row (items, tail, n) says that ``n`` baskets hold ``items`` and
    after them, in order, ``tail``.  A step moves each item of the tail to the
    items, counts, drops what is not frequent and merges equal rows.  Steps end
    with the longest frequent itemset.  Each is a grouping and a semi-join of
    rows: no task keeps a tree of its baskets."""
    weighted = stored(baskets.groupBy(F.array_sort(F.array_distinct("items")).alias("items"))
                      .agg(F.count(F.lit(1)).alias("n")), "baskets")
    n = weighted.agg(F.sum("n")).first()[0] or 0
    least = math.ceil(min_support * n)
    kind = weighted.schema["items"].dataType
    empty = weighted.sparkSession.createDataFrame([], T.StructType().add("items", kind).add("freq", "long").add("support", "double"))
    levels = []
    rest = weighted.select(F.array().cast(kind).alias("items"), F.col("items").alias("tail"), "n")
    while True:
        grown = rest.select("items", "tail", "n", F.posexplode("tail").alias("_at", "_item")).select(
            F.concat("items", F.array("_item")).alias("items"),
            F.slice("tail", F.col("_at") + 2, F.size("tail")).alias("tail"), "n")
        counted = grown.groupBy("items").agg(F.sum("n").alias("freq"))
        found = stored(counted.filter(F.col("freq") >= least), f"itemsets_{len(levels) + 1}")
        if found.isEmpty():
            break
        longer = grown.filter(F.size("tail") > 0).join(found.select("items"), "items", "left_semi")
        if not levels:  # what is not frequent by itself is in no longer itemset
            single = found.select(F.explode("items").alias("item")).agg(F.collect_list("item")).scalar()
            longer = longer.withColumn("tail", F.array_intersect("tail", single)).filter(F.size("tail") > 0)
        levels.append(found)
        rest = stored(longer.groupBy("items", "tail").agg(F.sum("n").alias("n")), f"projected_{len(levels)}")
    out = functools.reduce(DataFrame.unionByName, levels) if levels else None
    return empty if out is None else out.select("items", "freq", (F.col("freq") / F.lit(n)).alias("support"))


def association_rules(itemsets: DataFrame, metric: str = "lift",
                      min_threshold: float = DEFAULT_MIN_LIFT) -> DataFrame:
    """antecedents, consequents (sorted arrays), support, confidence, lift."""
    keyed = itemsets.select(_key(F.col("items")).alias("k"), "support")
    multi = itemsets.filter(F.size("items") >= 2)
    # bit i of mask set ⇔ items[i] in the antecedent; masks 1 .. 2^k-2 are the
    # non-empty proper subsets
    splits = multi.select(
        "items", F.col("support"),
        F.explode(F.expr("sequence(1L, shiftleft(1L, size(items)) - 2L)")).alias("mask"))
    splits = splits.select(
        F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1L) = 1L)").alias("antecedents"),
        F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1L) = 0L)").alias("consequents"),
        "support")
    a = keyed.select(F.col("k").alias("ak"), F.col("support").alias("a_support"))
    c = keyed.select(F.col("k").alias("ck"), F.col("support").alias("c_support"))
    rules = (splits.withColumn("ak", _key(F.col("antecedents")))
             .withColumn("ck", _key(F.col("consequents")))
             .join(a, "ak").join(c, "ck"))
    rules = rules.select(
        "antecedents", "consequents",
        F.col("a_support").alias("antecedent_support"),
        F.col("c_support").alias("consequent_support"),
        "support",
        (F.col("support") / F.col("a_support")).alias("confidence"),
        (F.col("support") / F.col("a_support") / F.col("c_support")).alias("lift"))
    return rules.filter(F.col(metric) >= F.lit(min_threshold))


def mine_rules(tx: DataFrame, min_item_support: float = DEFAULT_MIN_ITEM_SUPPORT,
               min_support: float = DEFAULT_MIN_SUPPORT, metric: str = "lift",
               min_threshold: float = DEFAULT_MIN_LIFT) -> DataFrame:
    baskets = basket_matrix(tx, min_item_support)
    rules = association_rules(frequent_itemsets(baskets, min_support), metric, min_threshold)
    return rules.orderBy(F.desc("lift"), _key(F.col("antecedents")), _key(F.col("consequents")))


def label_rules(rules: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Add " + "-joined description labels (code when no description) and the
    comma-joined code text used by the serving table."""
    rid = F.concat_ws("|", _key(F.col("antecedents")), _key(F.col("consequents")))
    base = rules.withColumn("_rid", rid)
    parts = []
    for side in ("antecedents", "consequents"):
        ex = base.select("_rid", F.posexplode(side).alias("pos", "code"))
        # descriptions restricted to codes that occur in rules before the join
        d = descriptions.join(ex.select(F.col("code").alias("StockCode")).distinct(), "StockCode",
                              "left_semi")
        lab = (ex.join(d, ex.code == d.StockCode, "left")
               .groupBy("_rid")
               .agg(F.array_join(F.transform(
                   F.sort_array(F.collect_list(F.struct("pos", F.coalesce("Description", "code")
                                                        .alias("t")))),
                   lambda s: s["t"]), " + ").alias(f"{side}_label")))
        parts.append(lab)
    out = base.join(parts[0], "_rid", "left").join(parts[1], "_rid", "left")
    return out.select(
        F.col("antecedents_label").alias("antecedents"),
        F.col("consequents_label").alias("consequents"),
        F.col("antecedents").alias("antecedents_codes"),
        F.col("consequents").alias("consequents_codes"),
        "support", "confidence", "lift")


def flatten_rules(labelled: DataFrame) -> DataFrame:
    """Serving form: code lists joined with ','."""
    return labelled.select(
        "antecedents", "consequents",
        F.array_join("antecedents_codes", ",").alias("antecedents_codes"),
        F.array_join("consequents_codes", ",").alias("consequents_codes"),
        "support", "confidence", "lift")


# ------------------------------------------------------------ recommendations
def recommend_for_baskets(rules: DataFrame, baskets: DataFrame, top_n: int = 5) -> DataFrame:
    """For every basket (basket_id, items array): products not in the basket,
    each with its best firing rule (max lift, ties → smallest rule text),
    top ``top_n`` by lift (ties → StockCode).

    Worked out once per distinct item set, however many baskets hold it."""
    keyed = baskets.select("basket_id", F.array_sort(F.array_distinct("items")).alias("items"))
    keyed = keyed.withColumn("_set", _key(F.col("items")))
    sets = keyed.groupBy(F.col("_set").alias("basket_id")).agg(F.first("items").alias("items"))
    recs = _recommend_for_sets(rules, sets, top_n).withColumnRenamed("basket_id", "_set")
    return keyed.select("basket_id", "_set").join(recs, "_set").drop("_set")


def rule_index(rules: DataFrame, held: DataFrame) -> DataFrame:
    """``rules`` keyed by the antecedent item that the fewest sets hold
    (``held``: item, sets; ties to the smaller item).  A set that fires a rule
    holds that item, so it meets each rule once, by its rarest item, and hot
    items meet only rules that have nothing rarer."""
    r = rules.select("antecedents", "consequents", "lift", "confidence", "support",
                     F.concat_ws("|", _key(F.col("antecedents")), _key(F.col("consequents"))).alias("rule_id"))
    items = r.select("rule_id", F.explode("antecedents").alias("item")).join(held, "item", "left")
    rarest = items.groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("sets", F.lit(0)).alias("sets"), "item")).alias("k"))
    return r.join(rarest, "rule_id").filter("k.sets > 0").withColumn("key", F.col("k.item")).drop("k")


def fired_rules(rules: DataFrame, baskets: DataFrame) -> DataFrame:
    """basket_id, items and the rule, for every rule whose antecedents all lie
    in the basket: one index look-up an item, then one containment test."""
    b_items = baskets.select("basket_id", "items", F.explode(F.array_distinct("items")).alias("key"))
    held = b_items.groupBy(F.col("key").alias("item")).agg(F.count(F.lit(1)).alias("sets"))
    met = b_items.join(rule_index(rules, held), "key")
    return met.filter(F.size(F.array_except("antecedents", "items")) == 0).drop("key")


def _recommend_for_sets(rules: DataFrame, baskets: DataFrame, top_n: int) -> DataFrame:
    cand = (fired_rules(rules, baskets)
            .select("basket_id", F.explode(F.array_except("consequents", "items")).alias("StockCode"),
                    "lift", "confidence", "support",
                    F.array_join("antecedents", ", ").alias("from_rule"),
                    F.array_join("consequents", ",").alias("_ck")))
    w_best = Window.partitionBy("basket_id", "StockCode").orderBy(F.desc("lift"), "from_rule", "_ck")
    best = cand.withColumn("_r", F.row_number().over(w_best)).filter("_r = 1").drop("_r")
    w_top = Window.partitionBy("basket_id").orderBy(F.desc("lift"), "StockCode")
    return (best.withColumn("rank", F.row_number().over(w_top)).filter(F.col("rank") <= top_n)
            .select("basket_id", "rank", "StockCode", "lift", "confidence", "support", "from_rule"))


def recommend_for_products(rules: DataFrame, products: DataFrame, top_n: int = 5) -> DataFrame:
    """Single-product baskets for every product in ``products`` (StockCode)."""
    baskets = products.select(F.col("StockCode").alias("basket_id"),
                              F.array(F.col("StockCode")).alias("items"))
    return recommend_for_baskets(rules, baskets, top_n).withColumnRenamed("basket_id", "product")


def add_descriptions(recs: DataFrame, descriptions: DataFrame) -> DataFrame:
    d = descriptions.join(recs.select("StockCode").distinct(), "StockCode", "left_semi")
    return (recs.join(d, "StockCode", "left")
            .withColumn("Description", F.coalesce(F.col("Description"), F.lit(""))))
