"""Baskets, frequent itemsets and association rules.

Orders stay in long form (order_id, item) until only frequent items are left: a giant order is then many
rows in many tasks, and the array a basket finally becomes is no longer than the list of frequent items.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.exprs import lift_band
from cartlens.session import reused, written

# Thresholds of the basket analysis.
MIN_ORDERS = 15
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.25
SMALL_DATA = 100

ITEMSET_SCHEMA = "items array<string>, size int, freq long, support double"


def basket_items(facts: DataFrame, item_col: str = "product_name") -> DataFrame:
    """Distinct (order_id, item) with a positive bought quantity."""
    return (
        facts.filter(F.col("order_id").isNotNull() & F.col(item_col).isNotNull())
        .groupBy("order_id", F.col(item_col).alias("item"))
        .agg(F.sum("quantity").alias("bought"))
        .filter("bought > 0")
        .select("order_id", "item")
    )


def as_baskets(items: DataFrame) -> DataFrame:
    """One row per order with its sorted item set; ``items`` is already distinct."""
    return items.groupBy("order_id").agg(F.array_sort(F.collect_list("item")).alias("items"))


def item_orders(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n_orders"))


def prune_rare_items(items: DataFrame, min_orders: int = MIN_ORDERS) -> DataFrame:
    """Lines of items that occur in at least ``min_orders`` orders.

    The items are written first: the join then plans with their real size, and the lines that meet a short list are
    neither shuffled nor sorted by item.
    """
    kept = written(item_orders(items).filter(F.col("n_orders") >= min_orders).select("item"))
    return items.join(kept, "item", "left_semi").select("order_id", "item")


def basket_stats(items: DataFrame, min_orders: int = MIN_ORDERS) -> DataFrame:
    """Orders, kept items, kept items per order (0 where none is left), and the multi-item orders."""
    kept = item_orders(items).filter(F.col("n_orders") >= min_orders).select("item", F.lit(1).alias("kept"))
    sizes = items.join(kept, "item", "left").groupBy("order_id").agg(F.count("kept").alias("n"))
    n_items = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        sizes.agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.avg("n").alias("avg_items"),
            F.max("n").alias("max_items"),
            F.min("n").alias("min_items"),
            F.count_if(F.col("n") > 1).alias("multi_item_orders"),
        )
        .withColumn("n_items", n_items)
        .withColumn("single_item_orders", F.col("n_orders") - F.col("multi_item_orders"))
        .withColumn("small_data", F.col("multi_item_orders") < SMALL_DATA)
    )


def multi_item_lines(items: DataFrame, min_orders: int = MIN_ORDERS) -> DataFrame:
    """Kept lines of the orders with more than one kept item. The lines move once, to their order, and stay there for
    the baskets made of them."""
    several = F.count(F.lit(1)).over(Window.partitionBy("order_id"))
    kept = prune_rare_items(items, min_orders).filter("order_id IS NOT NULL")
    return kept.withColumn("n", several).filter("n > 1").select("order_id", "item")


def multi_item_baskets(items: DataFrame, min_orders: int = MIN_ORDERS) -> DataFrame:
    return as_baskets(multi_item_lines(items, min_orders))


def minimum_count(min_support: float, n: int) -> int:
    """The smallest count whose share of ``n`` reaches ``min_support``."""
    count = max(1, math.ceil(min_support * n))
    while count > 1 and (count - 1) / n >= min_support:
        count -= 1
    while count / n < min_support:
        count += 1
    return count


def frequent_itemsets(lines: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Every item set in at least ``min_support`` of the orders of ``lines``: sorted items, size, count,
    support.

    Items below the threshold go before the baskets are built. At most (mean basket size / support)
    items can be frequent, which bounds every basket array, also that of an order with millions of lines.
    Items and pairs are counted by plain aggregates. Only items of which three are frequent in pairs can be in a larger
    set; prefix trees are grown over those alone, in the orders that hold three of them.
    """
    spark = lines.sparkSession
    lines = reused(lines)
    n = lines.select("order_id").distinct().count()
    if n == 0:
        return spark.createDataFrame([], ITEMSET_SCHEMA)
    count = minimum_count(min_support, n)
    singles = written(lines.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= count))
    kept = lines.join(singles.select("item"), "item", "left_semi")
    pairs = written(frequent_pairs(as_baskets(kept).select("items"), count))
    found = singles.select(F.array("item").alias("items"), "freq").unionByName(pairs.select(F.array("a", "b").alias("items"), "freq"))
    several = reused(triangle_items(pairs))
    if not several.isEmpty():
        large = reused(as_baskets(kept.join(several, "item", "left_semi")).select("items").filter(F.size("items") > 2))
        m = large.count()
        if m >= count:
            model = FPGrowth(itemsCol="items", minSupport=(count - 0.5) / m, minConfidence=1.0).fit(large)
            found = found.unionByName(
                model.freqItemsets.filter(F.size("items") > 2).select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"))
            )
    return reused(found.select("items", F.size("items").alias("size"), "freq", (F.col("freq") / F.lit(float(n))).alias("support")))


def frequent_pairs(baskets: DataFrame, count: int) -> DataFrame:
    """(a, b, freq) of the pairs a < b that occur in at least ``count`` of the sorted ``items``; a pair is a row on its way,
    never an entry of an array."""
    firsts = baskets.filter(F.size("items") > 1).select("items", F.posexplode("items").alias("at", "a"))
    pairs = firsts.select("a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= count)


def triangle_items(pairs: DataFrame) -> DataFrame:
    """The items (``item``) of all triples whose three pairs are in ``pairs``."""
    edges = pairs.select("a", "b")
    third = edges.select("a", F.col("b").alias("c"))
    closing = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    triples = edges.join(third, "a").filter("b < c").join(closing, ["b", "c"], "left_semi")
    return triples.select(F.explode(F.array("a", "b", "c")).alias("item")).distinct()


def top_itemsets(itemsets: DataFrame, n: int = 15) -> DataFrame:
    return (
        itemsets.withColumn("support_pct", F.col("support") * 100)
        .orderBy(F.desc("freq"), "size", "items")
        .limit(n)
    )


def itemset_size_counts(itemsets: DataFrame) -> DataFrame:
    return itemsets.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size")


def top_single_items(itemsets: DataFrame, n: int = 10) -> DataFrame:
    return (
        itemsets.filter("size = 1")
        .select(F.element_at("items", 1).alias("item"), "support", "freq")
        .orderBy(F.desc("freq"), "item")
        .limit(n)
    )


def rule_splits(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Every (antecedents, consequents) split of an itemset that reaches ``min_confidence``.

    Consequents grow one item at a time, in item order. Moving an item from left to right can only lower
    the confidence, so a split that fails need not be grown and none that passes is missed: the work
    follows the number of rules, not the 2^n splits of an itemset, and needs no limit on its size.
    """
    largest = itemsets.agg(F.max("size").alias("s")).head().s or 0
    support = itemsets.select(F.col("items").alias("antecedents"), F.col("freq").alias("a_freq"))

    def passing(candidates: DataFrame) -> DataFrame:
        return reused(
            candidates.join(support, "antecedents").filter(F.col("freq") / F.col("a_freq") >= min_confidence)
        ).select("antecedents", "consequents", "freq", "a_freq")

    def grown(source: DataFrame, movable) -> DataFrame:
        return source.withColumn("moved", F.explode(movable))

    level = passing(
        grown(itemsets.filter("size > 1").select("items", "freq"), F.col("items")).select(
            F.array_remove("items", F.col("moved")).alias("antecedents"), F.array("moved").alias("consequents"), "freq"
        )
    )
    found = level
    for _ in range(2, largest):
        last = F.element_at("consequents", -1)
        level = passing(
            grown(level.filter(F.size("antecedents") > 1), F.filter("antecedents", lambda x: x > last)).select(
                F.array_remove("antecedents", F.col("moved")).alias("antecedents"),
                F.array_append("consequents", F.col("moved")).alias("consequents"),
                "freq",
            )
        )
        found = found.unionByName(level)
    return found


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules with their interest measures."""
    splits = rule_splits(itemsets, min_confidence)
    consequent = itemsets.select(F.col("items").alias("consequents"), F.col("freq").alias("c_freq"))
    orders = F.round(itemsets.select(F.max(F.col("freq") / F.col("support"))).scalar())
    joined = splits.join(consequent, "consequents").withColumn("_n", orders)
    measured = joined.select(
        "antecedents",
        "consequents",
        (F.col("a_freq") / F.col("_n")).alias("antecedent_support"),
        (F.col("c_freq") / F.col("_n")).alias("consequent_support"),
        (F.col("freq") / F.col("_n")).alias("support"),
    )
    return rule_extras(rule_metrics(measured))


def rule_metrics(rules: DataFrame) -> DataFrame:
    """Interest measures from the three supports."""
    a, c, s = F.col("antecedent_support"), F.col("consequent_support"), F.col("support")
    conf = F.col("confidence")
    return (
        rules.withColumn("confidence", s / a)
        .withColumn("lift", conf / c)
        .withColumn("representativity", F.lit(1.0))
        .withColumn("leverage", s - a * c)
        .withColumn("conviction", F.when(conf >= 1, F.lit(float("inf"))).otherwise(F.try_divide(1 - c, 1 - conf)))
        .withColumn(
            "zhangs_metric",
            F.when(F.col("leverage") == 0, F.lit(0.0)).otherwise(
                F.coalesce(F.try_divide(F.col("leverage"), F.greatest(s * (1 - a), a * (c - s))), F.lit(0.0))
            ),
        )
        .withColumn("jaccard", s / (a + c - s))
        .withColumn("certainty", F.coalesce(F.try_divide(conf - c, 1 - c), F.lit(0.0)))
        .withColumn("kulczynski", (s / a + s / c) / 2)
    )


def rule_extras(rules: DataFrame) -> DataFrame:
    return (
        rules.withColumn("antecedent_len", F.size("antecedents"))
        .withColumn("consequent_len", F.size("consequents"))
        .withColumn("support_pct", F.col("support") * 100)
        .withColumn("confidence_pct", F.col("confidence") * 100)
        .withColumn("lift_strength", lift_band(F.col("lift")))
    )


@dataclass
class Mined:
    itemsets: DataFrame
    rules: DataFrame
    min_support: float
    min_confidence: float
    retried: bool


def mine(lines: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> Mined:
    itemsets = frequent_itemsets(lines, min_support)
    return Mined(itemsets, reused(association_rules(itemsets, min_confidence)), min_support, min_confidence, False)


def mine_with_retry(
    lines: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> Mined:
    """Mine once; without any rule try once more with halved thresholds. If that finds none either, the
    first itemsets stand beside an empty rule table."""
    first = mine(lines, min_support, min_confidence)
    if not first.rules.isEmpty():
        return first
    second = mine(lines, max(min_support / 2, 0.001), max(min_confidence / 2, 0.05))
    if second.rules.isEmpty():
        return Mined(first.itemsets, first.rules, min_support, min_confidence, True)
    return Mined(second.itemsets, second.rules, second.min_support, second.min_confidence, True)
