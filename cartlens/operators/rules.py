"""What is read off the rules: rankings, recommendations, cross-selling, monthly confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.exprs import (
    item_text,
    lift_label3,
    lift_label4,
    month_key,
    number_text,
    percent_text,
    shorten,
)
from cartlens.operators.baskets import basket_items

# Cut-offs of the rule filters and the assumed uplift per rule.
HIGH_LIFT = 2.0
HIGH_CONFIDENCE = 0.5
IMPACT_CONFIDENCE, IMPACT_SUPPORT = 0.3, 0.01
UPLIFT_PER_RULE = 0.1


def rule_order(*first: Column) -> list[Column]:
    """A total order of the rules: the given columns, then the item sets."""
    return [*first, F.col("antecedents"), F.col("consequents")]


def by_lift() -> list[Column]:
    return rule_order(F.desc(F.round("lift", 9)), F.desc(F.round("confidence", 9)))


def rule_strength_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("lift_strength").agg(F.count(F.lit(1)).alias("n"))


def top_rules(rules: DataFrame, n: int = 20, sort_by: str = "lift") -> DataFrame:
    """The first ``n`` rules by ``sort_by`` (lift, confidence or support), then confidence."""
    order = rule_order(F.desc(F.round(sort_by, 9)), F.desc(F.round("confidence", 9)))
    return (
        rules.orderBy(*order)
        .limit(n)
        .withColumn("strength", lift_label4(F.col("lift")))
        .withColumn("strength3", lift_label3(F.col("lift")))
    )


def format_rules(rules: DataFrame, width: int = 40) -> DataFrame:
    """Display strings of the rules."""
    left, right = item_text(F.col("antecedents")), item_text(F.col("consequents"))
    return rules.select(
        F.concat_ws(" → ", shorten(left, width), shorten(right, width)).alias("rule"),
        percent_text(F.col("support"), 2).alias("support"),
        percent_text(F.col("confidence"), 1).alias("confidence"),
        number_text(F.col("lift"), 2).alias("lift"),
        lift_label3(F.col("lift")).alias("strength"),
    )


def rule_quality(rules: DataFrame, high_lift: float = HIGH_LIFT, high_confidence: float = HIGH_CONFIDENCE) -> DataFrame:
    n = F.count(F.lit(1))
    lift, confidence = F.count_if(F.col("lift") > high_lift), F.count_if(F.col("confidence") > high_confidence)
    return rules.agg(
        n.alias("n_rules"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("lift").alias("avg_lift"),
        lift.alias("high_lift_rules"),
        F.try_divide(lift, n).alias("high_lift_share"),
        confidence.alias("high_confidence_rules"),
        F.try_divide(confidence, n).alias("high_confidence_share"),
    )


def temporal_confidence(rules: DataFrame, facts: DataFrame, item_col: str = "product_name") -> DataFrame:
    """Monthly confidence of every one-to-one rule: of the month's orders with the antecedent, the share
    that also has the consequent. An order counts in each month its lines fall in.

    Occurrences of an item and of a pair of items are counted apart, by month; only the counts meet the rules. Pairs are
    those that occur in an order, among items of these rules.
    """
    simple = rules.filter((F.size("antecedents") == 1) & (F.size("consequents") == 1)).select(
        F.element_at("antecedents", 1).alias("antecedent"), F.element_at("consequents", 1).alias("consequent")
    )
    wanted = simple.select(F.explode(F.array("antecedent", "consequent")).alias("item")).distinct()
    items = basket_items(facts, item_col).join(wanted, "item", "left_semi").select("order_id", "item")
    months = facts.select("order_id", month_key(F.col("order_date")).alias("month")).distinct()
    dated = items.join(months, "order_id").withColumnRenamed("item", "antecedent")
    occurrences = dated.groupBy("antecedent", "month").agg(F.count(F.lit(1)).alias("n_orders"))
    hits = (
        dated.join(items.withColumnRenamed("item", "consequent"), "order_id").where("antecedent <> consequent")
        .groupBy("antecedent", "consequent", "month").agg(F.count(F.lit(1)).alias("hits"))
    )
    return simple.join(occurrences, "antecedent").join(hits, ["antecedent", "consequent", "month"], "left").select(
        "antecedent", "consequent", "month", "n_orders", (F.coalesce("hits", F.lit(0)) / F.col("n_orders")).alias("confidence")
    )


def temporal_preview(monthly: DataFrame, months: int = 6) -> DataFrame:
    """The first months of every rule as text."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("month", "confidence"))), 1, months)
    return (
        monthly.groupBy("antecedent", "consequent")
        .agg(F.count(F.lit(1)).alias("n_months"), first.alias("first"))
        .select(
            "antecedent", "consequent", "n_months",
            F.array_join(
                F.transform("first", lambda e: F.format_string("%s: %.2f", e["month"], e["confidence"])), ", "
            ).alias("preview"),
        )
    )


def monthly_trend(facts: DataFrame) -> DataFrame:
    return facts.groupBy(month_key(F.col("order_date")).alias("month")).agg(
        F.countDistinct("order_id").alias("orders"), F.sum("sales").alias("sales")
    )


def monthly_trend_summary(trend: DataFrame) -> DataFrame:
    return trend.agg(
        F.count(F.lit(1)).alias("n_months"), F.avg("orders").alias("avg_orders"), F.avg("sales").alias("avg_sales")
    )


def recommend(rules: DataFrame, n: int = 5) -> DataFrame:
    """Recommendations for every product at once.

    A product's best ``n`` rules are taken first (rules whose antecedents contain it, by lift, then
    confidence), their consequents follow in that order, each recommended item counts once, at most ``n``.
    Both rankings keep a row number below ``n``, which Spark applies before the shuffle as well.
    """
    best = Window.partitionBy("product").orderBy(*by_lift())
    ranked = (
        rules.withColumn("product", F.explode("antecedents"))
        .withColumn("rule_rank", F.row_number().over(best))
        .filter(F.col("rule_rank") <= n)
        .select("product", "rule_rank", "confidence", "lift", "support", F.posexplode("consequents").alias("at", "item"))
    )
    first = Window.partitionBy("product", "item").orderBy("rule_rank", "at")
    order = Window.partitionBy("product").orderBy("rule_rank", "at")
    return (
        ranked.withColumn("seen", F.row_number().over(first))
        .filter("seen = 1")
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= n)
        .select("product", "position", F.col("item").alias("recommended_product"), "confidence", "lift", "support")
    )


def recommend_for(rules: DataFrame, product: str, n: int = 5) -> DataFrame:
    """Recommendations for one product; no rows if no rule mentions it."""
    return recommend(rules.filter(F.array_contains("antecedents", product)), n).filter(F.col("product") == product)


def format_recommendations(recommendations: DataFrame) -> DataFrame:
    return recommendations.select(
        "product", "position", "recommended_product",
        percent_text(F.col("confidence"), 1).alias("confidence"),
        number_text(F.col("lift"), 2).alias("lift"),
        percent_text(F.col("support"), 2).alias("support"),
    )


def recommendable_products(rules: DataFrame) -> DataFrame:
    return rules.select(F.explode("antecedents").alias("product")).distinct().orderBy("product")


def product_category_map(facts: DataFrame, item_col: str = "product_name") -> DataFrame:
    """Category and sub-category of each product name in its earliest order; the smaller name on ties."""
    places = (
        facts.filter(F.col(item_col).isNotNull())
        .groupBy(F.col(item_col).alias("item"), "category", "sub_category")
        .agg(F.min("order_date").alias("since"))
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("since", c))).alias(c)
    return places.groupBy("item").agg(first("category"), first("sub_category"))


def rule_categories(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules with the sorted category sets of both sides."""
    sides = rules.select(
        "antecedents",
        "consequents",
        F.explode(
            F.concat(
                F.transform("antecedents", lambda x: F.struct(F.lit("a").alias("side"), x.alias("item"))),
                F.transform("consequents", lambda x: F.struct(F.lit("c").alias("side"), x.alias("item"))),
            )
        ).alias("e"),
    ).select("antecedents", "consequents", "e.side", "e.item")
    on = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("category"))))
    sets = (
        sides.join(categories.select("item", "category"), "item", "left")
        .groupBy("antecedents", "consequents")
        .agg(on("a").alias("antecedent_categories"), on("c").alias("consequent_categories"))
    )
    return rules.join(sets, ["antecedents", "consequents"])


def cross_category_rules(with_categories: DataFrame) -> DataFrame:
    """Rules whose sides share no category; two empty sets share none."""
    return with_categories.filter(~F.arrays_overlap("antecedent_categories", "consequent_categories"))


def top_cross_category(with_categories: DataFrame, n: int = 10) -> DataFrame:
    return cross_category_rules(with_categories).orderBy(*rule_order(F.desc(F.round("lift", 9)))).limit(n)


def order_value(facts: DataFrame) -> DataFrame:
    """Mean order value and number of orders, in one aggregate."""
    sold = F.sum(F.when(F.col("order_id").isNotNull(), F.col("sales")))
    orders = F.countDistinct("order_id")
    return facts.agg(F.try_divide(sold, orders).alias("avg_order_value"), orders.alias("n_orders"))


def cross_sell_revenue(
    rules: DataFrame,
    facts: DataFrame,
    min_confidence: float = IMPACT_CONFIDENCE,
    min_lift: float = HIGH_LIFT,
    min_support: float = IMPACT_SUPPORT,
) -> DataFrame:
    """Revenue estimate: high-impact rules x mean order value x 10 %."""
    impact = (
        rules.filter(
            (F.col("confidence") > min_confidence) & (F.col("lift") > min_lift) & (F.col("support") > min_support)
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .scalar()
    )
    return (
        order_value(facts)
        .withColumn("high_impact_rules", impact)
        .withColumn("estimated_revenue", F.col("high_impact_rules") * F.col("avg_order_value") * UPLIFT_PER_RULE)
    )


def high_lift_rules(rules: DataFrame, n: int, min_lift: float = HIGH_LIFT) -> DataFrame:
    """The ``n`` most confident rules above a lift."""
    return (
        rules.filter(F.col("lift") > min_lift)
        .orderBy(*rule_order(F.desc(F.round("confidence", 9)), F.desc(F.round("lift", 9))))
        .limit(n)
    )


def cross_sell_report(rules: DataFrame, facts: DataFrame, min_lift: float = HIGH_LIFT, n: int = 5) -> DataFrame:
    """The report variant: the estimate counts only the ``n`` rules it lists."""
    shown = high_lift_rules(rules, n, min_lift).agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        order_value(facts)
        .withColumn("listed_rules", shown)
        .withColumn("estimated_revenue", F.col("listed_rules") * F.col("avg_order_value") * UPLIFT_PER_RULE)
    )


def rule_points(rules: DataFrame) -> DataFrame:
    return rules.select("support", "confidence", "lift")


def top_rules_chart(rules: DataFrame, n: int = 10, width: int = 20) -> DataFrame:
    """Rules by lift with short labels for a bar chart."""
    left, right = item_text(F.col("antecedents")), item_text(F.col("consequents"))
    return (
        rules.orderBy(*by_lift())
        .limit(n)
        .select(F.concat_ws(" → ", shorten(left, width), shorten(right, width)).alias("label"), "lift", "confidence")
    )
