"""Segment performance, marketing strategies, ROI projection and the summary figures.

Segments are keyed by cluster: two clusters with the same persona name stay two rows throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.functions.exprs import guarded_ratio, money_text, number_text, parse_percent, percent_text
from cartlens.operators.rules import HIGH_LIFT

# The strategy catalogue.
STRATEGIES = [
    {
        "segment": "Champions",
        "focus": "Retention & Advocacy",
        "tactics": [
            "VIP customer program with exclusive benefits",
            "Early access to new products",
            "Personalized account management",
            "Referral incentive programs",
            "Premium customer support channel",
        ],
        "kpis": ["Customer Lifetime Value", "Retention Rate", "Referral Count"],
        "budget": "25%",
    },
    {
        "segment": "Loyal Customers",
        "focus": "Upselling & Cross-selling",
        "tactics": [
            "Category expansion campaigns",
            "Bundle product recommendations",
            "Seasonal promotion targeting",
            "Loyalty point accelerators",
            "Purchase frequency incentives",
        ],
        "kpis": ["Average Order Value", "Purchase Frequency", "Category Penetration"],
        "budget": "30%",
    },
    {
        "segment": "Big Spenders",
        "focus": "Frequency Increase",
        "tactics": [
            "Premium product showcases",
            "Exclusive high-value product access",
            "Bulk purchase incentives",
            "Corporate account development",
            "Personalized high-value recommendations",
        ],
        "kpis": ["Purchase Frequency", "Average Order Value", "Revenue Growth"],
        "budget": "20%",
    },
    {
        "segment": "Potential Loyalists",
        "focus": "Engagement & Development",
        "tactics": [
            "Onboarding email sequences",
            "Product education content",
            "First purchase incentives",
            "Category exploration campaigns",
            "Progressive engagement rewards",
        ],
        "kpis": ["Engagement Rate", "Second Purchase Rate", "Time to Loyalty"],
        "budget": "15%",
    },
    {
        "segment": "At Risk",
        "focus": "Win-back & Re-engagement",
        "tactics": [
            "Win-back discount campaigns",
            "Product recommendation refresh",
            "Survey for feedback collection",
            "Limited-time exclusive offers",
            "Channel preference optimization",
        ],
        "kpis": ["Reactivation Rate", "Win-back ROI", "Engagement Recovery"],
        "budget": "8%",
    },
    {
        "segment": "New Customers",
        "focus": "Acquisition & Onboarding",
        "tactics": [
            "Welcome series automation",
            "First-time buyer incentives",
            "Product recommendation engine",
            "Category introduction campaigns",
            "Social proof and reviews",
        ],
        "kpis": ["Conversion Rate", "First Purchase Value", "Onboarding Completion"],
        "budget": "2%",
    },
]

# Revenue lift and retention rate per segment; share of revenue spent on marketing.
RATES = [
    ("Champions", 0.15, 0.95),
    ("Loyal Customers", 0.25, 0.90),
    ("Big Spenders", 0.30, 0.85),
    ("Potential Loyalists", 0.35, 0.70),
    ("At Risk", 0.20, 0.50),
    ("New Customers", 0.40, 0.60),
]
MARKETING_SHARE = 0.05


def strategy_dimension(spark: SparkSession) -> DataFrame:
    rows = [(s["segment"], s["focus"], s["tactics"], s["kpis"], s["budget"]) for s in STRATEGIES]
    table = spark.createDataFrame(
        rows, "segment string, focus string, tactics array<string>, kpis array<string>, budget_allocation string"
    )
    return table.withColumn("budget_share", parse_percent(F.col("budget_allocation")))


def rate_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "segment string, revenue_lift double, retention_improvement double")


def facts_with_cluster(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Order lines with their customer's cluster; lines of customers without one drop out.

    One label per customer, so lines meet labels one to one. Catalyst broadcasts the labels when they
    are small; otherwise adaptive execution splits the partition of a hot customer.
    """
    return facts.join(labels.select("customer_id", "cluster"), "customer_id")


def segment_performance(facts: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """KPIs per cluster. ``names`` has ``cluster`` and ``name``.

    ``orders_per_customer`` is order *lines* per customer and ``avg_order_value`` the mean over orders,
    as in the exported figures.
    """
    lines = facts_with_cluster(
        facts.select("customer_id", "order_id", "sales", "profit", "category", "region"), labels
    )
    # One pass over the lines: a row per order and place, then the orders, customers, categories and regions of a cluster as
    # keys of one aggregate. Sums ride on the orders; values are counted and combined before they are shuffled.
    keys = ["order_id", "customer_id", "category", "region"]
    by_order = lines.groupBy("cluster", "customer_id", "order_id", "category", "region").agg(
        F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("n_lines")
    )
    values = by_order.groupingSets([["cluster", c] for c in keys], "cluster", *keys).agg(
        F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.sum("n_lines").alias("n"),
        *[(F.grouping(c) == 0).alias(f"of_{c}") for c in keys],
    )
    total = lambda c: F.sum(F.when(F.col("of_order_id"), F.col(c)))
    distinct = lambda c: F.count(F.when(F.col(f"of_{c}"), F.col(c)))
    known = F.sum(F.when(F.col("of_order_id") & F.col("order_id").isNotNull(), F.col("sales")))
    top = lambda c: F.coalesce(
        F.min_by(c, F.when(F.col(f"of_{c}") & F.col(c).isNotNull(), F.struct(-F.col("n"), F.col(c)))), F.lit("N/A")
    )
    totals = values.groupBy("cluster").agg(
        distinct("customer_id").alias("customer_count"),
        total("sales").alias("total_revenue"),
        total("profit").alias("total_profit"),
        F.try_divide(known, distinct("order_id")).alias("avg_order_value"),
        total("n").alias("n_lines"),
        top("category").alias("primary_category"),
        top("region").alias("primary_region"),
    )
    rows = (
        totals.join(names.select("cluster", F.col("name").alias("segment")), "cluster")
        .withColumn("orders_per_customer", F.try_divide("n_lines", "customer_count"))
        .withColumn("profit_margin", guarded_ratio(F.col("total_profit"), F.col("total_revenue")))
        .withColumn("revenue_per_customer", F.try_divide("total_revenue", "customer_count"))
    )
    return with_shares(rows).select(
        "cluster", "segment", "customer_count", "total_revenue", "total_profit", "avg_order_value",
        "orders_per_customer", "profit_margin", "revenue_per_customer", "primary_category", "primary_region",
        "revenue_share", "customer_share",
    )


def with_shares(rows: DataFrame) -> DataFrame:
    """Shares of revenue and customers; the totals are a window over the few segment rows, which are computed once."""
    total = lambda c: F.sum(c).over(Window.partitionBy())
    return rows.withColumn("revenue_share", F.try_divide(F.col("total_revenue") * 100, total("total_revenue"))).withColumn(
        "customer_share", F.try_divide(F.col("customer_count") * 100.0, total("customer_count"))
    )


def segment_preview(performance: DataFrame) -> DataFrame:
    return performance.select(
        "cluster", "segment", "customer_count", "total_revenue", "total_profit", "avg_order_value", "revenue_share"
    )


def format_segments(performance: DataFrame) -> DataFrame:
    """Display strings of the segment figures."""
    return performance.select(
        "cluster", "segment",
        number_text(F.col("customer_count").cast("double")).alias("customers"),
        money_text(F.col("total_revenue")).alias("revenue"),
        money_text(F.col("avg_order_value")).alias("avg_order_value"),
        percent_text(F.col("revenue_share") / 100).alias("revenue_share"),
    )


def executive_summary(facts: DataFrame, customers: DataFrame, n_segments: int, rules: DataFrame, min_lift: float = HIGH_LIFT) -> DataFrame:
    """Headline figures. Customers are those that were clustered, revenue is all of it, as reported."""
    orders = F.countDistinct("order_id")
    revenue, profit = F.sum("sales"), F.sum("profit")
    found = rules.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lift") > min_lift).alias("high")).alias("r")
    ).scalar()
    clustered = customers.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        facts.agg(
            revenue.alias("total_revenue"),
            profit.alias("total_profit"),
            orders.alias("total_orders"),
            F.try_divide(F.sum(F.when(F.col("order_id").isNotNull(), F.col("sales"))), orders).alias("avg_order_value"),
            F.try_divide(profit, revenue).alias("profit_margin"),
        )
        .withColumn("total_customers", clustered)
        .withColumn("n_segments", F.lit(n_segments).cast("long"))
        .withColumn("_r", found)
        .withColumn("n_rules", F.col("_r.n"))
        .withColumn("high_impact_rules", F.col("_r.high"))
        .drop("_r")
    )


def strategies(performance: DataFrame) -> DataFrame:
    """Strategy of each segment beside its size, revenue and value. The catalogue has six rows."""
    catalogue = F.broadcast(strategy_dimension(performance.sparkSession))
    return performance.select(
        "cluster", "segment", "customer_count", "total_revenue", "revenue_per_customer"
    ).join(catalogue, "segment")


def roi_projection(performance: DataFrame) -> DataFrame:
    """Projected increase, budget and ROI per segment; segments without a rate drop out."""
    spark = performance.sparkSession
    total = performance.agg(F.sum("total_revenue")).scalar()
    return (
        performance.join(F.broadcast(rate_dimension(spark)), "segment")
        .join(F.broadcast(strategy_dimension(spark).select("segment", "focus", "budget_share")), "segment")
        .withColumn("projected_increase", F.col("total_revenue") * F.col("revenue_lift"))
        .withColumn("marketing_budget", total * MARKETING_SHARE * F.col("budget_share"))
        .withColumn("roi", guarded_ratio(F.col("projected_increase"), F.col("marketing_budget")))
        .select(
            "cluster", "segment", F.col("total_revenue").alias("current_revenue"), "projected_increase",
            "marketing_budget", "roi", F.col("customer_count").alias("customers"), "retention_improvement", "focus",
        )
    )


def roi_overall(projection: DataFrame, performance: DataFrame) -> DataFrame:
    total = performance.agg(F.sum("total_revenue")).scalar()
    increase, budget = F.sum("projected_increase"), F.sum("marketing_budget")
    return (
        projection.agg(
            F.coalesce(increase, F.lit(0.0)).alias("total_increase"),
            F.coalesce(budget, F.lit(0.0)).alias("total_budget"),
        )
        .withColumn("overall_roi", guarded_ratio(F.col("total_increase"), F.col("total_budget")))
        .withColumn("growth_rate", F.try_divide(F.col("total_increase"), total))
    )


def priority_segments(projection: DataFrame, n: int = 3) -> DataFrame:
    return projection.orderBy(F.desc("roi"), "cluster").limit(n).select("cluster", "segment", "roi", "focus")


def summary_report(facts: DataFrame, customers: DataFrame, names: DataFrame, projection: DataFrame, overall: DataFrame) -> DataFrame:
    """Figures of the closing report; growth is measured against the revenue of all lines. A segment
    counts as high-value if its name contains Champion or Loyal."""
    revenue = facts.agg(F.sum("sales")).scalar()
    high = names.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("name").contains("Champion") | F.col("name").contains("Loyal")).alias("high"),
        ).alias("s")
    ).scalar()
    clustered = customers.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        overall.select(F.col("total_increase").alias("revenue_opportunity"), "overall_roi")
        .withColumn("growth_rate", F.try_divide(F.col("revenue_opportunity"), revenue))
        .withColumn("total_customers", clustered)
        .withColumn("_s", high)
        .withColumn("n_segments", F.col("_s.n"))
        .withColumn("high_value_segments", F.col("_s.high"))
        .drop("_s")
    )


def format_roi(projection: DataFrame) -> DataFrame:
    return projection.select(
        "cluster", "segment",
        money_text(F.col("current_revenue")).alias("current_revenue"),
        money_text(F.col("projected_increase")).alias("projected_increase"),
        money_text(F.col("marketing_budget")).alias("marketing_budget"),
        F.format_string("%.1fx", F.col("roi")).alias("roi"),
    )
