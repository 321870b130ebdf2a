"""Cluster profiles, named personas and the datasets about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.functions.exprs import cluster_text, money_text, number_text, percent_text
from cartlens.operators.features import CLUSTERING_FEATURES

# Persona names, descriptions and strategies.
PERSONAS = [
    ("Champions", "High-value, frequent customers - Best segment for retention",
     "VIP treatment, exclusive offers, loyalty rewards"),
    ("Loyal Customers", "Regular customers with consistent purchase behavior",
     "Upselling, cross-category promotions, referral programs"),
    ("Big Spenders", "Recent high-value customers with potential for growth",
     "Premium product recommendations, personalized service"),
    ("Potential Loyalists", "Recent customers showing engagement potential",
     "Onboarding campaigns, product education, engagement boost"),
    ("At Risk", "Previously valuable customers who haven't purchased recently",
     "Win-back campaigns, special discounts, re-engagement"),
    ("New Customers", "Recently acquired customers with unknown potential",
     "Welcome series, category exploration, habit formation"),
]


def persona_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSONAS, "name string, description string, strategy string")


def cluster_profiles(customers: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    return customers.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in features]
    )


def distribution(customers: DataFrame, column: str) -> DataFrame:
    """Share of each value of ``column`` within a cluster, in percent. The window runs over the counts."""
    counts = (
        customers.filter(F.col(column).isNotNull()).groupBy("cluster", column).agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("cluster"))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def cluster_segment_dist(customers: DataFrame) -> DataFrame:
    return distribution(customers, "segment")


def cluster_region_dist(customers: DataFrame) -> DataFrame:
    return distribution(customers, "region")


def cluster_primary(customers: DataFrame) -> DataFrame:
    """Most common segment and region of each cluster with their shares; the first name on ties."""

    def top(column: str) -> DataFrame:
        order = F.struct(-F.col("n"), F.col(column))
        return distribution(customers, column).groupBy("cluster").agg(
            F.min_by(column, order).alias(f"primary_{column}"), F.min_by("pct", order).alias(f"{column}_pct")
        )

    return top("segment").join(top("region"), "cluster")


def segment_cluster_crosstab(customers: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """Customers per business segment and cluster, a column per cluster."""
    table = customers.groupBy("segment").pivot("cluster", list(clusters)).count().na.fill(0)
    return table.select("segment", *[F.col(str(c)).alias(f"cluster_{c}") for c in clusters])


def persona_name(profile: DataFrame) -> DataFrame:
    """Profiles with the persona of each: the first rung of the ladder that fits.

    The thresholds are quantiles over the clusters' means, one row of at most a few values each.
    """
    q = lambda c, p: F.percentile(c, F.lit(p))
    limits = profile.agg(
        F.struct(
            q("monetary", 0.8).alias("m80"), q("monetary", 0.7).alias("m70"),
            q("frequency", 0.7).alias("f70"), q("frequency", 0.6).alias("f60"),
            q("recency", 0.3).alias("r30"), q("recency", 0.4).alias("r40"), q("recency", 0.8).alias("r80"),
        ).alias("l")
    ).scalar()
    m, f, rec = F.col("monetary"), F.col("frequency"), F.col("recency")
    limit = lambda name: F.col(f"_l.{name}")
    names = [p[0] for p in PERSONAS]
    rung = (
        F.when((m >= limit("m80")) & (f >= limit("f60")), names[0])
        .when(f >= limit("f70"), names[1])
        .when((m >= limit("m70")) & (rec <= limit("r30")), names[2])
        .when(rec <= limit("r40"), names[3])
        .when(rec >= limit("r80"), names[4])
        .otherwise(names[5])
    )
    return profile.withColumn("_l", limits).withColumn("name", rung).drop("_l")


def personas(customers: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    """One row per cluster: name, description, strategy, size, share, and the profile as a struct."""
    named = persona_name(cluster_profiles(customers, features))
    return with_persona_text(named, features)


def with_persona_text(named: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    total = named.agg(F.sum("size")).scalar()
    return (
        named.join(F.broadcast(persona_dimension(named.sparkSession)), "name")
        .withColumn("percentage", F.try_divide(F.col("size") * 100.0, total))
        .select(
            "cluster", "name", "description", "strategy", "size", "percentage",
            F.struct(*features).alias("profile"),
        )
    )


def cluster_revenue(facts: DataFrame, customers: DataFrame, persona_rows: DataFrame) -> DataFrame:
    """Sales per cluster with the persona's name. Sales are summed per customer first, so the join sees
    one row per customer and a hot customer is one row like any other."""
    per_customer = facts.groupBy("customer_id").agg(F.sum("sales").alias("sales"))
    return (
        per_customer.join(customers.select("customer_id", "cluster"), "customer_id")
        .groupBy("cluster")
        .agg(F.sum("sales").alias("sales"))
        .join(persona_rows.select("cluster", F.col("name").alias("segment_name")), "cluster")
    )


def cluster_summary(persona_rows: DataFrame) -> DataFrame:
    """Display rows: cluster, name, size and six formatted figures."""
    p = lambda c: F.col(f"profile.{c}")
    return persona_rows.select(
        "cluster", "name", "size",
        percent_text(F.col("percentage") / 100).alias("percentage"),
        number_text(p("recency")).alias("recency"),
        number_text(p("frequency"), 1).alias("frequency"),
        money_text(p("monetary")).alias("monetary"),
        money_text(p("avg_order_value")).alias("avg_order_value"),
        money_text(p("total_profit")).alias("total_profit"),
        cluster_text(F.col("cluster"), F.col("name")).alias("cluster_label"),
    )


def cluster_samples(customers: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` customers of every cluster by id; Spark trims each task to ``n`` before the shuffle."""
    order = Window.partitionBy("cluster").orderBy("customer_id")
    return customers.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= n)
