"""Customer features: recency, frequency, monetary value and behaviour, one row per customer."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.session import checkpointed, reused

# The eight features that clustering uses, in their fixed order.
CLUSTERING_FEATURES = [
    "recency", "frequency", "monetary", "avg_order_value",
    "unique_products", "unique_categories", "total_items", "total_profit",
]

FEATURE_COLUMNS = [
    "customer_id", "recency", "frequency", "monetary", "avg_order_value",
    "unique_products", "unique_categories", "unique_sub_categories",
    "state", "region", "segment", "days_span", "total_items", "total_profit", "avg_profit",
]


def reference_date(facts: DataFrame) -> DataFrame:
    """One row: the day after the last order."""
    return facts.agg(F.date_add(F.max("order_date"), 1).alias("reference_date"))


def _with_recency(customers: DataFrame, as_of: date | None) -> DataFrame:
    """``customers`` with the days since ``last_order``, up to ``as_of`` or the day after the last order of all.

    That day comes from the customers, which are written down for it, one row each: the order lines are read once.
    """
    if as_of is None:
        customers = checkpointed(customers)
    day = F.lit(as_of) if as_of is not None else customers.agg(F.date_add(F.max("last_order"), 1)).scalar()
    return customers.withColumn("recency", F.datediff(day, F.col("last_order")).cast("long"))


def rfm_base(facts: DataFrame, as_of: date | None = None) -> DataFrame:
    customers = facts.groupBy("customer_id").agg(
        F.max("order_date").alias("last_order"),
        F.countDistinct("order_id").alias("frequency"),
        F.sum("sales").alias("monetary"),
    )
    return _with_recency(customers, as_of).select("customer_id", "recency", "frequency", "monetary")


def customer_diversity(facts: DataFrame) -> DataFrame:
    """Distinct products, categories and sub-categories per customer.

    ``countDistinct`` shuffles on (customer, value) first, so a customer with a third of all lines
    is spread over many tasks; a per-customer set would land whole in one.
    """
    return facts.groupBy("customer_id").agg(
        F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("category").alias("unique_categories"),
        F.countDistinct("sub_category").alias("unique_sub_categories"),
    )


def customer_geo(facts: DataFrame) -> DataFrame:
    """State, region and segment of the customer's earliest order; equal dates go to the smaller name.

    The first aggregate has only hash-able keys and a date buffer, so it runs as a hash aggregate and
    leaves one row per customer and place before any string is compared.
    """
    places = facts.groupBy("customer_id", "state", "region", "segment").agg(F.min("order_date").alias("since"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("since", c))).alias(c)
    return places.groupBy("customer_id").agg(first("state"), first("region"), first("segment"))


def customer_days_span(facts: DataFrame) -> DataFrame:
    return facts.groupBy("customer_id").agg(
        F.datediff(F.max("order_date"), F.min("order_date")).cast("long").alias("days_span")
    )


def customer_totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy("customer_id").agg(
        F.sum("quantity").alias("total_items"), F.sum("profit").alias("total_profit")
    )


# What the lines of a customer are counted by: one pass makes a row of each, keyed by the customer, the kind and the value.
ORDERS, PRODUCTS, CATEGORIES, SUB_CATEGORIES, PLACES = range(5)
# Lines of a customer, up to which one task takes them all.
HOT_LINES = 100_000
# Lines a task aggregates, and the number of such tasks up to which adaptive execution sizes them.
LINES_PER_TASK = 250_000
FEW_TASKS = 16


def rfm_features(facts: DataFrame, as_of: date | None = None) -> DataFrame:
    """All fifteen customer columns; a first pass over the lines only counts them by customer.

    Lines move once, to their customer; there orders, products, categories and places are keys of a first aggregate and a
    second one counts them, neither with a shuffle of its own. Sums and dates ride on the orders, and the first dates on
    the places. Lines of customers with more than ``HOT_LINES`` are not gathered: their keys spread them over the tasks.
    """
    counts = reused(facts.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")))
    hot = counts.filter(F.col("n") > HOT_LINES).select(F.col("customer_id").alias("hot_id"))
    # Small inputs are left to adaptive execution; in large ones a task takes as many lines as its aggregates keep in memory.
    usual_lines, most = counts.agg(F.sum(F.when(F.col("n") <= HOT_LINES, F.col("n"))), F.max("n")).head()
    tasks = -(-(usual_lines or 0) // LINES_PER_TASK)
    to_customer = lambda df: df.repartition(tasks, "customer_id") if tasks > FEW_TASKS else df.repartition("customer_id")
    if (most or 0) <= HOT_LINES:
        customers = _customers(to_customer(facts))
    else:
        theirs = F.col("customer_id").eqNullSafe(F.col("hot_id"))
        usual = facts.join(hot, theirs, "left_anti")
        many = facts.join(hot, theirs, "left_semi")
        customers = _customers(to_customer(usual)).unionByName(_customers(many))
    return (
        _with_recency(customers, as_of)
        .withColumn("days_span", F.datediff("last_order", "first_order").cast("long"))
        .withColumn("avg_order_value", F.try_divide("monetary", "frequency"))
        .withColumn("avg_profit", F.try_divide("total_profit", "frequency"))
        .select(*FEATURE_COLUMNS)
    )


def _customers(facts: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    place = ["state", "region", "segment"]

    def keyed(kind: int, column: str | None) -> Column:
        value = none if column is None else F.col(column).cast("string")
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), *[(F.col(c) if column is None else none).alias(c) for c in place])

    kinds = [keyed(ORDERS, "order_id"), keyed(PRODUCTS, "product_id"), keyed(CATEGORIES, "category"), keyed(SUB_CATEGORIES, "sub_category"), keyed(PLACES, None)]
    lines = facts.select("customer_id", "order_date", "sales", "quantity", "profit", F.explode(F.array(*kinds)).alias("x"))
    of_order = lambda c: F.sum(F.when(F.col("x.kind") == ORDERS, F.col(c))).alias(c)
    keys = lines.groupBy("customer_id", "x.kind", "x.value", *[f"x.{c}" for c in place]).agg(
        F.min(F.when(F.col("x.kind").isin(ORDERS, PLACES), F.col("order_date"))).alias("since"),
        F.max(F.when(F.col("x.kind") == ORDERS, F.col("order_date"))).alias("until"), of_order("sales"), of_order("quantity"), of_order("profit"),
    )
    distinct = lambda kind: F.count(F.when(F.col("kind") == kind, F.col("value")))
    first = lambda c: F.min_by(c, F.when((F.col("kind") == PLACES) & F.col(c).isNotNull(), F.struct("since", c))).alias(c)
    return keys.groupBy("customer_id").agg(
        F.max("until").alias("last_order"), F.min("since").alias("first_order"), distinct(ORDERS).alias("frequency"),
        F.sum("sales").alias("monetary"), distinct(PRODUCTS).alias("unique_products"), distinct(CATEGORIES).alias("unique_categories"),
        distinct(SUB_CATEGORIES).alias("unique_sub_categories"), F.sum("quantity").alias("total_items"), F.sum("profit").alias("total_profit"),
        first("state"), first("region"), first("segment"),
    )
