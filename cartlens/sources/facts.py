"""Order-line fact table: schema, CSV reader, star-schema view, column validation, cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column headings of the order-line file and the names used here.
CSV_HEADINGS = {
    "Customer ID": "customer_id",
    "Order ID": "order_id",
    "Order Date": "order_date",
    "Sales": "sales",
    "Profit": "profit",
    "Quantity": "quantity",
    "Product ID": "product_id",
    "Product Name": "product_name",
    "Category": "category",
    "Sub-Category": "sub_category",
    "State": "state",
    "Region": "region",
    "Segment": "segment",
}

NUMERIC_COLUMNS = ["sales", "profit", "quantity"]
TEXT_COLUMNS = [
    "customer_id", "order_id", "product_id", "product_name",
    "category", "sub_category", "state", "region", "segment",
]
FACT_COLUMNS = list(CSV_HEADINGS.values())


def fact_schema() -> T.StructType:
    fields = []
    for name in FACT_COLUMNS:
        if name == "order_date":
            fields.append(T.StructField(name, T.DateType()))
        elif name in NUMERIC_COLUMNS:
            fields.append(T.StructField(name, T.DoubleType()))
        else:
            fields.append(T.StructField(name, T.StringType()))
    return T.StructType(fields)


def missing_columns(df: DataFrame, required: Iterable[str] = FACT_COLUMNS) -> list[str]:
    have = set(df.columns)
    return [name for name in required if name not in have]


def validate_columns(df: DataFrame, required: Iterable[str] = FACT_COLUMNS) -> DataFrame:
    """``df`` itself, or an error that lists every required column it lacks."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_fact_csv(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", date_format: str = "M/d/yyyy"
) -> DataFrame:
    """Read an order-line CSV with headings, whatever order its columns come in.

    The header line of one file gives the column order; types come from the fixed schema, so no
    pass over the data is spent on inference. NaN in a number column becomes NULL.
    """
    raw = spark.read.options(header=True, encoding=encoding, quote='"', escape='"').csv(path)
    absent = [h for h in CSV_HEADINGS if h not in raw.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    cols = []
    for heading, name in CSV_HEADINGS.items():
        source = F.col(f"`{heading}`")
        if name == "order_date":
            cols.append(F.to_date(source, date_format).alias(name))
        elif name in NUMERIC_COLUMNS:
            cols.append(null_if_nan(source.cast("double")).alias(name))
        else:
            cols.append(source.alias(name))
    return raw.select(*cols)


def null_if_nan(column):
    return F.nanvl(column, F.lit(None).cast("double"))


def star_facts(spark: SparkSession, directory: str) -> DataFrame:
    """The order-line table as a view over the star-schema parquet tables in ``directory``.

    Plain inner joins: Catalyst broadcasts the small dimensions from their file sizes, shuffles the
    large ones, and adaptive execution splits a hot customer or part.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    lines = table("lineitem")
    orders = table("orders")
    customer = table("customer")
    part = table("part")
    nation = table("nation")
    region = table("region")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    # Orders meet their customers before the lines do, so the lines are not shuffled by customer; they end up by order.
    buyers = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            (price * (1 - discount)).alias("sales"),
            (price * (F.lit(0.07) - discount)).alias("profit"),
            F.col("l_quantity").alias("quantity"),
            F.col("p_partkey").cast("string").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("sub_category"),
            F.col("n_name").alias("state"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


def clean_facts(facts: DataFrame) -> DataFrame:
    """Drop lines without a customer or with a non-positive quantity or amount; trim the customer id."""
    return (
        facts.dropna(subset=["customer_id"])
        .filter((F.col("quantity") > 0) & (F.col("sales") > 0))
        .withColumn("customer_id", F.trim(F.col("customer_id").cast("string")))
        .withColumn("order_date", F.col("order_date").cast("date"))
    )
