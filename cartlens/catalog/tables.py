"""The inputs every registered query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.operators.features import rfm_features
from cartlens.session import reused
from cartlens.sources.facts import clean_facts, star_facts


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_facts(spark, sf_dir)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_facts(facts(spark, sf_dir))


def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm_features(clean(spark, sf_dir))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer features, kept because outlier removal, scaling and clustering read them many times."""
    return reused(rfm(spark, sf_dir))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines with gaps and out-of-range values in fixed places, to exercise the cleaning."""
    line = F.col("line_no")
    return facts(spark, sf_dir).select(
        F.when(line != 6, F.concat(F.lit(" "), F.col("customer_id"), F.lit(" "))).alias("customer_id"),
        "order_id", "line_no", "order_date",
        F.when(line % 5 != 0, F.col("sales") - 1000).alias("sales"),
        F.col("profit"),
        F.when(line % 7 != 0, F.col("quantity") - 5).alias("quantity"),
        "product_id", "product_name",
        F.when(line % 3 != 0, F.col("category")).alias("category"),
        "sub_category", "state", "region",
        F.when(line % 4 != 0, F.col("segment")).alias("segment"),
    )


DIRTY_SQL = """dirty AS (
  SELECT CASE WHEN line_no <> 6 THEN ' ' || customer_id || ' ' END AS customer_id,
    order_id, line_no, order_date,
    CASE WHEN line_no % 5 <> 0 THEN sales - 1000 END AS sales,
    profit,
    CASE WHEN line_no % 7 <> 0 THEN quantity - 5 END AS quantity,
    product_id, product_name,
    CASE WHEN line_no % 3 <> 0 THEN category END AS category,
    sub_category, state, region,
    CASE WHEN line_no % 4 <> 0 THEN segment END AS segment
  FROM facts
)"""


def segment_labels(rfm_df: DataFrame) -> DataFrame:
    """Customers with a label both engines can compute: the rank of their segment name.

    The ranks are numbered on the distinct segment names, a handful of rows.
    """
    names = (
        rfm_df.select("segment").distinct().agg(F.array_sort(F.collect_list("segment")).alias("names")).scalar()
    )
    return rfm_df.withColumn("cluster", (F.array_position(names, F.col("segment")) - 1).cast("int"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_labels(customers(spark, sf_dir))
