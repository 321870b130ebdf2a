"""Profiling, missing values, duplicates and imputation of the order-line table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.quantiles import exact_quantiles
from cartlens.sources.facts import clean_facts

TYPE_NAMES = {
    T.StringType: "text", T.DoubleType: "number", T.FloatType: "number", T.IntegerType: "number",
    T.LongType: "number", T.DateType: "date", T.TimestampType: "date", T.TimestampNTZType: "date",
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: kind, non-null and null count. One aggregate over the table, then one row per column."""
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(TYPE_NAMES.get(type(f.dataType), f.dataType.simpleString())).alias("kind"),
            F.count(f.name).alias("non_null"),
            (F.count(F.lit(1)) - F.count(f.name)).alias("n_null"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns that have nulls, with count and percentage, most first."""
    return (
        column_profile(df)
        .filter("n_null > 0")
        .select(
            "column_name",
            F.col("n_null").alias("missing_count"),
            F.try_divide(F.col("n_null") * 100.0, F.col("n_rows")).alias("missing_percentage"),
        )
        .orderBy(F.desc("missing_count"), "column_name")
    )


def remaining_missing(df: DataFrame) -> DataFrame:
    return column_profile(df).agg(
        F.sum("n_null").alias("missing_values"),
        F.count_if(F.col("n_null") > 0).alias("columns_with_missing"),
    )


def numeric_describe(df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max of the numeric columns, one row each."""
    columns = list(columns or numeric_columns(df))
    moments = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(c).cast("double").alias("min"),
                    F.max(c).cast("double").alias("max"),
                )
                for c in columns
            ]
        ).alias("m")
    ).select(F.explode("m").alias("m")).select("m.*")
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("feature").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
            for p, name in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]
        ]
    )
    out = moments.join(quartiles, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )
    if digits is not None:
        for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]:
            out = out.withColumn(c, F.round(c, digits))
    return out


RFM_DESCRIBED = ["recency", "frequency", "monetary", "avg_order_value", "unique_products", "days_span"]


def rfm_describe(rfm: DataFrame) -> DataFrame:
    return numeric_describe(rfm, RFM_DESCRIBED, digits=2)


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric nulls become the column mean, read as one scalar row."""
    columns = list(columns or numeric_columns(df))
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    marked = df.withColumn("_m", means)
    for c in columns:
        marked = marked.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_m.{c}")))
    return marked.drop("_m")


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column, the smallest on ties.

    Counts are combined per (column, value) before the shuffle and the winner is picked from the
    counts, so no task holds the distinct values of an id-like column in one buffer.
    """
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns])).alias("x")
    ).select("x.*")
    counts = pairs.filter("v is not null").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_name").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None, fallback: str = "Unknown") -> DataFrame:
    """Text nulls become the column's mode, or ``fallback`` for an all-null column."""
    columns = list(columns or text_columns(df))
    modes = (
        column_modes(df, columns)
        .agg(F.struct(*[F.max(F.when(F.col("column_name") == c, F.col("mode"))).alias(c) for c in columns]).alias("m"))
        .scalar()
    )
    marked = df.withColumn("_m", modes)
    for c in columns:
        marked = marked.withColumn(c, F.coalesce(F.col(c), F.col(f"_m.{c}"), F.lit(fallback)))
    return marked.drop("_m")


def duplicate_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each exact duplicate group, their share, and the unique rows."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("unique_rows")
    ).select(
        "n_rows",
        "unique_rows",
        (F.col("n_rows") - F.col("unique_rows")).alias("duplicate_rows"),
        F.try_divide((F.col("n_rows") - F.col("unique_rows")) * 100.0, F.col("n_rows")).alias("duplicate_pct"),
    )


def sample_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def retention_summary(facts: DataFrame) -> DataFrame:
    """Rows before and after cleaning, and the extent of what is left."""
    clean = clean_facts(facts)
    original = facts.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("customer_id").isNull()).alias("no_customer")
        ).alias("o")
    ).scalar()
    return (
        clean.agg(
            F.count(F.lit(1)).alias("clean_rows"),
            F.countDistinct("customer_id").alias("customers"),
            F.countDistinct("product_id").alias("products"),
            F.countDistinct("category").alias("categories"),
            F.countDistinct("segment").alias("segments"),
            F.min("order_date").alias("first_date"),
            F.max("order_date").alias("last_date"),
        )
        .withColumn("_o", original)
        .select(
            F.col("_o.n").alias("original_rows"),
            "clean_rows",
            F.col("_o.no_customer").alias("rows_without_customer"),
            F.try_divide(F.col("clean_rows") * 100.0, F.col("_o.n")).alias("retention_pct"),
            "customers", "products", "categories", "segments", "first_date", "last_date",
        )
    )


def distinct_values(df: DataFrame, columns: Sequence[str] = ("category", "segment")) -> DataFrame:
    """(column_name, value) of every distinct value: a column may have as many as there are rows."""
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    ).select("x.*")
    return pairs.filter("value is not null").distinct()
