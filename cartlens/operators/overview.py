"""Dashboard datasets over the raw order lines: totals, breakdowns, histograms, box plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.exprs import month_key
from cartlens.functions.quantiles import quantile_table


def kpi_overview(facts: DataFrame) -> DataFrame:
    """Headline totals. The mean order value is total sales over the orders that have sales: the same
    as averaging per-order sums, without a second aggregation."""
    return facts.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("customer_id").alias("customers"),
        F.countDistinct("order_id").alias("orders"),
        F.countDistinct("product_name").alias("products"),
        F.sum("sales").alias("total_sales"),
        F.sum("profit").alias("total_profit"),
        F.try_divide(
            F.sum(F.when(F.col("order_id").isNotNull(), F.col("sales"))), F.countDistinct("order_id")
        ).alias("avg_order_value"),
        F.try_divide(F.sum("profit") * 100.0, F.sum("sales")).alias("profit_margin_pct"),
    )


def sales_by(facts: DataFrame, column: str) -> DataFrame:
    """Sales per value of ``column`` and its share; the total is a scalar over the few group rows."""
    groups = facts.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("sales").alias("total_sales"))
    total = groups.agg(F.sum("total_sales")).scalar()
    return groups.withColumn("share_pct", F.try_divide(F.col("total_sales") * 100.0, total))


def monthly_sales(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy(month_key(F.col("order_date")).alias("month"))
        .agg(F.sum("sales").alias("total_sales"))
        .orderBy("month")
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width bins between the column's minimum and maximum, the last one closed; empty bins are
    absent. A constant column is one bin."""
    limits = df.agg(
        F.struct(
            *[
                F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c)
                for c in columns
            ]
        ).alias("l")
    ).scalar()
    marked = df.select(*columns).withColumn("_l", limits)
    pieces = []
    for c in columns:
        lo, hi = F.col(f"_l.{c}.lo"), F.col(f"_l.{c}.hi")
        width = (hi - lo) / F.lit(float(bins))
        slot = F.least(F.floor(F.coalesce(F.try_divide(F.col(c).cast("double") - lo, width), F.lit(0.0))), F.lit(bins - 1))
        pieces.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.when(F.col(c).isNotNull(), slot.cast("long")).alias("bin"),
                lo.alias("lo"),
                width.alias("width"),
            )
        )
    return (
        marked.select(F.explode(F.array(*pieces)).alias("h"))
        .select("h.*")
        .filter("bin is not null")
        .groupBy("feature", "bin", "lo", "width")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "feature", "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            "n",
        )
    )


def boxplot_stats(df: DataFrame, columns: Sequence[str], by: str = "cluster") -> DataFrame:
    """Per group and column: extremes, quartiles and the outermost values within 1.5 IQR of the box."""
    table = quantile_table(df, columns, [0.25, 0.5, 0.75], [by])
    boxes = table.select(
        by,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"{c}_q25").alias("q1"), F.col(f"{c}_q50").alias("median"), F.col(f"{c}_q75").alias("q3"),
                    )
                    for c in columns
                ]
            )
        ).alias("b"),
    ).select(by, "b.*")
    values = df.select(
        by,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("x"),
    ).select(by, "x.*")
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("v") >= F.col("q1") - 1.5 * iqr) & (F.col("v") <= F.col("q3") + 1.5 * iqr)
    return (
        values.join(boxes, [by, "feature"])
        .groupBy(by, "feature", "q1", "median", "q3")
        .agg(
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count("v").alias("n"),
        )
    )
