"""Outlier bounds, outlier removal and population-std scaling of the customer features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.quantiles import exact_quantiles, quantile_name, quantile_table
from cartlens.operators.features import CLUSTERING_FEATURES

FENCE = 1.5


def select_features(rfm: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    return rfm.select("customer_id", *features)


def iqr_bounds(rfm: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    """Per feature: both quartiles, their distance and the two fences."""
    quartiles = (
        exact_quantiles(rfm, features, [0.25, 0.75])
        .groupBy("feature")
        .agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
            F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
        )
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    )
    return quartiles.select(
        "feature", "q1", "q3", "iqr",
        (F.col("q1") - FENCE * F.col("iqr")).alias("lower_bound"),
        (F.col("q3") + FENCE * F.col("iqr")).alias("upper_bound"),
    )


def iqr_outlier_filter(rfm: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    """Customers with every feature inside its fences; a NULL feature does not disqualify.

    The fences are fitted first (two numbers per feature) and enter the filter as literals, so the
    filter itself is one narrow pass.
    """
    table = quantile_table(rfm, features, [0.25, 0.75]).head()
    keep = F.lit(True)
    for c in features:
        q1, q3 = table[quantile_name(c, 0.25)], table[quantile_name(c, 0.75)]
        if q1 is None:
            continue
        outside = (F.col(c) < q1 - FENCE * (q3 - q1)) | (F.col(c) > q3 + FENCE * (q3 - q1))
        keep = keep & ~F.coalesce(outside, F.lit(False))
    return rfm.filter(keep)


def outlier_stats(rfm: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    kept = iqr_outlier_filter(rfm, features).agg(F.count(F.lit(1)).alias("k")).scalar()
    return (
        rfm.agg(F.count(F.lit(1)).alias("customers_before"))
        .withColumn("customers_after", kept)
        .withColumn("removed", F.col("customers_before") - F.col("customers_after"))
        .withColumn("removed_pct", F.try_divide(F.col("removed") * 100.0, F.col("customers_before")))
    )


def scaling_stats(rfm: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    """Per feature: mean and population standard deviation (one row per feature)."""
    stats = rfm.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")
                )
                for c in features
            ]
        ).alias("s")
    )
    return stats.select(F.explode("s").alias("s")).select("s.*")


def standardize(rfm: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    """``rfm`` with each feature as a population z-score; a constant feature becomes 0.

    Mean and deviation are fitted in one aggregate and enter the projection as literals.
    """
    stats = rfm.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in features], *[F.stddev_pop(c).alias(f"{c}_std") for c in features]
    ).head()
    scaled = {}
    for c in features:
        mean, std = stats[f"{c}_mean"], stats[f"{c}_std"]
        constant = std is None or std <= 1e-12 * abs(mean)
        z = F.lit(0.0) if constant else (F.col(c) - F.lit(mean)) / F.lit(std)
        scaled[c] = F.when(F.col(c).isNotNull(), z)
    return rfm.withColumns(scaled)


def prepare_clustering(
    rfm: DataFrame, remove_outliers: bool = True, features: Sequence[str] = CLUSTERING_FEATURES
) -> tuple[DataFrame, DataFrame]:
    """(kept customers, the same customers with a ``features`` array of z-scores)."""
    kept = iqr_outlier_filter(rfm, features) if remove_outliers else rfm
    return kept, with_feature_array(standardize(kept, features), features)


def with_feature_array(df: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    return df.withColumn("features", F.array(*[F.col(c).cast("double") for c in features]))
