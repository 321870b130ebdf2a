"""Customer feature, outlier and scaling queries."""

from pyspark.sql import functions as F

from cartlens.catalog import tables
from cartlens.catalog.registry import FEATURES, KEPT_SQL, RFM_SQL, query, rounded, union_all
from cartlens.operators import features, scaling

RFM = f"WITH {RFM_SQL}"
DIGITS = {"monetary": 4, "avg_order_value": 4, "total_items": 4, "total_profit": 4, "avg_profit": 4}


def _cols(*names: str) -> str:
    return ", ".join(f"ROUND({n}, {DIGITS[n]}) + 0.0 AS {n}" if n in DIGITS else n for n in names)


@query("rfm_base", f"{RFM} SELECT {_cols('customer_id', 'recency', 'frequency', 'monetary')} FROM rfm")
def rfm_base(spark, sf_dir):
    return rounded(features.rfm_base(tables.clean(spark, sf_dir)), monetary=4)


@query("rfm_aov", f"{RFM} SELECT {_cols('customer_id', 'avg_order_value', 'avg_profit')} FROM rfm")
def rfm_aov(spark, sf_dir):
    out = tables.rfm(spark, sf_dir).select("customer_id", "avg_order_value", "avg_profit")
    return rounded(out, avg_order_value=4, avg_profit=4)


@query(
    "customer_diversity",
    f"{RFM} SELECT customer_id, unique_products, unique_categories, unique_sub_categories FROM rfm",
)
def customer_diversity(spark, sf_dir):
    return features.customer_diversity(tables.clean(spark, sf_dir))


@query("customer_geo", f"{RFM} SELECT customer_id, state, region, segment FROM geo")
def customer_geo(spark, sf_dir):
    return features.customer_geo(tables.clean(spark, sf_dir))


@query("customer_days_span", f"{RFM} SELECT customer_id, days_span FROM rfm")
def customer_days_span(spark, sf_dir):
    return features.customer_days_span(tables.clean(spark, sf_dir))


@query("customer_totals", f"{RFM} SELECT {_cols('customer_id', 'total_items', 'total_profit')} FROM rfm")
def customer_totals(spark, sf_dir):
    return rounded(features.customer_totals(tables.clean(spark, sf_dir)), total_items=4, total_profit=4)


@query("rfm_features", f"{RFM} SELECT {_cols(*features.FEATURE_COLUMNS)} FROM rfm")
def rfm_features(spark, sf_dir):
    return rounded(tables.rfm(spark, sf_dir), **DIGITS)


@query("select_features", f"{RFM} SELECT {_cols('customer_id', *FEATURES)} FROM rfm")
def select_features(spark, sf_dir):
    kept = {k: v for k, v in DIGITS.items() if k in FEATURES}
    return rounded(scaling.select_features(tables.customers(spark, sf_dir)), **kept)


_BOUNDS = union_all(
    [
        f"SELECT '{c}' AS feature, ROUND(quantile_cont({c}, 0.25), 4) AS q1, ROUND(quantile_cont({c}, 0.75), 4) AS q3, "
        f"ROUND(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, "
        f"ROUND(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS lower_bound, "
        f"ROUND(quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS upper_bound "
        "FROM rfm"
        for c in FEATURES
    ]
)


@query("iqr_bounds", f"{RFM} {_BOUNDS}")
def iqr_bounds(spark, sf_dir):
    return rounded(scaling.iqr_bounds(tables.customers(spark, sf_dir)), q1=4, q3=4, iqr=4, lower_bound=4, upper_bound=4)


@query("iqr_outlier_filter", f"WITH {KEPT_SQL} SELECT {_cols('customer_id', *FEATURES)} FROM kept")
def iqr_outlier_filter(spark, sf_dir):
    kept = scaling.iqr_outlier_filter(tables.customers(spark, sf_dir)).select("customer_id", *FEATURES)
    return rounded(kept, **{k: v for k, v in DIGITS.items() if k in FEATURES})


@query(
    "outlier_stats",
    f"""WITH {KEPT_SQL}, a AS (SELECT (SELECT COUNT(*) FROM rfm) AS b, (SELECT COUNT(*) FROM kept) AS k)
    SELECT b AS customers_before, k AS customers_after, b - k AS removed,
      ROUND((b - k) * 100.0 / b, 6) AS removed_pct FROM a""",
)
def outlier_stats(spark, sf_dir):
    return rounded(scaling.outlier_stats(tables.customers(spark, sf_dir)), removed_pct=6)


@query(
    "standardize",
    f"WITH {KEPT_SQL} SELECT customer_id, " + ", ".join(f"ROUND({c}, 6) + 0.0 AS {c}" for c in FEATURES) + " FROM z",
)
def standardize(spark, sf_dir):
    kept = scaling.iqr_outlier_filter(tables.customers(spark, sf_dir))
    z = scaling.standardize(kept).select("customer_id", *FEATURES)
    return rounded(z, **{c: 6 for c in FEATURES})


@query(
    "standardize_all",
    f"WITH {RFM_SQL}, s AS (SELECT "
    + ", ".join(f"AVG({c}) AS {c}_m, STDDEV_POP({c}) AS {c}_s" for c in FEATURES)
    + " FROM rfm) SELECT customer_id, "
    + ", ".join(f"ROUND(({c} - {c}_m) / {c}_s, 6) + 0.0 AS {c}" for c in FEATURES)
    + " FROM rfm, s",
)
def standardize_all(spark, sf_dir):
    """Scaling with the outlier step switched off."""
    _, z = scaling.prepare_clustering(tables.customers(spark, sf_dir), remove_outliers=False)
    return rounded(z.select("customer_id", *FEATURES), **{c: 6 for c in FEATURES})


@query(
    "scaling_stats",
    f"WITH {KEPT_SQL} "
    + union_all(
        [
            f"SELECT '{c}' AS feature, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_POP({c}), 4) AS std FROM kept"
            for c in FEATURES
        ]
    ),
)
def scaling_stats(spark, sf_dir):
    kept = scaling.iqr_outlier_filter(tables.customers(spark, sf_dir))
    return rounded(scaling.scaling_stats(kept), mean=4, std=4)
