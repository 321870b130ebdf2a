"""The composite analyses: segmentation, baskets, business report, and all three with export."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.operators import baskets, business, clustering, personas, rules as rl
from cartlens.operators.cluster_quality import choose_k
from cartlens.operators.features import rfm_features
from cartlens.operators.scaling import prepare_clustering, scaling_stats
from cartlens.session import reused
from cartlens.sources import results
from cartlens.sources.facts import clean_facts


@dataclass
class Segmentation:
    clean: DataFrame
    rfm: DataFrame
    customers: DataFrame
    metrics: DataFrame
    k: int
    centers: DataFrame
    personas: DataFrame
    components: clustering.Components
    comparison: clustering.MethodComparison | None


def segment_customers(
    facts: DataFrame,
    max_k: int = 10,
    remove_outliers: bool = True,
    seed: int = clustering.SEED,
    restarts: int = clustering.RESTARTS,
    compare: bool = True,
    as_of: date | None = None,
) -> Segmentation:
    """Clean, build features, choose k, fit, name. The fit of the chosen k is the sweep's, not a new one."""
    clean = clean_facts(facts)
    rfm = reused(rfm_features(clean, as_of))
    kept, z = prepare_clustering(rfm, remove_outliers)
    z = reused(z)
    points = clustering.as_points(z)
    metrics, fits = clustering.kmeans_sweep(points, max_k, restarts, seed)
    k = int(choose_k(metrics).head().recommended_k)
    centers = clustering.ordered_centers(fits[k].model)
    customers = reused(clustering.label_customers(z, kept, centers))
    scaled = clustering.centers_table(facts.sparkSession, centers)
    return Segmentation(
        clean, rfm, customers, metrics, k,
        clustering.unscale_centers(scaled, reused(scaling_stats(kept))),
        reused(personas.personas(customers)),
        clustering.pca_2d(points),
        clustering.method_comparison(points, k, seed=seed) if compare else None,
    )


@dataclass
class BasketAnalysis:
    lines: DataFrame
    mined: baskets.Mined
    stats: DataFrame
    recommendations: DataFrame
    monthly: DataFrame
    trend: DataFrame
    cross_selling: DataFrame
    cross_sell_report: DataFrame

    @property
    def rules(self) -> DataFrame:
        return self.mined.rules


def mine_baskets(
    clean: DataFrame,
    item_col: str = "product_name",
    min_orders: int = baskets.MIN_ORDERS,
    min_support: float = baskets.MIN_SUPPORT,
    min_confidence: float = baskets.MIN_CONFIDENCE,
) -> BasketAnalysis:
    """Baskets, itemsets, rules and everything read off them. No rules means empty tables, not an error."""
    items = reused(baskets.basket_items(clean, item_col))
    lines = baskets.multi_item_lines(items, min_orders)
    mined = baskets.mine_with_retry(lines, min_support, min_confidence)
    categories = rl.rule_categories(mined.rules, rl.product_category_map(clean, item_col))
    return BasketAnalysis(
        lines, mined, baskets.basket_stats(items, min_orders), rl.recommend(mined.rules),
        rl.temporal_confidence(mined.rules, clean, item_col), rl.monthly_trend(clean),
        rl.cross_category_rules(categories), rl.cross_sell_report(mined.rules, clean),
    )


@dataclass
class BusinessReport:
    executive: DataFrame
    performance: DataFrame
    strategies: DataFrame
    projection: DataFrame
    overall: DataFrame
    priorities: DataFrame
    summary: DataFrame


def business_report(clean: DataFrame, customers: DataFrame, names: DataFrame, rules: DataFrame) -> BusinessReport:
    performance = reused(business.segment_performance(clean, customers, names))
    projection = business.roi_projection(performance)
    overall = business.roi_overall(projection, performance)
    return BusinessReport(
        business.executive_summary(clean, customers, names.count(), rules),
        performance,
        business.strategies(performance),
        projection,
        overall,
        business.priority_segments(projection),
        business.summary_report(clean, customers, names, projection, overall),
    )


def write_results(base: str, run_ts: str, segmentation: Segmentation, basket: BasketAnalysis, report: BusinessReport, fmt: str = "parquet") -> None:
    """The four result tables of a run. An empty rule table is not written."""
    results.write_customer_segments(segmentation.customers, base, run_ts, fmt)
    if not basket.rules.isEmpty():
        results.write_rules(basket.rules, base, run_ts, fmt)
    results.write_segment_performance(report.performance, base, run_ts, fmt)
    results.write_cluster_centers(segmentation.centers, base, run_ts, fmt)


@dataclass
class CompleteAnalysis:
    segmentation: Segmentation
    baskets: BasketAnalysis
    business: BusinessReport


def run_all(
    facts: DataFrame,
    min_support: float = baskets.MIN_SUPPORT,
    min_confidence: float = baskets.MIN_CONFIDENCE,
    base: str | None = None,
    run_ts: str | None = None,
    item_col: str = "product_name",
    **segmentation_options,
) -> CompleteAnalysis:
    """All three analyses, with export when ``base`` is given. A failing phase raises."""
    segmentation = segment_customers(facts, **segmentation_options)
    basket = mine_baskets(segmentation.clean, item_col, min_support=min_support, min_confidence=min_confidence)
    report = business_report(segmentation.clean, segmentation.customers, segmentation.personas, basket.rules)
    if base:
        stamp = run_ts or facts.sparkSession.range(1).select(F.date_format(F.now(), results.STAMP_FORMAT)).head()[0]
        write_results(base, stamp, segmentation, basket, report)
    return CompleteAnalysis(segmentation, basket, report)
