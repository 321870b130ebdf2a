"""The composite analyses as queries: facts about their results that hold whatever a fit draws, and that SQL can state."""

from pyspark.sql import functions as F

from cartlens.catalog import tables
from cartlens.catalog.baskets import NAMES, TEMPORAL_SQL
from cartlens.catalog.exchange import STAMP, folder
from cartlens.catalog.registry import KEPT_SQL, query
from cartlens.operators import cluster_quality as cq
from cartlens.operators import clustering
from cartlens.operators.scaling import prepare_clustering
from cartlens.plans.pipelines import mine_baskets, run_all
from cartlens.session import checkpointed
from cartlens.sources import results


@query(
    "basket_analysis",
    f"""WITH {TEMPORAL_SQL} SELECT (SELECT COUNT(*) FROM lines) AS n_lines, (SELECT COUNT(*) FROM sets) AS n_itemsets,
    (SELECT COUNT(*) FROM rules) AS n_rules, (SELECT COUNT(*) FROM monthly) AS n_rule_months,
    (SELECT COUNT(DISTINCT STRFTIME(order_date, '%Y-%m')) FROM clean) AS n_months, FALSE AS retried,
    (SELECT COUNT(DISTINCT p) FROM (SELECT UNNEST(antecedents) AS p FROM rules)) AS n_products""",
)
def basket_analysis(spark, sf_dir):
    """Everything that the basket pipeline bundles, counted."""
    item, support, confidence = NAMES
    found = mine_baskets(tables.clean(spark, sf_dir), item, min_support=support, min_confidence=confidence)
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return spark.range(1).select(
        count(found.lines).alias("n_lines"), count(found.mined.itemsets).alias("n_itemsets"), count(found.rules).alias("n_rules"),
        count(found.monthly).alias("n_rule_months"), count(found.trend).alias("n_months"), F.lit(found.mined.retried).alias("retried"),
        count(found.recommendations.select("product").distinct()).alias("n_products"),
    )


@query(
    "complete_analysis",
    f"""WITH {KEPT_SQL} SELECT COUNT(*) AS n_customers, CAST(9 AS BIGINT) AS n_ks, COUNT(*) AS n_written, COUNT(*) AS n_in_personas, COUNT(*) AS n_in_segments,
    CAST(0 AS BIGINT) AS n_not_at_nearest, TRUE AS scores_in_range, TRUE AS spread_agrees, TRUE AS one_row_per_cluster, TRUE AS shares_add_up FROM z""",
)
def complete_analysis(spark, sf_dir):
    """Segmentation, baskets, report and export with their defaults, read back and held against each other."""
    base = folder(spark)
    done = run_all(tables.facts(spark, sf_dir), *NAMES[1:], base=base, run_ts=STAMP)
    found = done.segmentation
    written = {kind: results.read_latest(spark, base, kind) for kind in results.KINDS}
    kept, z = prepare_clustering(found.rfm)
    labelled = checkpointed(clustering.as_points(z).join(found.customers.select(F.col("customer_id").alias("point_id"), "cluster"), "point_id"))
    # Centres in scaled units are the means of the labelled points, up to the tolerance at which the fit stops.
    means = [r["center"] for r in cq.centroids(labelled).orderBy("cluster").collect()]
    gap = lambda c: cq.squared_distance(F.col("features"), F.array(*[F.lit(float(v)) for v in c]))
    own = F.element_at(F.array(*[gap(c) for c in means]), F.col("cluster") + 1)
    best = F.least(*[gap(c) for c in means])
    misplaced = labelled.agg(F.count_if(F.sqrt(own) > F.sqrt(best) + 0.05).alias("n")).scalar()
    reported = found.metrics.where(F.col("k") == found.k).select("wcss").scalar()
    spread = cq.wcss(labelled).select("wcss").scalar()
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    total = lambda df, c: df.agg(F.sum(c).cast("long").alias("n")).scalar()
    performance = written["segment_performance"]
    return spark.range(1).select(
        count(found.customers).alias("n_customers"), count(found.metrics).alias("n_ks"), count(written["customer_segments"]).alias("n_written"),
        total(found.personas, "size").alias("n_in_personas"), total(performance, "customer_count").alias("n_in_segments"),
        misplaced.alias("n_not_at_nearest"),
        found.metrics.agg(F.bool_and(F.col("silhouette").between(-1, 1) & (F.col("davies_bouldin") >= 0)).alias("ok")).scalar().alias("scores_in_range"),
        (F.abs(spread - reported) < 1e-3 * reported).alias("spread_agrees"),
        ((count(written["cluster_centers"]) == found.k) & (count(performance) == found.k)).alias("one_row_per_cluster"),
        performance.agg((F.abs(F.sum("revenue_share") - 100) < 1e-6).alias("ok")).scalar().alias("shares_add_up"),
    )
