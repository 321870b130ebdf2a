"""Segment KPI, strategy, ROI and snapshot queries, on the labels by segment rank."""

from pyspark.sql import functions as F

from cartlens.catalog import tables
from cartlens.catalog.baskets import LIFT, NAMES, mined, rules_sql
from cartlens.catalog.clusters import NAMES_SQL
from cartlens.catalog.registry import query, rounded
from cartlens.operators import business as biz
from cartlens.operators import personas
from cartlens.plans.pipelines import business_report, mine_baskets, segment_customers
from cartlens.sources import results
from cartlens.sources.facts import star_facts

PERFORMANCE_SQL = f"""{NAMES_SQL},
fl AS (SELECT c.*, l.cluster FROM clean c JOIN labelled l USING (customer_id)),
ord AS (SELECT cluster, order_id, SUM(sales) AS s FROM fl GROUP BY 1, 2),
aov AS (SELECT cluster, AVG(s) AS aov FROM ord GROUP BY 1),
cm AS (SELECT cluster, category FROM fl GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY COUNT(*) DESC, category) = 1),
rm AS (SELECT cluster, region FROM fl GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY COUNT(*) DESC, region) = 1),
tot AS (SELECT cluster, COUNT(DISTINCT customer_id) AS customer_count, SUM(sales) AS total_revenue, SUM(profit) AS total_profit,
  COUNT(*) AS n_lines FROM fl GROUP BY 1),
perf AS (SELECT cluster, n.name AS segment, customer_count, total_revenue, total_profit, aov AS avg_order_value,
    n_lines / customer_count AS orders_per_customer,
    CASE WHEN total_revenue > 0 THEN total_profit / total_revenue ELSE 0 END AS profit_margin,
    total_revenue / customer_count AS revenue_per_customer, category AS primary_category, region AS primary_region,
    total_revenue * 100 / SUM(total_revenue) OVER () AS revenue_share,
    customer_count * 100.0 / SUM(customer_count) OVER () AS customer_share
  FROM tot JOIN aov USING (cluster) JOIN cm USING (cluster) JOIN rm USING (cluster) JOIN (SELECT cluster, name FROM named) n USING (cluster))"""

_STRATEGY_ROWS = ", ".join(
    "('{segment}', '{focus}', '{t}', '{k}', {b})".format(
        t="; ".join(s["tactics"]).replace("'", "''"), k="; ".join(s["kpis"]).replace("'", "''"), b=float(s["budget"].rstrip("%")) / 100, **{x: s[x] for x in ("segment", "focus")}
    )
    for s in biz.STRATEGIES
)
_RATE_ROWS = ", ".join(f"('{n}', {lift}, {keep})" for n, lift, keep in biz.RATES)
ROI_SQL = f"""{PERFORMANCE_SQL},
strat AS (SELECT * FROM (VALUES {_STRATEGY_ROWS}) AS t(segment, focus, tactics, kpis, budget_share)),
rate AS (SELECT * FROM (VALUES {_RATE_ROWS}) AS t(segment, revenue_lift, retention_improvement)),
roi AS (SELECT cluster, segment, total_revenue AS current_revenue, total_revenue * revenue_lift AS projected_increase,
    (SELECT SUM(total_revenue) FROM perf) * 0.05 * budget_share AS marketing_budget,
    total_revenue * revenue_lift / ((SELECT SUM(total_revenue) FROM perf) * 0.05 * budget_share) AS roi,
    customer_count AS customers, retention_improvement, focus
  FROM perf JOIN rate USING (segment) JOIN strat USING (segment)),
total AS (SELECT SUM(projected_increase) AS inc, SUM(marketing_budget) AS bud FROM roi)"""


def performance(spark, sf_dir, customers=None):
    customers = tables.labelled(spark, sf_dir) if customers is None else customers
    return tables.reused(
        biz.segment_performance(tables.clean(spark, sf_dir), customers, personas.personas(customers))
    )


PERF_DIGITS = {
    "total_revenue": 1, "total_profit": 1, "avg_order_value": 4, "orders_per_customer": 6, "profit_margin": 8,
    "revenue_per_customer": 4, "revenue_share": 6, "customer_share": 6,
}


def _perf_cols(*names):
    return ", ".join(f"ROUND({n}, {PERF_DIGITS[n]}) AS {n}" if n in PERF_DIGITS else n for n in names)


PERF_COLUMNS = [
    "cluster", "segment", "customer_count", "total_revenue", "total_profit", "avg_order_value",
    "orders_per_customer", "profit_margin", "revenue_per_customer", "primary_category", "primary_region",
    "revenue_share", "customer_share",
]


@query("segment_performance", f"WITH {PERFORMANCE_SQL} SELECT {_perf_cols(*PERF_COLUMNS)} FROM perf")
def segment_performance(spark, sf_dir):
    return rounded(performance(spark, sf_dir), **PERF_DIGITS)


@query(
    "facts_with_cluster",
    f"WITH {PERFORMANCE_SQL} SELECT cluster, category, COUNT(*) AS n_lines, ROUND(SUM(sales), 1) AS sales FROM fl GROUP BY 1, 2",
)
def facts_with_cluster(spark, sf_dir):
    lines = biz.facts_with_cluster(tables.clean(spark, sf_dir), tables.labelled(spark, sf_dir))
    out = lines.groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("sales").alias("sales"))
    return rounded(out, sales=1)


_PREVIEW = ["cluster", "segment", "customer_count", "total_revenue", "total_profit", "avg_order_value", "revenue_share"]


@query("segment_preview", f"WITH {PERFORMANCE_SQL} SELECT {_perf_cols(*_PREVIEW)} FROM perf")
def segment_preview(spark, sf_dir):
    out = biz.segment_preview(performance(spark, sf_dir))
    return rounded(out, **{k: v for k, v in PERF_DIGITS.items() if k in _PREVIEW})


@query(
    "format_segments",
    f"""WITH {PERFORMANCE_SQL} SELECT cluster, segment, format('{{:,}}', customer_count) AS customers,
    format('${{:,.0f}}', total_revenue) AS revenue, format('${{:,.0f}}', avg_order_value) AS avg_order_value,
    printf('%.1f%%', revenue_share) AS revenue_share FROM perf""",
)
def format_segments(spark, sf_dir):
    return biz.format_segments(performance(spark, sf_dir))


_POINTS = ["segment", "customer_count", "revenue_per_customer", "total_revenue"]


@query("segment_value_points", f"WITH {PERFORMANCE_SQL} SELECT {_perf_cols(*_POINTS)} FROM perf")
def segment_value_points(spark, sf_dir):
    return rounded(performance(spark, sf_dir).select(*_POINTS), revenue_per_customer=4, total_revenue=1)


@query("revenue_by_segment_chart", f"WITH {PERFORMANCE_SQL} SELECT {_perf_cols('segment', 'total_revenue')} FROM perf")
def revenue_by_segment_chart(spark, sf_dir):
    return rounded(performance(spark, sf_dir).select("segment", "total_revenue"), total_revenue=1)


@query(
    "executive_summary",
    f"""WITH {rules_sql(*NAMES)}, o AS (SELECT order_id, SUM(sales) AS s FROM clean GROUP BY 1)
    SELECT ROUND(SUM(sales), 1) AS total_revenue, ROUND(SUM(profit), 1) AS total_profit,
      COUNT(DISTINCT order_id) AS total_orders, ROUND((SELECT AVG(s) FROM o), 4) AS avg_order_value,
      ROUND(SUM(profit) / SUM(sales), 8) AS profit_margin, COUNT(DISTINCT customer_id) AS total_customers,
      COUNT(DISTINCT segment) AS n_segments, (SELECT COUNT(*) FROM rules) AS n_rules,
      (SELECT COUNT(*) FROM rules WHERE lift > {LIFT}) AS high_impact_rules FROM clean""",
)
def executive_summary(spark, sf_dir):
    customers = tables.labelled(spark, sf_dir)
    out = biz.executive_summary(
        tables.clean(spark, sf_dir), customers, customers.select("cluster").distinct().count(),
        mined(spark, sf_dir, NAMES).rules, LIFT,
    )
    return rounded(out, total_revenue=1, total_profit=1, avg_order_value=4, profit_margin=8)


@query(
    "strategies",
    f"""WITH {ROI_SQL} SELECT p.cluster, p.segment, p.customer_count, ROUND(p.total_revenue, 1) AS total_revenue,
    ROUND(p.revenue_per_customer, 4) AS revenue_per_customer, s.focus, tactics, kpis,
    ROUND(budget_share, 4) AS budget_share FROM perf p JOIN strat s USING (segment)""",
)
def strategies(spark, sf_dir):
    out = biz.strategies(performance(spark, sf_dir)).select(
        "cluster", "segment", "customer_count", "total_revenue", "revenue_per_customer", "focus",
        F.array_join("tactics", "; ").alias("tactics"), F.array_join("kpis", "; ").alias("kpis"), "budget_share",
    )
    return rounded(out, total_revenue=1, revenue_per_customer=4, budget_share=4)


_ROI_DIGITS = {"current_revenue": 1, "projected_increase": 1, "marketing_budget": 1, "roi": 6}


@query(
    "roi_projection",
    f"""WITH {ROI_SQL} SELECT cluster, segment, ROUND(current_revenue, 1) AS current_revenue,
    ROUND(projected_increase, 1) AS projected_increase, ROUND(marketing_budget, 1) AS marketing_budget, ROUND(roi, 6) AS roi,
    customers, focus FROM roi""",
)
def roi_projection(spark, sf_dir):
    out = biz.roi_projection(performance(spark, sf_dir)).drop("retention_improvement")
    return rounded(out, **_ROI_DIGITS)


@query("retention_rates", f"WITH {ROI_SQL} SELECT cluster, segment, ROUND(retention_improvement, 4) AS retention_improvement FROM roi")
def retention_rates(spark, sf_dir):
    out = biz.roi_projection(performance(spark, sf_dir)).select("cluster", "segment", "retention_improvement")
    return rounded(out, retention_improvement=4)


@query("roi_chart", f"WITH {ROI_SQL} SELECT segment, ROUND(roi, 6) AS roi FROM roi")
def roi_chart(spark, sf_dir):
    return rounded(biz.roi_projection(performance(spark, sf_dir)).select("segment", "roi"), roi=6)


@query(
    "format_roi",
    f"""WITH {ROI_SQL} SELECT cluster, segment, format('${{:,.0f}}', current_revenue) AS current_revenue,
    format('${{:,.0f}}', projected_increase) AS projected_increase, format('${{:,.0f}}', marketing_budget) AS marketing_budget,
    printf('%.1fx', roi) AS roi FROM roi""",
)
def format_roi(spark, sf_dir):
    return biz.format_roi(biz.roi_projection(performance(spark, sf_dir)))


@query(
    "roi_overall",
    f"""WITH {ROI_SQL} SELECT ROUND(inc, 1) AS total_increase, ROUND(bud, 1) AS total_budget, ROUND(inc / bud, 6) AS overall_roi,
    ROUND(inc / (SELECT SUM(total_revenue) FROM perf), 8) AS growth_rate FROM total""",
)
def roi_overall(spark, sf_dir):
    perf = performance(spark, sf_dir)
    out = biz.roi_overall(biz.roi_projection(perf), perf)
    return rounded(out, total_increase=1, total_budget=1, overall_roi=6, growth_rate=8)


@query("priority_segments", f"WITH {ROI_SQL} SELECT cluster, segment, ROUND(roi, 6) AS roi, focus FROM roi ORDER BY roi.roi DESC, cluster LIMIT 3")
def priority_segments(spark, sf_dir):
    return rounded(biz.priority_segments(biz.roi_projection(performance(spark, sf_dir))), roi=6)


@query(
    "summary_report_numbers",
    f"""WITH {ROI_SQL} SELECT ROUND(inc, 1) AS revenue_opportunity, ROUND(inc / bud, 6) AS overall_roi,
    ROUND(inc / (SELECT SUM(sales) FROM clean), 8) AS growth_rate, (SELECT COUNT(*) FROM labelled) AS total_customers,
    (SELECT COUNT(*) FROM named) AS n_segments,
    (SELECT COUNT(*) FROM named WHERE name LIKE '%Champion%' OR name LIKE '%Loyal%') AS high_value_segments FROM total""",
)
def summary_report_numbers(spark, sf_dir):
    customers = tables.labelled(spark, sf_dir)
    perf = performance(spark, sf_dir, customers)
    projection = biz.roi_projection(perf)
    out = biz.summary_report(
        tables.clean(spark, sf_dir), customers, personas.personas(customers), projection,
        biz.roi_overall(projection, perf),
    )
    return rounded(out, revenue_opportunity=1, overall_roi=6, growth_rate=8)


# File names of exports made from the orders: one snapshot per kind and order date, some without a time.
_KIND = "['customer_segments', 'association_rules', 'segment_performance', 'cluster_centers', 'other_table']"
NAMES_OF_FILES_SQL = f"""files AS (SELECT DISTINCT ({_KIND})[CAST(o_orderkey % 5 AS INT) + 1] || '_' ||
  CASE WHEN o_orderkey % 7 = 0 THEN 'latest' ELSE STRFTIME(o_orderdate, '%Y%m%d') || '_103316' END || '.csv' AS filename FROM orders)"""
_STAMP_SQL = """CASE WHEN regexp_matches(filename, '\\d{8}_\\d{6}')
  THEN STRFTIME(STRPTIME(regexp_extract(filename, '(\\d{8}_\\d{6})', 1), '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') ELSE 'Unknown' END"""
_TITLE_SQL = """CASE kind WHEN 'customer_segments' THEN 'Customer Segments' WHEN 'association_rules' THEN 'Association Rules'
  WHEN 'segment_performance' THEN 'Segment Performance' ELSE 'Cluster Centers' END"""


def file_names(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kinds = F.array(*[F.lit(k) for k in [*results.KINDS, "other_table"]])
    stamp = F.when(F.col("o_orderkey") % 7 == 0, "latest").otherwise(
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_103316"))
    )
    kind = F.get(kinds, (F.col("o_orderkey") % 5).cast("int"))
    return orders.select(F.concat(kind, F.lit("_"), stamp, F.lit(".csv")).alias("filename")).distinct()


@query(
    "latest_snapshot",
    f"""WITH {NAMES_OF_FILES_SQL},
    k AS (SELECT regexp_extract(filename, '^(customer_segments|association_rules|segment_performance|cluster_centers)_.*\\.csv$', 1) AS kind, filename FROM files),
    m AS (SELECT kind, MAX(filename) AS filename FROM k WHERE kind <> '' GROUP BY kind)
    SELECT kind, {_TITLE_SQL} AS file_type, filename, {_STAMP_SQL} AS timestamp FROM m""",
)
def latest_snapshot(spark, sf_dir):
    return results.latest_snapshots(file_names(spark, sf_dir))


@query("snapshot_timestamp", f"WITH {NAMES_OF_FILES_SQL} SELECT filename, {_STAMP_SQL} AS timestamp FROM files")
def snapshot_timestamp(spark, sf_dir):
    files = file_names(spark, sf_dir).withColumn("kind", results.snapshot_kind(F.col("filename")))
    return results.snapshot_timestamps(files).select("filename", "timestamp")


@query("business_report")
def report(spark, sf_dir):
    """The three analyses end to end; the ROI rows are what comes out last."""
    segmentation = segment_customers(star_facts(spark, sf_dir))
    found = mine_baskets(segmentation.clean, "sub_category", min_support=0.01, min_confidence=0.1)
    return business_report(segmentation.clean, segmentation.customers, segmentation.personas, found.rules).projection
