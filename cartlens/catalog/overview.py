"""Dashboard dataset queries over the raw order lines and the customer features."""

from pyspark.sql import functions as F

from cartlens.catalog import tables
from cartlens.catalog.registry import FACTS_SQL, RFM_SQL, query, rounded, union_all
from cartlens.operators import overview

FACTS = f"WITH {FACTS_SQL}"
RFM_CHARTED = ["recency", "frequency", "monetary", "avg_order_value", "unique_products", "days_span"]


@query(
    "kpi_overview",
    f"""{FACTS}, o AS (SELECT order_id, SUM(sales) AS s FROM facts GROUP BY order_id)
    SELECT COUNT(*) AS records, COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT order_id) AS orders,
      COUNT(DISTINCT product_name) AS products, ROUND(SUM(sales), 1) AS total_sales, ROUND(SUM(profit), 1) AS total_profit,
      ROUND((SELECT AVG(s) FROM o), 4) AS avg_order_value,
      ROUND(SUM(profit) * 100.0 / SUM(sales), 6) AS profit_margin_pct FROM facts""",
)
def kpi_overview(spark, sf_dir):
    return rounded(
        overview.kpi_overview(tables.facts(spark, sf_dir)),
        total_sales=1, total_profit=1, avg_order_value=4, profit_margin_pct=6,
    )


def _sales_by(name: str, column: str) -> None:
    sql = (
        f"{FACTS} SELECT {column}, ROUND(SUM(sales), 1) AS total_sales, "
        f"ROUND(SUM(sales) * 100.0 / (SELECT SUM(sales) FROM facts), 6) AS share_pct FROM facts GROUP BY {column}"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        return rounded(overview.sales_by(tables.facts(spark, sf_dir), column), total_sales=1, share_pct=6)


_sales_by("sales_by_category", "category")
_sales_by("sales_by_segment", "segment")
_sales_by("sales_by_region", "region")


@query(
    "monthly_sales",
    f"{FACTS} SELECT STRFTIME(order_date, '%Y-%m') AS month, ROUND(SUM(sales), 2) AS total_sales FROM facts GROUP BY 1",
)
def monthly_sales(spark, sf_dir):
    return rounded(overview.monthly_sales(tables.facts(spark, sf_dir)), total_sales=2)


def histogram_sql(source: str, column: str, bins: int) -> str:
    return (
        f"SELECT '{column}' AS feature, bin, ROUND(lo + bin * w, 4) + 0.0 AS bin_start, "
        f"ROUND(lo + (bin + 1) * w, 4) + 0.0 AS bin_end, COUNT(*) AS n FROM ("
        f"SELECT lo, w, CAST(LEAST(COALESCE(FLOOR(({column} - lo) / NULLIF(w, 0)), 0), {bins - 1}) AS BIGINT) AS bin "
        f"FROM {source}, (SELECT CAST(MIN({column}) AS DOUBLE) AS lo, "
        f"(CAST(MAX({column}) AS DOUBLE) - MIN({column})) / {bins}.0 AS w FROM {source})) GROUP BY bin, lo, w"
    )


@query("histogram_facts", f"{FACTS} " + union_all([histogram_sql("facts", c, 50) for c in ["sales", "profit"]]))
def histogram_facts(spark, sf_dir):
    out = overview.histogram(tables.facts(spark, sf_dir), ["sales", "profit"], 50)
    return rounded(out, bin_start=4, bin_end=4)


@query("histogram_rfm", f"WITH {RFM_SQL} " + union_all([histogram_sql("rfm", c, 50) for c in RFM_CHARTED]))
def histogram_rfm(spark, sf_dir):
    return rounded(overview.histogram(tables.customers(spark, sf_dir), RFM_CHARTED, 50), bin_start=4, bin_end=4)


_BOXED = ["monetary", "frequency", "recency"]


def _box_sql(c: str) -> str:
    return f"""SELECT g.cluster, '{c}' AS feature, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
      ROUND(MIN({c}), 4) AS min, ROUND(MAX({c}), 4) AS max,
      ROUND(MIN({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
      ROUND(MAX({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high, COUNT({c}) AS n
    FROM labelled l JOIN (SELECT cluster, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
      quantile_cont({c}, 0.75) AS q3 FROM labelled GROUP BY cluster) g ON l.cluster = g.cluster
    GROUP BY g.cluster, q1, median, q3"""


@query(
    "boxplot_stats",
    f"WITH {RFM_SQL}, labelled AS (SELECT *, DENSE_RANK() OVER (ORDER BY segment) - 1 AS cluster FROM rfm) "
    + union_all([_box_sql(c) for c in _BOXED]),
)
def boxplot_stats(spark, sf_dir):
    out = overview.boxplot_stats(tables.labelled(spark, sf_dir), _BOXED)
    return rounded(out, q1=4, median=4, q3=4, min=4, max=4, whisker_low=4, whisker_high=4)
