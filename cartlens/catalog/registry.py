"""Registered queries, each beside the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = steady(sql)
        return fn

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns and turn -0.0 into 0.0, as the SQL beside each query does."""
    return df.withColumns({c: r(F.col(c), d) for c, d in digits.items()})


# Sums of money divided by small counts fall exactly between two roundings, where the last bit of a
# floating sum would decide. Both sides add this share of the last kept digit before rounding.
NUDGE = 0.031


def r(column: Column, digits: int) -> Column:
    return F.round(column.cast("double") + F.lit(NUDGE * 10.0**-digits), digits) + F.lit(0.0)


def steady(sql: str) -> str:
    """The same nudge for every ``ROUND(expression, digits)`` of a SQL text."""
    out, at = [], 0
    while (start := sql.find("ROUND(", at)) >= 0:
        depth, end, comma = 1, start + 6, None
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        inner, digits = steady(sql[start + 6 : comma]), int(sql[comma + 1 : end - 1])
        out += [sql[at:start], f"(ROUND(CAST({inner} AS DOUBLE) + {NUDGE * 10.0 ** -digits:.12f}, {digits}) + 0.0)"]
        at = end
    return "".join([*out, sql[at:]])


# The order-line view, in SQL.
FACTS_SQL = """facts AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS customer_id,
         CAST(o.o_orderkey AS VARCHAR) AS order_id,
         l.l_linenumber AS line_no,
         CAST(o.o_orderdate AS DATE) AS order_date,
         l.l_extendedprice * (1 - l.l_discount) AS sales,
         l.l_extendedprice * (CAST(0.07 AS DOUBLE) - l.l_discount) AS profit,
         l.l_quantity AS quantity,
         CAST(p.p_partkey AS VARCHAR) AS product_id,
         p.p_name AS product_name, p.p_type AS category, p.p_brand AS sub_category,
         n.n_name AS state, r.r_name AS region, c.c_mktsegment AS segment
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

FEATURES = [
    "recency", "frequency", "monetary", "avg_order_value",
    "unique_products", "unique_categories", "total_items", "total_profit",
]

RFM_SQL = FACTS_SQL + """,
clean AS (
  SELECT * REPLACE (TRIM(customer_id) AS customer_id) FROM facts
  WHERE customer_id IS NOT NULL AND quantity > 0 AND sales > 0
),
places AS (
  SELECT customer_id, state, region, segment, MIN(order_date) AS since
  FROM clean GROUP BY ALL
),
geo AS (
  SELECT DISTINCT customer_id,
    FIRST_VALUE(state) OVER (PARTITION BY customer_id ORDER BY since, state) AS state,
    FIRST_VALUE(region) OVER (PARTITION BY customer_id ORDER BY since, region) AS region,
    FIRST_VALUE(segment) OVER (PARTITION BY customer_id ORDER BY since, segment) AS segment
  FROM places
),
measures AS (
  SELECT customer_id,
    CAST((SELECT MAX(order_date) + 1 FROM clean) - MAX(order_date) AS BIGINT) AS recency,
    COUNT(DISTINCT order_id) AS frequency,
    SUM(sales) AS monetary,
    SUM(sales) / COUNT(DISTINCT order_id) AS avg_order_value,
    COUNT(DISTINCT product_id) AS unique_products,
    COUNT(DISTINCT category) AS unique_categories,
    COUNT(DISTINCT sub_category) AS unique_sub_categories,
    CAST(MAX(order_date) - MIN(order_date) AS BIGINT) AS days_span,
    SUM(quantity) AS total_items,
    SUM(profit) AS total_profit,
    SUM(profit) / COUNT(DISTINCT order_id) AS avg_profit
  FROM clean GROUP BY customer_id
),
rfm AS (SELECT m.*, g.state, g.region, g.segment FROM measures m JOIN geo g USING (customer_id))"""


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# Customers inside the fences, and their z-scores.
KEPT_SQL = RFM_SQL + """,
q AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in FEATURES
) + """ FROM rfm),
kept AS (SELECT rfm.* FROM rfm, q WHERE """ + " AND ".join(
    f"{c} BETWEEN {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) AND {c}_q3 + 1.5 * ({c}_q3 - {c}_q1)" for c in FEATURES
) + """),
s AS (SELECT """ + ", ".join(f"AVG({c}) AS {c}_m, STDDEV_POP({c}) AS {c}_s" for c in FEATURES) + """ FROM kept),
z AS (SELECT customer_id, segment AS grp, """ + ", ".join(
    f"CASE WHEN {c}_s > 1e-12 THEN ({c} - {c}_m) / {c}_s ELSE 0 END AS {c}" for c in FEATURES
) + """ FROM kept, s)"""
