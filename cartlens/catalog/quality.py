"""Profiling and cleaning queries."""

from pyspark.sql import functions as F

from cartlens.catalog import tables
from cartlens.catalog.registry import FACTS_SQL, RFM_SQL, query, r, rounded, union_all
from cartlens.catalog.tables import DIRTY_SQL
from cartlens.operators import quality
from cartlens.sources.facts import FACT_COLUMNS, NUMERIC_COLUMNS, TEXT_COLUMNS, clean_facts

DIRTY = f"WITH {FACTS_SQL}, {DIRTY_SQL}"
PROFILED = FACT_COLUMNS
KINDS = {"order_date": "date", **{c: "number" for c in NUMERIC_COLUMNS}, **{c: "text" for c in TEXT_COLUMNS}}


@query("table_shape", f"WITH {FACTS_SQL} SELECT COUNT(*) AS n_rows, CAST(14 AS BIGINT) AS n_columns FROM facts")
def table_shape(spark, sf_dir):
    return quality.table_shape(tables.facts(spark, sf_dir))


_NULLS = union_all(
    [
        f"SELECT '{c}' AS column_name, '{KINDS[c]}' AS kind, COUNT({c}) AS non_null, "
        f"COUNT(*) - COUNT({c}) AS n_null, COUNT(*) AS n_rows FROM dirty"
        for c in PROFILED
    ]
)


@query("column_profile", f"{DIRTY} {_NULLS}")
def column_profile(spark, sf_dir):
    return quality.column_profile(tables.dirty(spark, sf_dir).select(*PROFILED))


@query(
    "missing_summary",
    f"{DIRTY}, p AS ({_NULLS}) SELECT column_name, n_null AS missing_count, "
    "ROUND(n_null * 100.0 / n_rows, 6) AS missing_percentage FROM p WHERE n_null > 0",
)
def missing_summary(spark, sf_dir):
    return rounded(quality.missing_summary(tables.dirty(spark, sf_dir).select(*PROFILED)), missing_percentage=6)


def _describe_sql(source: str, columns: list[str], digits: dict[str, int], default: int) -> str:
    def one(c: str) -> str:
        d = digits.get(c, default)
        parts = [
            ("mean", f"AVG({c})"), ("std", f"STDDEV_SAMP({c})"), ("min", f"MIN({c})"),
            ("q25", f"quantile_cont({c}, 0.25)"), ("q50", f"quantile_cont({c}, 0.5)"),
            ("q75", f"quantile_cont({c}, 0.75)"), ("max", f"MAX({c})"),
        ]
        cols = ", ".join(f'ROUND(CAST({e} AS DOUBLE), {d}) + 0.0 AS "{n}"' for n, e in parts)
        return f"SELECT '{c}' AS feature, COUNT({c}) AS count, {cols} FROM {source}"

    return union_all([one(c) for c in columns])


_STATS = {c: 4 for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]}


@query("numeric_describe", f"{DIRTY} {_describe_sql('dirty', NUMERIC_COLUMNS, {}, 4)}")
def numeric_describe(spark, sf_dir):
    return rounded(quality.numeric_describe(tables.dirty(spark, sf_dir), NUMERIC_COLUMNS), **_STATS)


@query("rfm_describe", f"WITH {RFM_SQL} {_describe_sql('rfm', quality.RFM_DESCRIBED, {}, 2)}")
def rfm_describe(spark, sf_dir):
    return rounded(quality.numeric_describe(tables.customers(spark, sf_dir), quality.RFM_DESCRIBED), **{c: 2 for c in _STATS})


@query(
    "impute_mean",
    f"""{DIRTY}, m AS (SELECT AVG(sales) AS s, AVG(profit) AS p, AVG(quantity) AS q FROM dirty),
    filled AS (SELECT category, COALESCE(sales, s) AS sales, COALESCE(profit, p) AS profit,
      COALESCE(quantity, q) AS quantity FROM dirty, m)
    SELECT category, COUNT(*) AS n, COUNT(sales) AS n_sales, COUNT(quantity) AS n_quantity,
      ROUND(AVG(sales), 4) AS avg_sales, ROUND(AVG(profit), 4) AS avg_profit,
      ROUND(AVG(quantity), 6) AS avg_quantity
    FROM filled GROUP BY category""",
)
def impute_mean(spark, sf_dir):
    filled = quality.impute_mean(tables.dirty(spark, sf_dir), NUMERIC_COLUMNS)
    return filled.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count("sales").alias("n_sales"), F.count("quantity").alias("n_quantity"),
        r(F.avg("sales"), 4).alias("avg_sales"), r(F.avg("profit"), 4).alias("avg_profit"),
        r(F.avg("quantity"), 6).alias("avg_quantity"),
    )


_MODES = ", ".join(
    f"m_{c} AS (SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)" for c in TEXT_COLUMNS
)
_FILLED = ", ".join(f"COALESCE({c}, (SELECT {c} FROM m_{c}), 'Unknown') AS {c}" for c in TEXT_COLUMNS)


@query("impute_mode", f"{DIRTY}, {_MODES} SELECT {_FILLED}, COUNT(*) AS n FROM dirty GROUP BY ALL")
def impute_mode(spark, sf_dir):
    filled = quality.impute_mode(tables.dirty(spark, sf_dir), TEXT_COLUMNS)
    return filled.groupBy(*TEXT_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "remaining_missing",
    f"{DIRTY}, p AS ({_NULLS}) SELECT CAST(SUM(CASE WHEN kind = 'date' THEN n_null ELSE 0 END) AS BIGINT) "
    "AS missing_values, COUNT(*) FILTER (kind = 'date' AND n_null > 0) AS columns_with_missing FROM p",
)
def remaining_missing(spark, sf_dir):
    fact = tables.dirty(spark, sf_dir).select(*PROFILED)
    return quality.remaining_missing(quality.impute_mode(quality.impute_mean(fact, NUMERIC_COLUMNS), TEXT_COLUMNS))


@query(
    "duplicate_stats",
    f"""WITH {FACTS_SQL}, g AS (SELECT *, COUNT(*) AS n FROM facts GROUP BY ALL)
    SELECT CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS unique_rows,
      CAST(SUM(n) - COUNT(*) AS BIGINT) AS duplicate_rows,
      ROUND((SUM(n) - COUNT(*)) * 100.0 / SUM(n), 6) AS duplicate_pct FROM g""",
)
def duplicate_stats(spark, sf_dir):
    return rounded(quality.duplicate_stats(tables.facts(spark, sf_dir)), duplicate_pct=6)


@query(
    "sample_rows",
    f"""WITH {FACTS_SQL} SELECT customer_id, order_id, line_no, product_id, product_name, category, quantity,
      ROUND(sales, 4) AS sales FROM facts
    ORDER BY order_date, order_id, line_no, product_id, quantity, sales LIMIT 10""",
)
def sample_rows(spark, sf_dir):
    rows = quality.sample_rows(
        tables.facts(spark, sf_dir), 10, ["order_date", "order_id", "line_no", "product_id", "quantity", "sales"]
    )
    kept = ["customer_id", "order_id", "line_no", "product_id", "product_name", "category", "quantity", "sales"]
    return rounded(rows.select(*kept), sales=4)


@query(
    "retention_summary",
    f"""{DIRTY}, c AS (SELECT * FROM dirty WHERE customer_id IS NOT NULL AND quantity > 0 AND sales > 0)
    SELECT (SELECT COUNT(*) FROM dirty) AS original_rows, COUNT(*) AS clean_rows,
      (SELECT COUNT(*) FROM dirty WHERE customer_id IS NULL) AS rows_without_customer,
      ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM dirty), 6) AS retention_pct,
      COUNT(DISTINCT TRIM(customer_id)) AS customers, COUNT(DISTINCT product_id) AS products,
      COUNT(DISTINCT category) AS categories, COUNT(DISTINCT segment) AS segments,
      CAST(MIN(order_date) AS VARCHAR) AS first_date, CAST(MAX(order_date) AS VARCHAR) AS last_date FROM c""",
)
def retention_summary(spark, sf_dir):
    out = quality.retention_summary(tables.dirty(spark, sf_dir))
    return rounded(out, retention_pct=6).withColumns(
        {"first_date": F.col("first_date").cast("string"), "last_date": F.col("last_date").cast("string")}
    )


@query(
    "distinct_values",
    f"WITH {FACTS_SQL} " + union_all([f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM facts WHERE {c} IS NOT NULL" for c in TEXT_COLUMNS]),
)
def distinct_values(spark, sf_dir):
    return quality.distinct_values(tables.facts(spark, sf_dir), TEXT_COLUMNS)


_LINES = [c for c in FACT_COLUMNS if c not in ("customer_id", "order_date", *NUMERIC_COLUMNS)]


@query(
    "clean_facts",
    f"""{DIRTY} SELECT TRIM(customer_id) AS customer_id, CAST(order_date AS VARCHAR) AS order_date, {", ".join(_LINES)},
      {", ".join(f"ROUND({c}, 4) AS {c}" for c in NUMERIC_COLUMNS)}
    FROM dirty WHERE customer_id IS NOT NULL AND quantity > 0 AND sales > 0""",
)
def clean(spark, sf_dir):
    lines = clean_facts(tables.dirty(spark, sf_dir)).withColumn("order_date", F.col("order_date").cast("string"))
    return rounded(lines.select("customer_id", "order_date", *_LINES, *NUMERIC_COLUMNS), **{c: 4 for c in NUMERIC_COLUMNS})
