"""Source, sink and label-scale queries: tables are written out whole, read back, and compared."""

import uuid

from pyspark.sql import functions as F

from cartlens.catalog import tables
from cartlens.catalog.baskets import CATEGORIES, METRICS_SQL, mined, rule_rows, rules_sql, texted
from cartlens.catalog.business import PERF_COLUMNS, PERF_DIGITS, PERFORMANCE_SQL, _perf_cols, performance
from cartlens.catalog.clusters import LABELLED_SQL
from cartlens.catalog.features import DIGITS, _cols
from cartlens.catalog.registry import FACTS_SQL, FEATURES, query, rounded
from cartlens.functions.exprs import lift_band, lift_label3, lift_label4
from cartlens.operators import clustering
from cartlens.operators.features import FEATURE_COLUMNS
from cartlens.session import ensure_checkpoint_dir
from cartlens.sources import results
from cartlens.sources.facts import CSV_HEADINGS, read_fact_csv

STAMP = "20250812_103316"


def folder(spark) -> str:
    """A new folder beside the checkpoints, where every executor can write and read."""
    return f"{ensure_checkpoint_dir(spark)}/exchange/{uuid.uuid4().hex}"


@query(
    "read_fact_csv",
    f"""WITH {FACTS_SQL} SELECT customer_id, order_id, CAST(order_date AS VARCHAR) AS order_date, product_id, product_name,
    category, sub_category, state, region, segment, ROUND(quantity, 4) AS quantity, ROUND(sales, 4) AS sales,
    ROUND(profit, 4) AS profit FROM facts""",
)
def fact_csv(spark, sf_dir):
    path = folder(spark)
    lines = tables.facts(spark, sf_dir).withColumn("order_date", F.date_format("order_date", "M/d/yyyy"))
    text = lines.select(*[F.col(name).alias(heading) for heading, name in CSV_HEADINGS.items()])
    text.write.options(header=True, encoding="ISO-8859-1").csv(path)
    back = read_fact_csv(spark, path).withColumn("order_date", F.col("order_date").cast("string"))
    return rounded(back, quantity=4, sales=4, profit=4)


@query("write_customer_segments", f"WITH {LABELLED_SQL} SELECT {_cols(*FEATURE_COLUMNS)}, cluster FROM labelled")
def write_customer_segments(spark, sf_dir):
    base = folder(spark)
    results.write_customer_segments(tables.labelled(spark, sf_dir), base, STAMP)
    return rounded(results.read_latest(spark, base, "customer_segments").drop("run_ts"), **DIGITS)


RULES = f"WITH {rules_sql(*CATEGORIES)} {METRICS_SQL}"


@query("write_rules", RULES)
def write_rules(spark, sf_dir):
    base = folder(spark)
    results.write_rules(mined(spark, sf_dir, CATEGORIES).rules, base, STAMP)
    return rule_rows(texted(results.read_latest(spark, base, "association_rules").drop("run_ts")))


def _read_query(kind, sql, write, table, shape):
    @query(f"read_results_{kind}", sql)
    def run(spark, sf_dir):
        """Written as text in two runs and read back: the newer one, every column, no line rejected."""
        base = folder(spark)
        rows = table(spark, sf_dir)
        write(rows.limit(1), base, "20240101_000000", "csv")
        write(rows, base, STAMP, "csv")
        back = results.read_latest(spark, base, kind, "csv")
        return shape(back.where(F.col(results.REJECTED).isNull()).drop("run_ts", results.REJECTED))


_read_query(
    "association_rules", RULES, results.write_rules, lambda spark, sf_dir: mined(spark, sf_dir, CATEGORIES).rules, lambda df: rule_rows(df)
)
_read_query(
    "customer_segments", f"WITH {LABELLED_SQL} SELECT {_cols(*FEATURE_COLUMNS)}, cluster FROM labelled", results.write_customer_segments,
    tables.labelled, lambda df: rounded(df, **DIGITS),
)
_read_query(
    "segment_performance", f"WITH {PERFORMANCE_SQL} SELECT {_perf_cols(*PERF_COLUMNS)} FROM perf", results.write_segment_performance,
    performance, lambda df: rounded(df, **PERF_DIGITS),
)


@query("read_results_csv", RULES)
def read_results_csv(spark, sf_dir):
    base = folder(spark)
    results.write_rules(mined(spark, sf_dir, CATEGORIES).rules, base, STAMP, "csv")
    return rule_rows(results.read_results_csv(spark, f"{base}/association_rules", "association_rules").drop("run_ts", results.REJECTED))


@query("write_segment_performance", f"WITH {PERFORMANCE_SQL} SELECT {_perf_cols(*PERF_COLUMNS)} FROM perf")
def write_segment_performance(spark, sf_dir):
    base = folder(spark)
    results.write_segment_performance(performance(spark, sf_dir), base, STAMP)
    return rounded(results.read_latest(spark, base, "segment_performance").drop("run_ts"), **PERF_DIGITS)


_MEANS = ", ".join(f"ROUND(AVG({c}), 4) AS {c}" for c in FEATURES)


@query("write_cluster_centers", f"WITH {LABELLED_SQL} SELECT cluster, {_MEANS} FROM labelled GROUP BY cluster")
def write_cluster_centers(spark, sf_dir):
    base = folder(spark)
    results.write_cluster_centers(clustering.cluster_centers(tables.labelled(spark, sf_dir)), base, STAMP)
    out = results.read_latest(spark, base, "cluster_centers").drop("run_ts")
    return rounded(out, **{c: 4 for c in FEATURES})


_read_query(
    "cluster_centers", f"WITH {LABELLED_SQL} SELECT cluster, {_MEANS} FROM labelled GROUP BY cluster", results.write_cluster_centers,
    lambda spark, sf_dir: clustering.cluster_centers(tables.labelled(spark, sf_dir)), lambda df: rounded(df, **{c: 4 for c in FEATURES}),
)


def _scale_query(name, scale, sql):
    @query(
        name,
        f"WITH {FACTS_SQL}, x AS (SELECT quantity / 12 AS lift FROM facts) SELECT {sql} AS label, COUNT(*) AS n FROM x GROUP BY 1",
    )
    def run(spark, sf_dir):
        """The scale over a stand-in lift from 0.08 to 4.2 on every order line."""
        lifts = tables.facts(spark, sf_dir).select((F.col("quantity") / 12).alias("lift"))
        return lifts.groupBy(scale(F.col("lift")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_scale_query(
    "lift_band", lift_band,
    "CASE WHEN lift > 0 AND lift <= 1.5 THEN 'Weak' WHEN lift > 1.5 AND lift <= 2.5 THEN 'Moderate' WHEN lift > 2.5 THEN 'Strong' END",
)
_scale_query(
    "lift_label4", lift_label4,
    "CASE WHEN lift > 3 THEN 'Very Strong' WHEN lift > 2 THEN 'Strong' WHEN lift > 1.5 THEN 'Moderate' ELSE 'Weak' END",
)
_scale_query(
    "lift_label3", lift_label3, "CASE WHEN lift > 2 THEN 'Strong' WHEN lift > 1.5 THEN 'Moderate' ELSE 'Weak' END"
)
