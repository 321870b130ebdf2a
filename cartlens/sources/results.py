"""Result tables: export, snapshots, re-reading.

A run writes each table under its own ``run_ts`` partition, so runs never overwrite each other and the latest one is
found from the list of files, without reading any. Every kind has a schema; text exports keep the headings and file
names that existing exports have, and are read with that schema. Lines that do not fit it are kept: their fields are null
as far as they fail, and the line as it is written stands in ``rejected``, null for good lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.functions.exprs import item_text, title_text

# Result kinds, file name and timestamp formats, and headings of the exports.
KINDS = ["customer_segments", "association_rules", "segment_performance", "cluster_centers"]
STAMP_PATTERN = r"(\d{8}_\d{6})"
STAMP_FORMAT = "yyyyMMdd_HHmmss"
HEADINGS = {
    "customer_id": "Customer ID", "recency": "Recency", "frequency": "Frequency", "monetary": "Monetary",
    "avg_order_value": "AvgOrderValue", "unique_products": "UniqueProducts",
    "unique_categories": "UniqueCategories", "unique_sub_categories": "UniqueSubCategories",
    "state": "State", "region": "Region", "segment": "Segment", "days_span": "DaysSpan",
    "total_items": "TotalItems", "total_profit": "TotalProfit", "avg_profit": "AvgProfit", "cluster": "Cluster",
}
# The columns of each kind, as they are written; item sets are text in exports.
_FEATURES = (
    "recency {whole}, frequency {whole}, monetary double, avg_order_value double, unique_products {whole}, unique_categories {whole}"
)
SCHEMAS = {
    "customer_segments": "customer_id string, " + _FEATURES.format(whole="long") + ", unique_sub_categories long, state string, "
    "region string, segment string, days_span long, total_items double, total_profit double, avg_profit double, cluster int",
    "association_rules": "antecedents string, consequents string, antecedent_support double, consequent_support double, "
    "support double, confidence double, lift double, representativity double, leverage double, conviction double, "
    "zhangs_metric double, jaccard double, certainty double, kulczynski double, antecedent_len int, consequent_len int, "
    "support_pct double, confidence_pct double, lift_strength string",
    "segment_performance": "cluster int, segment string, customer_count long, total_revenue double, total_profit double, "
    "avg_order_value double, orders_per_customer double, profit_margin double, revenue_per_customer double, "
    "primary_category string, primary_region string, revenue_share double, customer_share double",
    "cluster_centers": "cluster int, " + _FEATURES.format(whole="double") + ", total_items double, total_profit double",
}
REJECTED = "rejected"
RULE_HEADINGS = {"antecedent_support": "antecedent support", "consequent_support": "consequent support"}
SEGMENT_HEADINGS = {
    "segment": "Segment", "customer_count": "Customer_Count", "total_revenue": "Total_Revenue",
    "total_profit": "Total_Profit", "avg_order_value": "Avg_Order_Value",
    "orders_per_customer": "Orders_Per_Customer", "profit_margin": "Profit_Margin",
    "revenue_per_customer": "Revenue_Per_Customer", "primary_category": "Primary_Category",
    "primary_region": "Primary_Region", "revenue_share": "Revenue_Share", "customer_share": "Customer_Share",
}


def headings(kind: str) -> dict[str, str]:
    if kind == "association_rules":
        return RULE_HEADINGS
    if kind == "segment_performance":
        return SEGMENT_HEADINGS
    return HEADINGS


def rules_flatten(rules: DataFrame) -> DataFrame:
    """Item sets as sorted, comma-separated text, for formats without arrays."""
    return rules.withColumns(
        {"antecedents": item_text(F.col("antecedents")), "consequents": item_text(F.col("consequents"))}
    )


def write_result(df: DataFrame, base: str, kind: str, run_ts: str, fmt: str = "parquet") -> None:
    """Add a run's table to ``base/kind/run_ts=...``; parquet keeps arrays, csv flattens them."""
    if kind not in KINDS:
        raise ValueError(f"unknown result kind: {kind}")
    if fmt == "csv":
        df = rules_flatten(df) if kind == "association_rules" else df
        # In the order of the schema, further columns behind; numbers as text, so that infinity is "inf".
        known = [c for c in typed_columns(kind) if c in df.columns]
        columns = [*known, *[c for c in df.columns if c not in known]]
        df = df.select(*[_exported(df, c).alias(headings(kind).get(c, c)) for c in columns])
    writer = df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts")
    if fmt == "csv":
        writer.option("header", True).csv(f"{base}/{kind}")
    else:
        writer.format(fmt).save(f"{base}/{kind}")


def _exported(df: DataFrame, column: str):
    value = F.col(column)
    if df.schema[column].dataType.typeName() not in ("double", "float"):
        return value
    text = F.when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").when(F.isnan(value), "nan")
    return text.otherwise(value.cast("string"))


def write_customer_segments(df: DataFrame, base: str, run_ts: str, fmt: str = "parquet") -> None:
    write_result(df, base, "customer_segments", run_ts, fmt)


def write_rules(df: DataFrame, base: str, run_ts: str, fmt: str = "parquet") -> None:
    write_result(df, base, "association_rules", run_ts, fmt)


def write_segment_performance(df: DataFrame, base: str, run_ts: str, fmt: str = "parquet") -> None:
    write_result(df, base, "segment_performance", run_ts, fmt)


def write_cluster_centers(df: DataFrame, base: str, run_ts: str, fmt: str = "parquet") -> None:
    write_result(df, base, "cluster_centers", run_ts, fmt)


def download_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def typed_columns(kind: str) -> dict[str, str]:
    """The columns of a kind, in the order in which exports have them, with their types."""
    return dict(field.split() for field in SCHEMAS[kind].split(", "))


def read_latest(spark: SparkSession, base: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """The newest run of a result kind; the partition filter prunes every other run."""
    path = f"{base}/{kind}"
    table = read_results_csv(spark, path, kind) if fmt == "csv" else spark.read.format(fmt).load(path)
    runs = {part for file in table.inputFiles() for part in file.split("/") if part.startswith("run_ts=")}
    return table.withColumn("run_ts", F.col("run_ts").cast("string")).filter(
        F.col("run_ts") == F.lit(max(runs).partition("=")[2] if runs else None)
    )


def read_results_csv(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Exported files under our names, typed as their ``kind`` says, with ``rejected`` for lines that do not fit.

    Columns are found by their headings, of which only the first line is read; headings that the kind does not know are
    text. Without a kind, types are inferred. ``inf`` is a number here: conviction is infinite for certain rules.
    """
    numbers = {"header": True, "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "nan"}
    if kind is None:
        return spark.read.options(inferSchema=True, **numbers).csv(path)
    types = typed_columns(kind)
    ours = {heading: name for name, heading in headings(kind).items()}
    found = [ours.get(c, c) for c in spark.read.options(header=True).csv(path).columns if c != "run_ts"]
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in found)
    options = {**numbers, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED}
    return spark.read.schema(f"{schema}, {REJECTED} string").options(**options).csv(path)


def list_snapshots(spark: SparkSession, directory: str) -> DataFrame:
    """Names of the exported result files of a folder. Only the listing is read, no file content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("filename"), F.col("path"))


def snapshot_kind(name):
    return F.regexp_extract(name, "^(" + "|".join(KINDS) + r")_.*\.csv$", 1)


def latest_snapshots(files: DataFrame) -> DataFrame:
    """Per result kind the last file name in dictionary order, with title and time."""
    kinds = files.withColumn("kind", snapshot_kind(F.col("filename"))).filter("kind <> ''")
    return snapshot_timestamps(kinds.groupBy("kind").agg(F.max("filename").alias("filename")))


def snapshot_timestamps(files: DataFrame) -> DataFrame:
    """Title of the kind and the time in the file name, ``Unknown`` if it holds none."""
    stamp = F.try_to_timestamp(F.regexp_extract("filename", STAMP_PATTERN, 1), F.lit(STAMP_FORMAT))
    return files.select(
        "kind",
        title_text(F.col("kind")).alias("file_type"),
        "filename",
        F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit("Unknown")).alias("timestamp"),
    )
