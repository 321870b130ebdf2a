import pytest
from pyspark.sql import functions as F

from cartlens.functions.quantiles import exact_quantiles
from cartlens.operators import overview, quality
from cartlens.operators.features import rfm_features
from cartlens.operators.scaling import iqr_outlier_filter, standardize
from cartlens.sources import results
from cartlens.sources.facts import clean_facts, fact_schema, read_fact_csv, validate_columns

HEADER = "Order ID,Order Date,Customer ID,Segment,State,Region,Product ID,Category,Sub-Category,Product Name,Sales,Quantity,Profit"
ROWS = [
    'O1,1/5/2020, C1 ,Consumer,Texas,South,P1,Tech,Phones,"Phone, café",100.0,2,10.0',
    "O1,1/5/2020,C1,Consumer,Texas,South,P2,Tech,Cables,Cable,20.0,1,5.0",
    "O2,3/1/2020,C1,Consumer,Ohio,East,P1,Tech,Phones,Phone,50.0,1,-4.0",
    "O3,2/1/2020,C2,Corporate,Ohio,East,P3,Office,Paper,Paper,30.0,3,3.0",
    "O4,2/2/2020,C2,Corporate,Ohio,East,P3,Office,Paper,Paper,-5.0,1,0.0",
    "O5,2/3/2020,,Corporate,Ohio,East,P3,Office,Paper,Paper,5.0,1,",
]


@pytest.fixture
def facts(spark, tmp_path):
    path = tmp_path / "facts.csv"
    path.write_bytes("\n".join([HEADER, *ROWS]).encode("latin-1"))
    return read_fact_csv(spark, str(path))


def test_csv_is_typed_and_reordered(facts):
    assert [f.dataType for f in facts.schema] == [f.dataType for f in fact_schema()]
    assert facts.filter(F.col("product_name") == "Phone, café").count() == 1
    assert facts.filter("profit is null").count() == 1


def test_missing_columns_are_listed(facts):
    with pytest.raises(ValueError, match="sub_category"):
        validate_columns(facts.drop("sub_category"))
    assert validate_columns(facts) is facts


def test_features_of_a_small_table(facts):
    rows = {r.customer_id: r for r in rfm_features(clean_facts(facts)).collect()}
    one = rows["C1"]
    assert (one.recency, one.frequency, one.monetary, one.days_span) == (1, 2, 170.0, 56)
    assert (one.unique_products, one.unique_categories, one.unique_sub_categories) == (2, 1, 2)
    assert (one.state, one.region, one.segment) == ("Texas", "South", "Consumer")
    assert (one.avg_order_value, one.total_items, one.total_profit, one.avg_profit) == (85.0, 4.0, 11.0, 5.5)
    assert rows["C2"].frequency == 1 and rows["C2"].recency == 30


def test_missing_and_imputation(facts):
    found = {r.column_name: r.missing_count for r in quality.missing_summary(facts).collect()}
    assert found == {"customer_id": 1, "profit": 1}
    filled = quality.impute_mode(quality.impute_mean(facts))
    assert quality.remaining_missing(filled).head().missing_values == 0
    assert filled.filter("order_id = 'O5'").head().profit == pytest.approx(14.0 / 5)


def test_mode_takes_smallest_on_ties_and_falls_back(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "x string, y string")
    filled = quality.impute_mode(df).collect()
    assert sorted(r.x for r in filled) == ["a", "a", "b"]
    assert {r.y for r in filled} == {"Unknown"}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (2, float("nan")), (3, 1.0)], "a int, b double")
    row = quality.duplicate_stats(df).head()
    assert (row.n_rows, row.unique_rows, row.duplicate_rows) == (5, 3, 2)


def test_quantiles_equal_the_built_in(spark):
    """Skewed values, a third of them equal, nulls, and more rows than a bracket needs to bite."""
    df = spark.range(0, 60000, 1, 7).select(
        F.when(F.rand(1) < 0.34, 5.0).when(F.rand(2) < 0.1, None).otherwise(F.rand(3) * F.rand(4) * 100).alias("v"),
        F.pmod("id", F.lit(2)).alias("g"),
    ).persist()
    probs = [0.0, 0.25, 0.3333, 0.5, 0.95, 1.0]
    want = df.selectExpr(f"percentile(v, array({', '.join(map(str, probs))}))").head()[0]
    got = {r.prob: r.value for r in exact_quantiles(df, ["v"], probs).collect()}
    assert [got[p] for p in probs] == pytest.approx(want)
    by = {(r.g, r.prob): r.value for r in exact_quantiles(df, ["v"], probs, ["g"]).collect()}
    for row in df.groupBy("g").agg(F.expr(f"percentile(v, array({', '.join(map(str, probs))}))").alias("p")).collect():
        assert [by[row.g, p] for p in probs] == pytest.approx(row.p)


def test_scaling_and_fences(spark):
    rows = [(f"c{i}", float(i % 10), 3.0) for i in range(40)] + [("far", 1000.0, 3.0), ("gap", None, 3.0)]
    df = spark.createDataFrame(rows, "customer_id string, a double, b double")
    kept = iqr_outlier_filter(df, ["a", "b"])
    assert kept.filter("customer_id = 'far'").isEmpty()
    assert not kept.filter("customer_id = 'gap'").isEmpty()
    z = standardize(kept, ["a", "b"]).agg(F.avg("a"), F.stddev_pop("a"), F.max(F.abs("b"))).head()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1) and z[2] == 0


def test_histogram_keeps_every_row(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"), F.lit(7.0).alias("same"))
    rows = overview.histogram(df, ["x", "same"], 10).collect()
    assert sum(r.n for r in rows if r.feature == "x") == 101
    assert max(r.bin for r in rows if r.feature == "x") == 9
    assert [(r.bin, r.n) for r in rows if r.feature == "same"] == [(0, 101)]


def test_result_tables_round_trip(spark, tmp_path):
    rules = spark.createDataFrame(
        [(["b", "a"], ["c"], float("inf"), 0.5)], "antecedents array<string>, consequents array<string>, conviction double, support double"
    )
    base = str(tmp_path / "out")
    for stamp in ["20250101_000000", "20250812_103316"]:
        results.write_rules(rules.withColumn("support", F.lit(float(stamp[:8]))), base, stamp)
    latest = results.read_latest(spark, base, "association_rules").collect()
    assert len(latest) == 1 and latest[0].support == 20250812.0 and latest[0].antecedents == ["b", "a"]
    text = str(tmp_path / "csv")
    results.write_rules(rules, text, "20250812_103316", "csv")
    back = results.read_latest(spark, text, "association_rules", "csv").head()
    assert back.antecedents == "a, b" and back.conviction == float("inf")
    with pytest.raises(ValueError, match="unknown"):
        results.write_result(rules, base, "nothing", "x")


def test_old_style_export_files(spark, tmp_path):
    for name in ["customer_segments_20240101_000000", "customer_segments_20250812_103316", "cluster_centers_latest", "notes"]:
        (tmp_path / f"{name}.csv").write_text("a,b\n1,inf\n")
    found = {r.kind: r for r in results.latest_snapshots(results.list_snapshots(spark, str(tmp_path))).collect()}
    assert found["customer_segments"].timestamp == "2025-08-12 10:33:16"
    assert found["customer_segments"].file_type == "Customer Segments"
    assert found["cluster_centers"].timestamp == "Unknown"
    assert set(found) == {"customer_segments", "cluster_centers"}
    row = results.read_results_csv(spark, str(tmp_path / "notes.csv")).head()
    assert row.b == float("inf")
