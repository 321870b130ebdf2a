"""Segment figures: one pass over the lines, orders shared by customers, gaps in keys and values."""

import contextlib
import io

from cartlens.operators import business


def test_lines_are_read_once_and_counted_right(spark, tmp_path):
    rows = [
        ("a", "o1", 10.0, 1.0, "x", "n"), ("a", "o1", 5.0, 1.0, "y", "n"), ("b", "o1", 1.0, 0.0, "y", None), ("b", None, 4.0, 2.0, None, None),
        ("c", "o2", 7.0, -1.0, None, None), ("c", "o3", 8.0, 1.0, None, None), ("d", "o4", 100.0, 1.0, "x", "n"),
    ]
    path = str(tmp_path / "facts_of_the_test")
    spark.createDataFrame(rows, "customer_id string, order_id string, sales double, profit double, category string, region string").write.parquet(path)
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "customer_id string, cluster int")
    names = spark.createDataFrame([(0, "Champions"), (1, "At Risk")], "cluster int, name string")
    out = business.segment_performance(spark.read.parquet(path), labels, names)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain("formatted")
    assert text.getvalue().count("facts_of_the_test]") == 1
    first, second = out.orderBy("cluster").collect()
    assert (first.customer_count, first.total_revenue, first.total_profit, first.orders_per_customer) == (2, 20.0, 4.0, 2.0)
    assert (first.avg_order_value, first.primary_category, first.primary_region) == (16.0, "y", "n")
    assert (second.customer_count, second.total_revenue, second.avg_order_value) == (1, 15.0, 7.5)
    assert (second.primary_category, second.primary_region) == ("N/A", "N/A")
    assert first.revenue_share + second.revenue_share == 100.0
