"""The registered report runs the whole segmentation."""

import inspect

import pytest

from cartlens.catalog import business
from cartlens.plans.pipelines import segment_customers


class Called(Exception):
    pass


def test_report_sweeps_all_k_and_compares_methods(spark, monkeypatch):
    def spy(*args, **kwargs):
        bound = inspect.signature(segment_customers).bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(business, "segment_customers", spy)
    with pytest.raises(Called) as caught:
        business.report(spark, "/root/testdata/sf0.001")
    given = caught.value.args[0]
    assert (given["max_k"], given["restarts"], given["compare"]) == (10, 10, True)


def test_figures_of_customers_and_segments_share_their_features(spark, monkeypatch):
    """The summary needs the customers twice; their features are computed once."""
    from cartlens.catalog import business, tables

    seen, features = [], tables.rfm_features
    monkeypatch.setattr(tables, "rfm_features", lambda lines: seen.append(1) or features(lines))
    assert business.summary_report_numbers(spark, "/root/testdata/sf0.001").count() == 1
    assert len(seen) == 1


def test_orders_are_rows_before_they_are_counted(spark):
    """Lines of one order become one row before distinct values are counted; lines without an order keep their sums."""
    from cartlens.operators.business import segment_performance

    lines = spark.createDataFrame(
        [("c1", "o1", 10.0, 1.0, "x", "r"), ("c1", "o1", 20.0, 2.0, "y", "r"), ("c2", "o1", 5.0, 0.0, "y", "s"), ("c2", None, 7.0, 1.0, "y", "s")],
        "customer_id string, order_id string, sales double, profit double, category string, region string",
    )
    labels = spark.createDataFrame([("c1", 0), ("c2", 0)], "customer_id string, cluster int")
    found = segment_performance(lines, labels, spark.createDataFrame([(0, "At Risk")], "cluster int, name string"))
    row = found.head()
    assert (row.customer_count, row.total_revenue, row.avg_order_value, row.orders_per_customer) == (2, 42.0, 35.0, 2.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = [part.split("Join")[0] for part in plan.split("Expand")[1:]]
    assert below and all("Aggregate [cluster" in part for part in below)
