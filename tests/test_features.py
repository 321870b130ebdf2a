"""Customer features: one pass over the lines, a hot customer among them, against plain Python."""

import contextlib
import io
from datetime import date, timedelta

from pyspark.sql import functions as F

from cartlens.operators import features
from cartlens.sources.facts import clean_facts, star_facts

DAY = date(2024, 1, 1)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_lines_are_read_once(spark):
    lines = clean_facts(star_facts(spark, "/root/testdata/sf0.001"))
    for build in (features.rfm_features, features.rfm_base):
        assert plan(build(lines, DAY)).count("/lineitem.parquet]") == 1
        # Without a given day, the customers are written down, and the lines are not in the plan at all.
        assert plan(build(lines)).count("/lineitem.parquet]") == 0


def test_features_by_hand(spark):
    """Half of all lines belong to one customer; places, categories and whole columns may be null."""
    rows = []
    for n in range(400):
        customer = "hot" if n % 2 else f"c{n % 9}"
        rows.append((
            customer, f"o{n % 37}" if n % 50 else None, DAY + timedelta(days=n * 7 % 90), float(n % 13), float(n % 5), float(n % 7) - 3, f"p{n % 61}",
            None if customer == "c4" else f"k{n % 4}", f"s{n % 11}", None if n % 3 == 0 else f"state{n % 6}", f"r{n % 2}", f"seg{n % 3}",
        ))
    names = "customer_id order_id order_date sales quantity profit product_id category sub_category state region segment".split()
    kinds = "string string date double double double string string string string string string".split()
    df = spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, kinds))).repartition(5)
    found = {r["customer_id"]: r.asDict() for r in features.rfm_features(df).collect()}
    last = max(r[2] for r in rows)
    assert set(found) == {r[0] for r in rows}
    for customer, got in found.items():
        mine = [dict(zip(names, r)) for r in rows if r[0] == customer]
        orders = len({r["order_id"] for r in mine} - {None})
        first = {
            c: min(((r["order_date"], r[c]) for r in mine if r[c] is not None), default=(None, None))[1] for c in ("state", "region", "segment")
        }
        expected = {
            "customer_id": customer, "recency": (last - max(r["order_date"] for r in mine)).days + 1, "frequency": orders,
            "monetary": sum(r["sales"] for r in mine), "avg_order_value": sum(r["sales"] for r in mine) / orders,
            "unique_products": len({r["product_id"] for r in mine}), "unique_categories": len({r["category"] for r in mine} - {None}),
            "unique_sub_categories": len({r["sub_category"] for r in mine}), **first,
            "days_span": (max(r["order_date"] for r in mine) - min(r["order_date"] for r in mine)).days,
            "total_items": sum(r["quantity"] for r in mine), "total_profit": sum(r["profit"] for r in mine),
            "avg_profit": sum(r["profit"] for r in mine) / orders,
        }
        assert got == expected
    assert features.rfm_features(df.where(F.lit(False))).collect() == []


def _lines(spark):
    rows = [(f"c{n % 7 if n % 2 else 0}" if n % 11 else None, f"o{n % 37}", DAY + timedelta(days=n * 7 % 90), float(n % 13), 1.0, 2.0, f"p{n % 61}", f"k{n % 4}",
             f"s{n % 11}", f"state{n % 6}", "r", "g") for n in range(400)]
    return spark.createDataFrame(
        rows, "customer_id string, order_id string, order_date date, sales double, quantity double, profit double, product_id string, "
        "category string, sub_category string, state string, region string, segment string",
    )


def test_lines_move_once(spark):
    """To their customer; neither of the two aggregates there has a shuffle of its own."""
    assert plan(features.rfm_features(_lines(spark), DAY)).count("\nArguments: hashpartitioning(") == 1


def test_customers_of_many_lines_are_spread(spark, monkeypatch):
    """The customers with more lines than one task should take, a null one among them, have the same figures."""
    usual = features.rfm_features(_lines(spark), DAY).orderBy("customer_id").collect()
    monkeypatch.setattr(features, "HOT_LINES", 35)
    spread = features.rfm_features(_lines(spark), DAY)
    assert plan(spread).count("\nArguments: hashpartitioning(") > 1
    assert spread.orderBy("customer_id").collect() == usual and len(usual) == 8
