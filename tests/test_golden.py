"""Published result tables, copied as values, against the formulas that must reproduce them."""

import math

import pytest
from pyspark.sql import functions as F

from cartlens.operators import business, personas
from cartlens.operators.baskets import rule_extras, rule_metrics
from cartlens.operators.features import CLUSTERING_FEATURES

# Fixed values. Cluster means of the eight features, clusters 0 to 3.
CENTERS = [
    (64.52688172043011, 5.60752688172043, 1603.0594763440859, 300.7503370903738, 9.951612903225806, 3.0, 36.13440860215054, 136.14439569892474),
    (63.12592592592592, 8.911111111111111, 2964.3689777777777, 338.8085782573887, 18.362962962962964, 3.0, 69.7925925925926, 253.49422),
    (70.64044943820224, 7.078651685393258, 4495.583958426966, 655.5292328941503, 15.112359550561798, 3.0, 59.01123595505618, 805.8321988764044),
    (284.71212121212125, 5.515151515151516, 1871.6129333333333, 356.91570179894177, 10.484848484848484, 3.0, 39.18181818181818, 246.9609393939394),
]
# Fixed values. Segment, customers, revenue, profit, revenue share, customer share, margin, revenue per customer.
SEGMENTS = [
    ("Potential Loyalists", 186, 298169.06260000006, 25322.857600000003, 24.400240695297253, 39.075630252100844, 0.08492785059317552, 1603.0594763440863),
    ("Loyal Customers", 135, 400189.81200000003, 34221.7197, 32.74896346206562, 28.361344537815125, 0.08551372042424708, 2964.368977777778),
    ("Champions", 89, 400106.97229999996, 71719.0657, 32.7421843931659, 18.69747899159664, 0.17924972736097458, 4495.583958426966),
    ("At Risk", 66, 123526.4536, 16299.422, 10.10861144947124, 13.865546218487395, 0.13195086173833134, 1871.6129333333333),
]
# Fixed values. Antecedent, consequent, their supports, support, confidence, lift, representativity, leverage, conviction, Zhang,
# Jaccard, certainty, Kulczynski, lengths, support and confidence in percent, strength.
RULES = [
    ("Staple remover", "Avery Non-Stick Binders", 0.1111111111111111, 0.3333333333333333, 0.1111111111111111, 1.0, 3.0, 1.0, 0.07407407407407407, math.inf, 0.75, 0.3333333333333333, 1.0, 0.6666666666666666, 1, 1, 11.11111111111111, 100.0, "Strong"),
    ("Avery Non-Stick Binders", "Staple remover", 0.3333333333333333, 0.1111111111111111, 0.1111111111111111, 0.3333333333333333, 3.0, 1.0, 0.07407407407407407, 1.333333333333333, 0.9999999999999998, 0.3333333333333333, 0.25, 0.6666666666666666, 1, 1, 11.11111111111111, 33.33333333333333, "Strong"),
    ("Avery Non-Stick Binders", "Staples in misc. colors", 0.3333333333333333, 0.1111111111111111, 0.1111111111111111, 0.3333333333333333, 3.0, 1.0, 0.07407407407407407, 1.333333333333333, 0.9999999999999998, 0.3333333333333333, 0.25, 0.6666666666666666, 1, 1, 11.11111111111111, 33.33333333333333, "Strong"),
    ("Staples in misc. colors", "Avery Non-Stick Binders", 0.1111111111111111, 0.3333333333333333, 0.1111111111111111, 1.0, 3.0, 1.0, 0.07407407407407407, math.inf, 0.75, 0.3333333333333333, 1.0, 0.6666666666666666, 1, 1, 11.11111111111111, 100.0, "Strong"),
    ("Avery Non-Stick Binders", "Storex Dura Pro Binders", 0.3333333333333333, 0.2222222222222222, 0.1111111111111111, 0.3333333333333333, 1.5, 1.0, 0.037037037037037035, 1.1666666666666665, 0.4999999999999999, 0.24999999999999997, 0.14285714285714285, 0.41666666666666663, 1, 1, 11.11111111111111, 33.33333333333333, "Weak"),
    ("Storex Dura Pro Binders", "Avery Non-Stick Binders", 0.2222222222222222, 0.3333333333333333, 0.1111111111111111, 0.5, 1.5, 1.0, 0.037037037037037035, 1.3333333333333335, 0.42857142857142855, 0.24999999999999997, 0.25, 0.41666666666666663, 1, 1, 11.11111111111111, 50.0, "Weak"),
    ("Easy-staple paper", "Staple envelope", 0.2222222222222222, 0.3333333333333333, 0.1111111111111111, 0.5, 1.5, 1.0, 0.037037037037037035, 1.3333333333333335, 0.42857142857142855, 0.24999999999999997, 0.25, 0.41666666666666663, 1, 1, 11.11111111111111, 50.0, "Weak"),
    ("Staple envelope", "Easy-staple paper", 0.3333333333333333, 0.2222222222222222, 0.1111111111111111, 0.3333333333333333, 1.5, 1.0, 0.037037037037037035, 1.1666666666666665, 0.4999999999999999, 0.24999999999999997, 0.14285714285714285, 0.41666666666666663, 1, 1, 11.11111111111111, 33.33333333333333, "Weak"),
    ("Easy-staple paper", "Storex Dura Pro Binders", 0.2222222222222222, 0.2222222222222222, 0.1111111111111111, 0.5, 2.25, 1.0, 0.06172839506172839, 1.5555555555555556, 0.7142857142857143, 0.3333333333333333, 0.35714285714285715, 0.5, 1, 1, 11.11111111111111, 50.0, "Moderate"),
    ("Storex Dura Pro Binders", "Easy-staple paper", 0.2222222222222222, 0.2222222222222222, 0.1111111111111111, 0.5, 2.25, 1.0, 0.06172839506172839, 1.5555555555555556, 0.7142857142857143, 0.3333333333333333, 0.35714285714285715, 0.5, 1, 1, 11.11111111111111, 50.0, "Moderate"),
    ("Staple envelope", "KI Adjustable-Height Table", 0.3333333333333333, 0.3333333333333333, 0.1111111111111111, 0.3333333333333333, 1.0, 1.0, 0.0, 1.0, 0.0, 0.19999999999999998, 0.0, 0.3333333333333333, 1, 1, 11.11111111111111, 33.33333333333333, "Weak"),
    ("KI Adjustable-Height Table", "Staple envelope", 0.3333333333333333, 0.3333333333333333, 0.1111111111111111, 0.3333333333333333, 1.0, 1.0, 0.0, 1.0, 0.0, 0.19999999999999998, 0.0, 0.3333333333333333, 1, 1, 11.11111111111111, 33.33333333333333, "Weak"),
    ("Staples", "KI Adjustable-Height Table", 0.2222222222222222, 0.3333333333333333, 0.2222222222222222, 1.0, 3.0, 1.0, 0.14814814814814814, math.inf, 0.8571428571428571, 0.6666666666666665, 1.0, 0.8333333333333333, 1, 1, 22.22222222222222, 100.0, "Strong"),
    ("KI Adjustable-Height Table", "Staples", 0.3333333333333333, 0.2222222222222222, 0.2222222222222222, 0.6666666666666666, 3.0, 1.0, 0.14814814814814814, 2.333333333333333, 0.9999999999999998, 0.6666666666666665, 0.5714285714285714, 0.8333333333333333, 1, 1, 22.22222222222222, 66.66666666666666, "Strong"),
    ("Logitech 910-002974 M325 Wireless Mouse for Web Scrolling", "Staple envelope", 0.1111111111111111, 0.3333333333333333, 0.1111111111111111, 1.0, 3.0, 1.0, 0.07407407407407407, math.inf, 0.75, 0.3333333333333333, 1.0, 0.6666666666666666, 1, 1, 11.11111111111111, 100.0, "Strong"),
    ("Staple envelope", "Logitech 910-002974 M325 Wireless Mouse for Web Scrolling", 0.3333333333333333, 0.1111111111111111, 0.1111111111111111, 0.3333333333333333, 3.0, 1.0, 0.07407407407407407, 1.333333333333333, 0.9999999999999998, 0.3333333333333333, 0.25, 0.6666666666666666, 1, 1, 11.11111111111111, 33.33333333333333, "Strong"),
]


def test_rule_measures(spark):
    rows = [(i, [r[0]], [r[1]], r[2], r[3], r[4]) for i, r in enumerate(RULES)]
    table = spark.createDataFrame(
        rows,
        "i int, antecedents array<string>, consequents array<string>, antecedent_support double, consequent_support double, support double",
    )
    got = rule_extras(rule_metrics(table)).orderBy("i").collect()
    names = [
        "confidence", "lift", "representativity", "leverage", "conviction", "zhangs_metric", "jaccard", "certainty", "kulczynski",
        "antecedent_len", "consequent_len", "support_pct", "confidence_pct", "lift_strength",
    ]
    assert len(got) == 16
    for row, rule in zip(got, RULES, strict=True):
        for name, value in zip(names, rule[5:], strict=True):
            assert row[name] == (value if isinstance(value, str) else pytest.approx(value, abs=1e-12)), name


def test_persona_ladder(spark):
    schema = "cluster int, size long, " + ", ".join(f"{c} double" for c in CLUSTERING_FEATURES)
    profile = spark.createDataFrame([(i, 1, *c) for i, c in enumerate(CENTERS)], schema)
    names = [r.name for r in personas.persona_name(profile).orderBy("cluster").collect()]
    assert names == [s[0] for s in SEGMENTS]


@pytest.fixture
def performance(spark):
    rows = [(i, s[0], s[1], s[2], s[3]) for i, s in enumerate(SEGMENTS)]
    return spark.createDataFrame(
        rows, "cluster int, segment string, customer_count long, total_revenue double, total_profit double"
    )


def test_segment_shares(spark, performance):
    for row, want in zip(business.with_shares(performance).orderBy("cluster").collect(), SEGMENTS, strict=True):
        assert row.revenue_share == pytest.approx(want[4])
        assert row.customer_share == pytest.approx(want[5])
        assert row.total_profit / row.total_revenue == pytest.approx(want[6])
        assert row.total_revenue / row.customer_count == pytest.approx(want[7])


def test_roi(spark, performance):
    projection = business.roi_projection(performance)
    overall = business.roi_overall(projection, performance).head()
    assert overall.total_increase == pytest.approx(289127.961475)
    assert overall.overall_roi == pytest.approx(6.0667628, abs=1e-6)
    roi = [r.roi for r in projection.orderBy("cluster").collect()]
    assert roi == pytest.approx([11.386779, 5.458161, 3.929062, 5.054306], abs=1e-5)
    first = business.priority_segments(projection).collect()
    assert [r.segment for r in first] == ["Potential Loyalists", "Loyal Customers", "At Risk"]


def test_strategy_catalogue(spark):
    table = business.strategy_dimension(spark)
    assert table.agg(F.sum("budget_share")).head()[0] == pytest.approx(1.0)
    assert table.filter("size(tactics) <> 5 or size(kpis) <> 3").isEmpty()
