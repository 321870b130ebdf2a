"""The driver contract, and a sample of the registered queries against their SQL."""

import pytest

import __spark_entry__ as contract
from cartlens.operators.features import FEATURE_COLUMNS
from cartlens.plans.pipelines import run_all
from cartlens.sources.facts import star_facts
from cartlens.sources.results import KINDS, read_latest
from tools.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "column_profile", "missing_summary", "numeric_describe", "rfm_features", "iqr_bounds", "boxplot_stats", "wcss",
    "association_rules", "temporal_confidence", "cross_category_rules", "segment_performance", "roi_overall",
    "latest_snapshot", "dbscan", "pca_2d", "ward_spread", "read_results_association_rules", "basket_analysis", "complete_analysis",
]


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == FEATURE_COLUMNS
    assert out.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    df = contract.queries()[name](spark, SF)
    assert compare(df.collect(), df.columns, connect(SF), contract.oracle_sql()[name]) is None


def test_everything_end_to_end(spark, tmp_path):
    base = str(tmp_path / "results")
    done = run_all(
        star_facts(spark, SF), 0.02, 0.1, base, "20250101_000000", item_col="category", max_k=3, restarts=1, compare=False
    )
    n = done.segmentation.customers.count()
    assert read_latest(spark, base, "customer_segments").count() == n
    assert sum(r.customer_count for r in done.business.performance.collect()) == n
    for kind in KINDS:
        assert not read_latest(spark, base, kind).isEmpty()
