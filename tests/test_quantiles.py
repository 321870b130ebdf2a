"""Exact quantiles: many narrowing passes, and a bound on what one task ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.functions import quantiles

PROBS = [0.0, 0.25, 0.5, 0.999, 1.0]


@pytest.fixture(scope="module")
def million(spark):
    """Equal-width values, values over many magnitudes, and a column that is nearly all one value; a hot group."""
    return spark.range(1_000_000, numPartitions=8).select(
        ((F.col("id") * 7919) % 1_000_000).cast("double").alias("even"), F.exp(F.randn(3) * 20).alias("wide"),
        F.when(F.col("id") % 50 == 0, F.col("id").cast("double")).otherwise(5.0).alias("copies"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).cast("double").alias("holes"),
        F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("g"),
    ).persist()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_narrowed_quantiles_are_exact(million, by):
    columns = ["even", "wide", "copies", "holes"]
    found = quantiles.exact_quantiles(million, columns, PROBS, by, accuracy=200, bracket_rows=500).collect()
    data = million.toPandas()
    assert len(found) == len(columns) * len(PROBS) * (2 if by else 1)
    for r in found:
        part = data[data.g == r["g"]] if by else data
        v = part[r["feature"]].dropna()
        assert r["n"] == len(v)
        assert r["value"] == pytest.approx(np.quantile(v, r["prob"]), rel=1e-12, abs=1e-12)


def test_brackets_hold_no_more_than_the_bound(million, monkeypatch):
    seen = []
    plain = quantiles._narrowed

    def spy(brackets, values, by, slack, accuracy, rows):
        out, values = plain(brackets, values, by, slack, accuracy, rows)
        held = values.join(out, by).where("v >= lo AND v <= hi").groupBy("feature", "prob").agg(F.countDistinct("v").alias("n"))
        seen.extend(r["n"] for r in held.collect())
        return out, values

    monkeypatch.setattr(quantiles, "_narrowed", spy)
    quantiles.exact_quantiles(million, ["even", "wide", "copies"], [0.1, 0.5, 0.99], accuracy=200, bracket_rows=500).collect()
    assert len(seen) == 9 and max(seen) <= 500
