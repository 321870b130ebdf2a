"""The typed result store: every kind by its schema, the newest run from the file list, lines that do not fit."""

import pytest

from cartlens.sources import results


def test_every_kind_has_its_types(spark, tmp_path):
    for kind in results.KINDS:
        types = results.typed_columns(kind)
        rows = spark.createDataFrame([tuple({"string": "x", "double": 0.5}.get(t, 3) for t in types.values())], results.SCHEMAS[kind])
        if kind == "association_rules":
            rows = rows.selectExpr("array('b', 'a') AS antecedents", "array('c') AS consequents", *list(types)[2:])
        for stamp in ("20240101_000000", "20250812_103316"):
            results.write_result(rows.withColumn(list(types)[-1], rows[list(types)[-1]]), str(tmp_path), kind, stamp, "csv")
        back = results.read_latest(spark, str(tmp_path), kind, "csv")
        assert [(f.name, f.dataType.simpleString().replace("bigint", "long")) for f in back.schema][: len(types)] == list(types.items())
        assert [(r["run_ts"], r[results.REJECTED]) for r in back.collect()] == [("20250812_103316", None)]


def test_lines_that_do_not_fit_are_kept(spark, tmp_path):
    (tmp_path / "rules.csv").write_text(
        "consequents,antecedents,conviction,lift,note\nc,a,inf,2.5,x\nc,b,many,1.5,y\nc,d,-inf,nan,z\n", encoding="utf-8"
    )
    got = {r["antecedents"]: r for r in results.read_results_csv(spark, str(tmp_path / "rules.csv"), "association_rules").collect()}
    assert got["a"]["conviction"] == float("inf") and got["a"]["rejected"] is None and got["a"]["note"] == "x"
    assert got["b"]["conviction"] is None and got["b"]["lift"] == 1.5 and got["b"]["rejected"] == "c,b,many,1.5,y"
    assert got["d"]["conviction"] == float("-inf") and got["d"]["lift"] != got["d"]["lift"]


def test_a_store_without_runs(spark, tmp_path):
    empty = spark.createDataFrame([], results.SCHEMAS["cluster_centers"])
    results.write_cluster_centers(empty, str(tmp_path), "20250812_103316")
    with pytest.raises(Exception):  # noqa: B017
        results.read_latest(spark, str(tmp_path), "association_rules")
