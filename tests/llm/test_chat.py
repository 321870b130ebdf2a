"""Canonical JSON of calls: one form for equal numbers, strings untouched; null turns and extra columns."""

import json

from cartlens.llm import chat_tools


def arguments(spark, *texts):
    calls = spark.createDataFrame(
        [(1, f"c{n:03}", n, "paint", t) for n, t in enumerate(texts)], "conv_id long, call_id string, turn long, name string, arguments string"
    ).selectExpr("*", "1 AS n_calls", "'x' AS args", "2 AS level")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    return [r["json"] for r in sorted(chat_tools.linked(calls, results).collect(), key=lambda r: r["call_id"])]


def test_equal_numbers_are_written_alike(spark):
    same = [
        ["1e2", "100", "100.0", "1.0E+2", "100.000"], ["0", "-0", "0.0", "-0.0", "0e5"], ["1.5", "1.50", "15e-1", "0.15e1"],
        ["-2.5E1", "-25", "-25.00"], ["1e20", "100000000000000000000"], ["12345678.5", "1.23456785e7"], ["0.00001", "1e-5"],
    ]
    for group in same:
        forms = arguments(spark, *[f'{{"x": {n}, "y": [{n}, {{"z": {n}}}]}}' for n in group])
        bodies = {f.split('"id"')[0] for f in forms}
        assert len(bodies) == 1, (group, bodies)
        assert float(json.loads(forms[0])["arguments"]["x"]) == float(group[0])


def test_large_integers_stay_exact_and_strings_stay_as_they_are(spark):
    big = "12345678901234567890123456789012345678"
    text = 'quote \\" 1.0 back \\\\ 1e2 \\\\\\" 2.50'
    first, second = arguments(spark, f'{{"n": {big}, "m": -{big[:30]}}}', f'{{"s": "{text}", "t": "1.0", "1.0": 1.0, "u": [1e2, "1e2", null, true]}}')
    assert big in first and f"-{big[:30]}" in first
    got = json.loads(second)["arguments"]
    assert got["s"] == json.loads(f'"{text}"') and got["t"] == "1.0" and got["u"] == [100, "1e2", None, True]
    assert '"1.0":1,' in second and '[100,"1e2",null,true]' in second


def test_null_turns(spark):
    turns = spark.createDataFrame(
        [(1, None, "user", "a"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, "user", "c"), (1, None, "assistant", None)],
        "conv_id long, turn long, role string, text string",
    ).selectExpr("*", "'x' AS call_id", "1 AS status")
    got = sorted((r["status"], r["call_id"] or "") for r in chat_tools.linked(*chat_tools.turns_as_calls(turns)).collect())
    assert got == [("linked", "call-1-0"), ("orphan", ""), ("unanswered", ""), ("unanswered", "")]
