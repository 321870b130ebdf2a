"""The Merkle manifest against a list-based tree, its tiers, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cartlens.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def way(levels, at, start, arity):
    """(siblings, what ``start`` folds to) from place ``at`` of the lowest level."""
    siblings = []
    for level in levels[:-1]:
        first = at - at % arity
        run = level[first : first + arity]
        siblings += run[: at - first] + run[at - first + 1 :]
        run[at - first] = start
        start, at = h(*run), at // arity
    return siblings, start


def brute(rows, arity=2):
    groups, out = {}, []
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        changed = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            changed = h(*map(field, (doc_id, source, lang, n_chars if n_chars is None else n_chars + 1, text)))
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, changed))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels_of([r[2] for r in sorted(groups[g])], arity) for g in names]
    top = levels_of([t[-1][0] for t in trees], arity)
    for place, g in enumerate(names):
        for at, (known, doc_id, leaf, changed) in enumerate(sorted(groups[g])):
            below, folded = way(trees[place], at, changed, arity)
            above, folded = way(top, place, folded, arity)
            root = top[-1][0]
            out.append((doc_id if known else None, leaf, trees[place][-1][0], root, h(*below, *above), folded, folded == root))
    return sorted(out, key=str)


def given(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    odd = [
        (None, None, None, None, None), (None, None, None, None, None), (7, "", "", "", 0), (7, "", "", "", 0), (8, "x" * 200_000, "zz", "s", None),
        (9, "ä €", "Ω", "s:1", -5), (10, "a", None, None, 2**63 - 1), (11, "a", "é", None, 3), (11, "b", "é", None, 3),
    ]
    return rows + odd


def query(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, COLUMNS) if isinstance(rows, list) else rows
    df.coalesce(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.document_manifest(spark, str(tmp_path)).collect()), key=str)


def test_manifest_equals_brute_force(spark, tmp_path):
    rows = given(spark)
    found = query(spark, rows, tmp_path)
    assert found == brute(rows)
    tampered = {r[0] for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert {r[0] for r in found if not r[6]} == tampered


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_several_tiers_and_arities(spark, tmp_path, monkeypatch, arity):
    """Blocks of two levels: the largest group takes several tiers, last runs are incomplete at several levels."""
    monkeypatch.setattr(merkle, "TIER_LEVELS", 2)
    monkeypatch.setattr(merkle, "ARITY", arity)
    rows = [(n, f"t{n}", f"l{n % 7}" if n % 3 else "hot", None, n) for n in range(211)]
    assert query(spark, rows, tmp_path) == brute(rows, arity)


def test_no_rows_and_one_row(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
    assert query(spark, [(5, "a", "en", "s", 1)], tmp_path) == brute([(5, "a", "en", "s", 1)])


def test_clashing_columns(spark, tmp_path):
    rows = given(spark)[:40]
    df = spark.createDataFrame(rows, COLUMNS)
    for c in ("digest", "at", "n", "_group", "root", "block", "top"):
        df = df.withColumn(c, F.lit("x"))
    assert query(spark, df, tmp_path) == brute(rows)


def test_sql_states_the_same(spark, tmp_path):
    rows = [r for r in given(spark) if r[4] != 2**63 - 1]
    found = query(spark, rows, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(merkle.SQL).fetchall(), key=str) == found
