"""The conversation trie against a dictionary of prefixes, its sketch, and its SQL."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from cartlens.llm import order, trie

COLUMNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    return out


def brute(rows):
    members, ends = {}, {}
    for c, ts in rebuilt(rows).items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(cs) - 1) * words
            leaves[node[:d]] += node not in children
    return sorted(((
        min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children.get(node, 0), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
    ) for node, cs in members.items()), key=str)


def found(spark, rows, columns=COLUMNS):
    df = spark.createDataFrame(rows, columns) if isinstance(rows, list) else rows
    got = trie.trie(trie.with_heads(trie.turn_rows(df)))
    assert got.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    return sorted(map(tuple, got.collect()), key=str)


def talk(c, *texts):
    return [(c, n, "user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(texts)]


ODD = (
    talk(0, "a b", "c", "d e f", "g") + talk(1, "a b", "c", "x") + talk(2, "a b", "c", "x") + talk(3, "a b")
    + talk(20, "hello") + talk(21, "hello", "you", "there") + talk(45, "one") + talk(46, "one", "two", "three", "four")
    + talk(-5, "neg", "a") + talk(-20, "base", "b")
    + [(7, None, None, None), (7, 3, "user", ""), (7, 3, "user", ""), (None, 0, "user", "lost"), (8, 5, "user", " \t\n")]
)


def test_nodes_equal_brute_force(spark):
    assert found(spark, ODD) == brute(ODD)


def test_given_conversations_and_clashing_columns(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, given.selectExpr("*", "1 AS pos", "'x' AS t1", "0 AS words", "2 AS n")) == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_copies_and_long_conversations(spark, monkeypatch):
    """Blocks of eight turns: long conversations are cut, copies share all of it, and the ids of the ends span parts."""
    monkeypatch.setattr(order, "BLOCK", 8)
    long = [f"turn {n}" for n in range(45)]
    rows = [r for c in range(60) for r in talk(c, *long)] + [r for c in range(5000, 6100, 7) for r in talk(c, "same", "pair")]
    rows += talk(9001, *long[:30], "other", *long[:20]) + talk(9002, "z" * 100_000)
    assert found(spark, rows) == brute(rows)


def test_full_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(trie, "_cells", lambda p1, p2, half: np.stack([p1 % 3, p2 % 3 + half]).astype(np.int64))
    assert found(spark, ODD) == brute(ODD)


def test_sketch_never_underestimates(spark, monkeypatch):
    monkeypatch.setattr(trie, "HELD_CELLS", 64)
    values = [(n * 2654435761 % 1000, n * 40503 % 1000) for n in range(400)] + [(-5, -5)] * 3
    bits = trie.sketch(spark.createDataFrame(values, "p1 long, p2 long").repartition(5))
    a = np.array(values, dtype=np.int64)
    cells = trie._cells(a[:, 0].copy(), a[:, 1].copy(), 4 * len(bits))
    several = ((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=0)
    alone = {v for v in values if values.count(v) == 1}
    assert all(s for v, s in zip(values, several) if v not in alone)
    assert sum(not s for v, s in zip(values, several) if v in alone) > 300


def test_clash_of_digests_is_found(spark, monkeypatch):
    """With a digest of two values nodes fall together; the check sees it and draws the digests anew."""
    plain, salts = trie._digests, []

    def weak(rows, salt):
        salts.append(salt)
        got = plain(rows, salt)
        return got.selectExpr(*rows.columns, *[f"{c} % 2 AS {c}" for c in ("p1", "p2", "q1", "q2")]) if len(salts) == 1 else got

    monkeypatch.setattr(trie, "_digests", weak)
    assert found(spark, ODD) == brute(ODD)
    assert salts == [1, 3]


@pytest.mark.parametrize("key", ["k"])
def test_numbering_and_running_sums(spark, monkeypatch, key):
    monkeypatch.setattr(order, "BLOCK", 4)
    df = spark.range(100).selectExpr("id % 3 AS k", "id * 7 % 101 AS v", "id")
    rows = order.numbered(df, [key], ["v", "id"])
    sums = order.running(rows, key, "at", "n", {"total": ("v", "sum"), "mixed": ("v", "bit_xor")}).collect()
    for k in range(3):
        mine = sorted((r["v"], r["id"]) for r in df.where(f"k = {k}").collect())
        total = mixed = 0
        for at, (v, i) in enumerate(mine):
            total, mixed = total + v, mixed ^ v
            assert [(r["total"], r["mixed"], r["n"]) for r in sums if r["k"] == k and r["at"] == at] == [(total, mixed, len(mine))]
