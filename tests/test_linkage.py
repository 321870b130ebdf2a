"""Ward's linkage against merging the cheapest pair again and again, over many blocks and rounds."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.operators import clustering, linkage
from cartlens.session import checkpointed


def table(spark, x, parts=5):
    rows = [(f"{i:04d}", [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "point_id string, features array<double>").repartition(parts)


def greedy(spark, x):
    """Merge the cheapest pair, ties by key, until one cluster is left."""
    ids = [f"{i:04d}" for i in range(len(x))]
    hashes = np.array([r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(F.xxhash64("id")).collect()])
    centers, sizes, names, out = x.astype(float).copy(), np.ones(len(x)), list(range(len(x))), []
    keys = linkage.pair_keys(hashes, hashes)
    while len(names) > 1:
        c, s = centers[names], sizes[names]
        gaps = linkage.distances(c, c)
        costs = linkage.merge_costs(gaps, s, s)
        costs[np.tril_indices(len(names))] = np.inf
        least = costs.min()
        i, j = min(zip(*np.nonzero(costs == least)), key=lambda p: keys[names[p[0]], names[p[1]]])
        a, b = names[i], names[j]
        out.append((ids[b], ids[a], np.sqrt(2 * least), int(sizes[b])))
        centers[a] = (centers[a] * sizes[a] + centers[b] * sizes[b]) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        names.remove(b)
    return out


def partition(merges, ids, k):
    root = {i: i for i in ids}
    for absorbed, into in [m[:2] for m in sorted(merges, key=lambda m: (m[2], m[0]))][: len(ids) - k]:
        root[absorbed] = into

    def find(i):
        return i if root[i] == i else find(root[i])

    ends = sorted({find(i) for i in ids})
    return {i: ends.index(find(i)) for i in ids}


@pytest.mark.parametrize("finish", [60, 2048])
def test_tree_equals_greedy_merging(spark, finish):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (125, 3)) for c in (0, 2, 5, 9)])
    expected = greedy(spark, x)
    tree = checkpointed(linkage.ward_linkage(table(spark, x), block_rows=64, finish_rows=finish))
    got = [tuple(r) for r in tree.collect()]
    assert len(got) == 499
    assert {(m[0], m[1], m[3]) for m in got} == {(m[0], m[1], m[3]) for m in expected}
    assert sorted(m[2] for m in got) == pytest.approx(sorted(m[2] for m in expected))
    ids = [f"{i:04d}" for i in range(len(x))]
    for k in (1, 7):
        labels = {r.point_id: r.cluster for r in linkage.cut(table(spark, x), tree, k).collect()}
        assert labels == partition(expected, ids, k)


def test_copies_and_regular_grids(spark):
    """A third of all points equal, the rest on a grid full of ties: the same tree in any order and layout."""
    x = np.array([(i, j) for i in range(12) for j in range(10)] + [(3.5, 3.5)] * 60, dtype=float)
    one = {tuple(r) for r in linkage.ward_linkage(table(spark, x), block_rows=32, finish_rows=50).collect()}
    two = {tuple(r) for r in linkage.ward_linkage(table(spark, x, 2).orderBy(F.desc("point_id")), block_rows=50, finish_rows=100).collect()}
    assert {m[:2] + m[3:] for m in one} == {m[:2] + m[3:] for m in two} and len(one) == 179
    copies = [m for m in one if m[2] == 0]
    assert len(copies) == 59 and {m[1] for m in copies} == {"0120"}
    assert clustering.hierarchical_clusters(table(spark, x), 5).select("cluster").distinct().count() == 5


def test_few_points(spark):
    assert linkage.ward_linkage(table(spark, np.zeros((0, 2)))).collect() == []
    assert linkage.ward_linkage(table(spark, np.zeros((1, 2)))).collect() == []
    assert [r.cluster for r in linkage.cut(table(spark, np.zeros((1, 2))), linkage.ward_linkage(table(spark, np.zeros((1, 2)))), 1).collect()] == [0]


def test_last_clusters_need_no_matrix():
    """The finishing task holds a few rows of costs at a time, and measures no cluster twice without need."""
    rng = np.random.default_rng(5)
    n = 4000
    tracemalloc.start()
    merges = linkage.merged_locally([f"{i:04d}" for i in range(n)], rng.normal(size=(n, 3)), np.ones(n), rng.integers(-(2**62), 2**62, n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) == n - 1 and merges["absorbed"].is_unique
    assert peak < 4 * n * n


@pytest.mark.parametrize("kind", ["cloud", "grid", "copies"])
def test_cheapest_partner_equals_all_costs(kind):
    """Only the few partners that may be the cheapest are measured; cost, key and position are those of the whole table."""
    rng = np.random.default_rng(11)
    x = {"cloud": rng.normal(size=(300, 6)), "grid": rng.integers(0, 3, (300, 3)).astype(float), "copies": np.ones((300, 2))}[kind]
    tags = np.stack([rng.integers(1, 6, 300), rng.integers(-(2**62), 2**62, 300)], axis=1)
    host = SimpleNamespace(x=x, tags=tags, number=3)
    measured = []
    own = linkage.pair_distances
    linkage.pair_distances = lambda a, b, p, q: measured.append(len(p)) or own(a, b, p, q)
    try:
        found = linkage._cheapest(x, tags, host, True)
    finally:
        linkage.pair_distances = own
    costs = linkage.merge_costs(linkage.distances(x, x), tags[:, 0].astype(float), tags[:, 0].astype(float))
    np.fill_diagonal(costs, np.inf)
    keys = linkage.pair_keys(np.ascontiguousarray(tags[:, 1]), np.ascontiguousarray(tags[:, 1]))
    keys[costs > costs.min(axis=1)[:, None]] = linkage.NONE
    at = keys.argmin(axis=1)
    assert np.array_equal(found["position"], at) and np.array_equal(found["cost"], costs.min(axis=1))
    assert np.array_equal(found["key"], keys[np.arange(300), at]) and (found["block"] == 3).all()
    assert kind == "grid" or sum(measured) < 3 * 300
