import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartlens.functions import blocks
from cartlens.functions.blocks import distances
from cartlens.operators import cluster_quality as cq
from cartlens.operators import clustering, density


def table(spark, x, labels=None):
    rows = [
        (f"{i:04d}", [float(v) for v in p], int(labels[i]) if labels is not None else 0) for i, p in enumerate(x)
    ]
    return spark.createDataFrame(rows, "point_id string, features array<double>, cluster int").repartition(3)


@pytest.fixture(scope="module")
def cloud():
    """Three groups, scattered noise, and a third of the points exactly equal."""
    rng = np.random.default_rng(0)
    return np.concatenate(
        [
            rng.normal(0, 0.3, (60, 3)), rng.normal(3, 0.4, (60, 3)), rng.normal((0, 5, 0), 0.2, (30, 3)),
            rng.uniform(-3, 7, (40, 3)), np.full((95, 3), 1.5),
        ]
    )


def gaps(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def silhouette_by_hand(x, labels):
    d, out = gaps(x), []
    for i in range(len(x)):
        mine = labels == labels[i]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][mine].sum() / (mine.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_silhouette_over_many_blocks_and_labellings(spark, cloud):
    one = np.arange(len(cloud)) % 4
    two = np.where(np.arange(len(cloud)) == 0, 9, (cloud[:, 0] > 1).astype(int))
    points = table(spark, cloud, one).join(table(spark, cloud, two).select("point_id", F.col("cluster").alias("other")), "point_id")
    got = {r.labelling: r.silhouette for r in cq.silhouette(points, ["cluster", "other"], block_rows=32).collect()}
    assert got["cluster"] == pytest.approx(silhouette_by_hand(cloud, one).mean())
    assert got["other"] == pytest.approx(silhouette_by_hand(cloud, two).mean())


def test_blocks_travel_along_the_sides_of_the_tiles(spark, cloud):
    """Any tiling adds up to the same sums over all points, each pair once."""
    one = np.arange(len(cloud)) % 4
    packed = blocks.pack_blocks(table(spark, cloud, one).withColumn("tags", F.array(F.col("cluster").cast("long"))), 20, near=False)

    def fold(state, own, other):
        state += distances(own.x, other.x).sum(axis=1)[:, None]

    def finish(state, own):
        return pd.DataFrame({"point_id": own.ids, "total": state[:, 0]})

    expected = gaps(cloud).sum(1)
    for side in (1, 3, 100):
        found = blocks.fold_all(packed, lambda own: np.zeros((len(own.x), 1)), fold, finish, "point_id string, total double", side).collect()
        got = {r.point_id: r.total for r in found}
        assert len(found) == len(cloud)
        assert [got[f"{i:04d}"] for i in range(len(cloud))] == pytest.approx(expected.tolist())


def test_nearest_neighbour_over_many_blocks(spark, cloud):
    d = gaps(cloud)
    np.fill_diagonal(d, np.inf)
    got = {r.point_id: r.distance for r in density.knn_distance(table(spark, cloud), block_rows=16).collect()}
    assert [got[f"{i:04d}"] for i in range(len(cloud))] == pytest.approx(d.min(1).tolist(), abs=1e-12)


def dbscan_by_hand(x, eps, min_samples):
    near = gaps(x) <= eps
    core = near.sum(1) >= min_samples
    label, k = -np.ones(len(x), dtype=int), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            label[i], stack = k, [i]
            while stack:
                for v in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[v] = k
                    stack.append(v)
            k += 1
    for i in np.flatnonzero(~core):
        reach = np.flatnonzero(near[i] & core)
        if len(reach):
            label[i] = label[reach].min()
    return core, label


def test_dbscan_over_many_blocks(spark, cloud):
    core, label = dbscan_by_hand(cloud, 0.5, 5)
    assert label.max() >= 2 and (label < 0).any()
    got = {r.point_id: (r.core, r.cluster) for r in density.dbscan(table(spark, cloud), 0.5, 5, block_rows=24).collect()}
    assert [got[f"{i:04d}"] for i in range(len(cloud))] == list(zip(core.tolist(), label.tolist(), strict=True))


def test_components_follow_long_chains(spark):
    names = spark.range(40).select(F.struct("id").alias("node"), F.format_string("%02d", "id").alias("first_id"))
    links = spark.range(39).filter("id <> 19").select(
        F.struct("id").alias("u"), F.struct((F.col("id") + 1).alias("id")).alias("v")
    )
    roots = {r.first_id: r.root for r in density.connected_components(names, links).collect()}
    assert {roots[f"{i:02d}"] for i in range(20)} == {"00"}
    assert {roots[f"{i:02d}"] for i in range(20, 40)} == {"20"}


def test_choose_k(spark):
    def pick(rows):
        return cq.choose_k(spark.createDataFrame(rows, "k int, silhouette double, davies_bouldin double")).head().recommended_k

    assert pick([(2, 0.9, 0.1), (3, 0.8, 0.2), (4, 0.5, 0.5)]) == 2
    assert pick([(2, 0.9, 0.9), (4, 0.3, 0.1), (5, 0.4, 0.2), (6, 0.4, 0.3)]) == 5
    assert pick([(2, 0.9, 0.9), (3, 0.9, 0.1)]) == 2


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0), (2, 2)], "a int, b int")
    assert cq.adjusted_rand(df, "a", "b").head()[0] == pytest.approx(1.0)
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")
    assert cq.adjusted_rand(df, "a", "b").head()[0] == pytest.approx(-0.5)


def test_sweep_fit_and_components(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in [(0, 0), (4, 0), (0, 4), (4, 4)]])
    x -= x.mean(axis=0)
    points = table(spark, x)
    metrics, fits = clustering.kmeans_sweep(points, max_k=5, restarts=3)
    rows = metrics.orderBy("k").collect()
    assert [r.k for r in rows] == [2, 3, 4, 5]
    assert all(a.wcss >= b.wcss - 1e-9 for a, b in zip(rows, rows[1:], strict=False))
    assert cq.choose_k(metrics).head().recommended_k == 4
    labelled = clustering.assign_nearest_center(points, clustering.ordered_centers(fits[4].model))
    assert sorted(r["count"] for r in labelled.groupBy("cluster").count().collect()) == [30] * 4
    assert cq.wcss(labelled).head().wcss == pytest.approx(rows[2].wcss)
    parts = clustering.pca_2d(points)
    ratio = [r.explained_variance_ratio for r in parts.explained.orderBy("component").collect()]
    assert ratio[0] >= ratio[1] >= 0 and sum(ratio) == pytest.approx(1.0)
    assert clustering.hierarchical_clusters(points, 4).select("cluster").distinct().count() == 4


def test_distance_sums_keep_small_distances():
    """Copies and near copies far from the origin: the sums of a matrix product agree with direct differences."""
    rng = np.random.default_rng(5)
    for offset in (0.0, 1e3):
        a = offset + np.concatenate([rng.normal(size=(90, 8)), np.zeros((60, 8))])
        b = np.concatenate([a[::-1] + 1e-7, a, np.full((40, 8), offset)])
        member = np.eye(3)[np.arange(len(b)) % 3]
        direct = gaps(np.concatenate([a, b]))[: len(a), len(a) :]
        assert np.array_equal(distances(a, b), direct) or distances(a, b) == pytest.approx(direct, rel=1e-12)
        assert blocks.distance_sums(a, b, member) == pytest.approx(direct @ member, rel=1e-8)
    same = np.full((70, 8), 1234.5678)
    assert not blocks.distance_sums(same, same, np.ones((70, 1))).any()


def test_distances_are_quick_enough_for_all_pairs():
    """A pair of full blocks: the sums cost less than half of direct differences over the whole square at once."""
    from time import perf_counter

    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 2048, 32))
    member = np.eye(5)[np.arange(2048) % 5]

    def seconds(work):
        best = np.inf
        for _ in range(3):
            began = perf_counter()
            work()
            best = min(best, perf_counter() - began)
        return best

    def at_once():
        total = np.zeros((len(a), len(b)))
        for axis in range(a.shape[1]):
            gap = a[:, axis, None] - b[None, :, axis]
            total += gap * gap
        return np.sqrt(total) @ member

    assert seconds(lambda: blocks.distance_sums(a, b, member)) < seconds(at_once) / 2


def test_near_blocks_are_tight_and_points_travel_alone(spark):
    """Blocks are leaves of a tree over all regions; a point visits only the boxes within its own bound."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(0, 1, (3000, 2)), [[50.0, 50.0]], np.full((1500, 2), 0.25)])
    packed = blocks.pack_blocks(table(spark, x).withColumn("tags", F.array(F.lit(0).cast("long"))), 8)
    rows = packed.collect()
    assert sum(r.n for r in rows) == len(x) and max(r.n for r in rows) <= 8 and len({r.block for r in rows}) == len(rows)
    area = np.median([np.prod(np.subtract(r.hi, r.lo)) for r in rows if r.hi != r.lo])
    assert area < 0.02
    visits = blocks.meet(
        packed, density._nearest_start, lambda state, own, p, square, least: square < (state * state)[p],
        lambda host, ask: pd.DataFrame({"points": [len(ask.positions)]}), "points long",
    ).agg(F.sum("points")).head()[0]
    # The far point asks most blocks; the others a few each, the copies none.
    assert visits < 3000 * 8 + len(rows)


def test_components_of_a_long_chain_keep_small_estimates(spark, capsys):
    """Every round joins the last one's result; the planner's estimate of its size must not multiply from round to round."""
    n = 60
    nodes = spark.createDataFrame([(i, f"{(i * 37) % n:03d}") for i in range(n)], "node int, first_id string")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "u int, v int")
    out = density.connected_components(nodes, links)
    assert {r.root for r in out.collect()} == {"000"}
    out.explain("cost")
    sizes = re.findall(r"sizeInBytes=([0-9.E+]+) (\w+)", capsys.readouterr().out)
    assert sizes and all(unit in ("B", "KiB") for _, unit in sizes)


@pytest.mark.parametrize("local", [clustering.LOCAL_VALUES, 0])
def test_fits_moved_together_end_as_the_library_ends_them(spark, cloud, monkeypatch, local):
    """Every fit, alone in a task or by passes over the rows, has the centres and the cost of the library's own fit."""
    from pyspark.ml.clustering import KMeans

    monkeypatch.setattr(clustering, "LOCAL_VALUES", local)
    monkeypatch.setattr(clustering, "PASS_ROWS", 100)
    rows = clustering.vectors(table(spark, cloud)).localCheckpoint()
    for k in (2, 4):
        best = min(
            (KMeans(k=k, seed=clustering.SEED + i, maxIter=clustering.MAX_ITERATIONS, featuresCol="vector").fit(rows) for i in range(2)),
            key=lambda m: m.summary.trainingCost,
        )
        got = clustering.fit_kmeans_many(rows, [k], 2)[k]
        assert got.wcss == pytest.approx(best.summary.trainingCost, rel=1e-9)
        assert np.array(clustering.ordered_centers(got.model)) == pytest.approx(np.array(clustering.ordered_centers(best)))


def test_a_pass_serves_all_fits(spark, cloud, monkeypatch):
    """The jobs follow the longest fit, not the sum of all iterations."""
    monkeypatch.setattr(clustering, "LOCAL_VALUES", 0)
    starts = [cloud[i : i + k] for k in (2, 3) for i in range(0, 120, 15)]
    passes = []
    own = clustering.iterated
    monkeypatch.setattr(clustering, "iterated", lambda step, *rest: own(lambda *a: passes.append(1) or step(*a), *rest))
    clustering.moved_together(clustering.vectors(table(spark, cloud)).localCheckpoint(), starts, 4)
    assert len(passes) <= 4


def test_ties_and_centres_without_points():
    x = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    sums, costs = clustering.nearest_sums(x, [np.array([[[0.0, 0.0], [0.0, 0.0], [9.0, 9.0]]])])
    assert sums.tolist() == [[2.0, 0.0, 3.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]] and costs.tolist() == [2.0]


def test_a_distance_is_taken_once_for_its_two_points(spark, cloud):
    """Sums both ways from one set of distances; no pair of blocks meets twice, whatever the tiles."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(300, 8)) + 50, np.concatenate([rng.normal(size=(200, 8)) + 50, np.full((50, 8), 50.0)])
    a[:7] = b[-1]
    of_a, of_b = rng.random((300, 2)), rng.random((250, 3))
    for_a, for_b = blocks.mutual_sums(a, b, of_a, of_b)
    assert for_a == pytest.approx(distances(a, b) @ of_b, rel=1e-8) and for_b == pytest.approx(distances(a, b).T @ of_a, rel=1e-8)

    packed = blocks.pack_blocks(table(spark, cloud).withColumn("tags", F.array(F.lit(0).cast("long"))), 20, near=False)
    n = packed.count()

    def fold(state, own, other):
        state += 1.0

    def mutual(state, own, other_state, other):
        assert own.number != other.number
        state += 1.0
        other_state += 1.0

    finish = lambda state, own: pd.DataFrame({"point_id": own.ids, "met": state[:, 0]})
    for side in (1, 4, None):
        met = blocks.fold_all(packed, lambda own: np.zeros((len(own.x), 1)), fold, finish, "point_id string, met double", side, mutual)
        assert {r.met for r in met.collect()} == {float(n)}


@pytest.mark.parametrize("kind", ["cloud", "grid", "copies", "far"])
def test_squares_of_products_decide_as_distances_do(kind):
    """To the last bit, also for ties, copies, points far from the origin and missing numbers."""
    rng = np.random.default_rng(9)
    draw = {
        "cloud": lambda n: rng.normal(size=(n, 8)), "grid": lambda n: rng.integers(0, 3, (n, 4)).astype(float),
        "copies": lambda n: np.ones((n, 3)), "far": lambda n: rng.normal(size=(n, 3)) + 1e6,
    }[kind]
    a, b = draw(300), draw(500)
    b[:20] = a[:20]
    for x, y in ((a, b), (np.vstack([a, [[np.nan] * a.shape[1]]]), b)):
        d = distances(x, y)
        for eps in (0.0, float(np.nanquantile(d, 0.02)), float(d[0, 100])):
            assert np.array_equal(blocks.within(x, y, eps), d <= eps)
        assert np.array_equal(blocks.nearest(x, y), d.min(axis=1), equal_nan=True)


def test_blocks_answer_several_asks_at_once(spark, monkeypatch):
    """Answers leave a task in a few frames, not in one for each ask, and the links are found once."""
    rng = np.random.default_rng(10)
    x = rng.uniform(0, 1, (600, 2))
    asked = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)
    packed = density.pack(table(spark, x), 20)

    def answers(host, asks):
        calls.add(1)
        asked.add(len(asks.parts))
        assert asks.starts[-1] == len(asks.x) == len(asks.tags)
        return pd.DataFrame({"own": [a.own for a in asks.parts], "points": np.diff(asks.starts)})

    wanted = lambda state, own, p, square, least: (p >= 0) & (square < 0.01)
    found = blocks.meet(packed, lambda own: None, wanted, None, "own long, points long", answers).collect()
    assert len(found) == asked.value > 3 * calls.value
    one = blocks.meet(
        packed, lambda own: None, wanted, lambda host, ask: pd.DataFrame({"own": [ask.own], "points": [len(ask.positions)]}), "own long, points long"
    ).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, one))
