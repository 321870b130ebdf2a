"""Cluster fits on the scaled customers: k-means, hierarchical, principal components, comparison.

Points come as ``point_id`` and ``features`` (array<double>).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.ml.clustering import BisectingKMeans, KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.operators import density, linkage
from cartlens.operators.cluster_quality import (
    adjusted_rand,
    choose_k,
    davies_bouldin,
    silhouette,
    silhouette_squared,
)
from cartlens.operators.features import CLUSTERING_FEATURES
from cartlens.session import checkpointed, reused

# The settings of the k-means fits.
SEED = 42
RESTARTS = 10
MAX_ITERATIONS = 300
ROWS_PER_TASK = 100_000
# Jobs submitted at a time; each is short and leaves most of a cluster idle.
PARALLEL_FITS = 8
# How far the centres of a finished fit may still move; the library's own value.
TOLERANCE = 1e-4
# Numbers of all points, up to which every fit is a task that takes them whole.
LOCAL_VALUES = 2_000_000
# Rows of a task, of a packed row and of the strip of distances that stays in the cache, in a pass over all fits at once.
PASS_ROWS, PASS_BLOCK, PASS_STRIP = 50_000, 8192, 128


def as_points(z: DataFrame, key: str = "customer_id") -> DataFrame:
    return z.select(F.col(key).alias("point_id"), "features")


def vectors(points: DataFrame) -> DataFrame:
    """Points with an ML vector, in a fixed order inside fixed partitions so equal seeds give equal fits.

    The partitions are sized by rows: a fit runs one short job per iteration, which for few points is
    mostly the cost of starting tasks.
    """
    tasks = max(1, math.ceil(points.count() / ROWS_PER_TASK))
    return (
        points.repartition(tasks, "point_id")
        .sortWithinPartitions("point_id")
        .select("point_id", array_to_vector("features").alias("vector"))
    )


@dataclass
class Centers:
    """The centres a fit ends with, under the library's name for them."""

    centers: list[np.ndarray]

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802
        return self.centers


@dataclass
class KMeansFit:
    k: int
    wcss: float
    model: Centers


def fit_kmeans_many(
    table: DataFrame, ks: Sequence[int], restarts: int = RESTARTS, seed: int = SEED, parallelism: int = PARALLEL_FITS
) -> dict[int, KMeansFit]:
    """The cheapest of ``restarts`` fits for every k, over one kept table.

    The library draws the first centres of every fit (k-means||, no iteration), a few fits at a time; it keeps the rows of a
    table that is not kept already in its own form. Then all fits move together, without a job per fit and iteration.
    """

    def first(task: tuple[int, int]) -> np.ndarray:
        k, offset = task
        model = KMeans(k=k, seed=seed + offset, maxIter=0, featuresCol="vector", predictionCol="cluster").fit(table)
        return np.array(model.clusterCenters(), dtype=float)

    tasks = [(k, i) for k in ks for i in range(restarts)]
    with ThreadPoolExecutor(parallelism) as pool:
        starts = list(pool.map(first, tasks))
    best: dict[int, KMeansFit] = {}
    for (k, _), (centers, cost) in zip(tasks, moved_together(table, starts), strict=True):
        if k not in best or cost < best[k].wcss:
            best[k] = KMeansFit(k, cost, Centers(list(centers)))
    return best


def moved_together(
    table: DataFrame, starts: Sequence[np.ndarray], max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE
) -> list[tuple[np.ndarray, float]]:
    """Lloyd's iterations of many fits: the centres and the cost of each, as the library ends them.

    Points of at most ``LOCAL_VALUES`` numbers travel whole to a task per fit. Of more points, one pass serves all fits that
    still move; the driver holds the centres and, of each task, their sums.
    """
    sc = table.sparkSession.sparkContext
    packed = pack_rows(table)
    count = packed.agg(F.sum("n")).head()[0] or 0
    if count * starts[0].shape[1] <= LOCAL_VALUES:
        rows = packed.orderBy("part", "at").collect()
        x = sc.broadcast(np.concatenate([np.frombuffer(r.x, dtype=np.float64).reshape(r.n, -1) for r in rows]))
        alone = lambda start: iterated(lambda groups, shift: nearest_sums(x.value - shift, groups), [start], max_iterations, tolerance)[0]
        ended = sc.parallelize(starts, len(starts)).map(alone).collect()
        x.unpersist()
        return ended
    held = packed.select("part", "n", "x").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def one_pass(groups: list[np.ndarray], shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            total, part = None, 0
            for part, n, x in rows:
                found = nearest_sums(np.frombuffer(x, dtype=np.float64).reshape(n, -1) - shift, groups)
                total = found if total is None else [t + f for t, f in zip(total, found, strict=True)]
            if total is not None:
                yield part, *total

        # Added up in a fixed order, so that equal seeds give equal fits.
        found = sorted(held.mapPartitions(run).collect(), key=lambda r: r[0])
        return sum(r[1] for r in found), sum(r[2] for r in found)

    ended = iterated(one_pass, starts, max_iterations, tolerance)
    held.unpersist()
    return ended


def iterated(
    step: Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]],
    starts: Sequence[np.ndarray],
    max_iterations: int,
    tolerance: float,
) -> list[tuple[np.ndarray, float]]:
    """Lloyd's iterations over ``step``, which is ``nearest_sums`` of all points less a shift.

    A fit ends when no centre moved more than ``tolerance``; its cost is that of the points before the last move. A centre
    without points stays where it is.
    """
    fits = [np.array(c, dtype=float) for c in starts]
    costs, active = [float("inf")] * len(fits), list(range(len(fits)))
    shift = np.concatenate(fits).mean(axis=0)
    for _ in range(max_iterations):
        if not active:
            break
        # Fits of as many centres lie side by side.
        active.sort(key=lambda i: len(fits[i]))
        groups = [np.stack([fits[i] - shift for i in active if len(fits[i]) == k]) for k in sorted({len(fits[i]) for i in active})]
        sums, cost = step(groups, shift)
        at, still = 0, []
        for j, i in enumerate(active):
            own = sums[at : at + len(fits[i])]
            at += len(own)
            held = own[:, -1:] > 0
            after = np.where(held, own[:, :-1] / np.where(held, own[:, -1:], 1) + shift, fits[i])
            if (((after - fits[i]) ** 2).sum(axis=1) > tolerance**2).any():
                still.append(i)
            fits[i], costs[i] = after, float(cost[j])
        active = still
    return list(zip(fits, costs, strict=True))


def pack_rows(table: DataFrame) -> DataFrame:
    """The vectors of ``table`` as packed rows, in a fixed order inside fixed tasks."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        at = 0

        def one() -> pd.DataFrame:
            x = np.concatenate(held)
            return pd.DataFrame({"part": [TaskContext.get().partitionId()], "at": [at], "n": [len(x)], "x": [x.tobytes()]})

        for batch in batches:
            if len(batch):
                held.append(np.stack(batch["features"].to_list()).astype(np.float64))
            if sum(map(len, held)) >= PASS_BLOCK:
                yield one()
                held, at = [], at + 1
        if held:
            yield one()

    tasks = max(1, math.ceil(table.count() / PASS_ROWS))
    points = table.select("point_id", vector_to_array("vector").alias("features"))
    return checkpointed(points.repartition(tasks, "point_id").sortWithinPartitions("point_id").mapInPandas(pack, "part int, at int, n int, x binary"))


def nearest_sums(x: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sums and numbers of the points nearest to each centre (the first on ties), and the costs, over the rows of ``x``."""
    fits = [len(g) for g in groups]
    every = np.concatenate([g.reshape(-1, x.shape[1]) for g in groups])
    left = np.concatenate([-2.0 * every, (every * every).sum(axis=1)[:, None]], axis=1)
    sums, costs = np.zeros(left.shape), [np.zeros(f) for f in fits]
    for at in range(0, len(x), PASS_STRIP):
        strip = x[at : at + PASS_STRIP]
        ones = np.concatenate([strip, np.ones((len(strip), 1))], axis=1)
        square, norm, row = left @ ones.T, (strip * strip).sum(axis=1), 0
        near = np.empty(square.shape)
        for i, g in enumerate(groups):
            part = slice(row, row + g.shape[0] * g.shape[1])
            row = part.stop
            own = square[part].reshape(*g.shape[:2], -1)
            low = own.min(axis=1)
            mine = np.equal(own, low[:, None], out=near[part].reshape(own.shape), casting="unsafe")
            if mine.sum() != low.size:
                mine[:] = np.arange(g.shape[1])[None, :, None] == mine.argmax(axis=1)[:, None]
            costs[i] += np.maximum(low + norm, 0.0).sum(axis=1)
        sums += near @ ones
    return sums, np.concatenate(costs)


def ordered_centers(model: KMeansModel | Centers) -> list[list[float]]:
    """Centres sorted by their coordinates: cluster numbers then do not depend on the seed's draw."""
    return sorted(np.asarray(c, dtype=float).tolist() for c in model.clusterCenters())


def assign_nearest_center(points: DataFrame, centers: Sequence[Sequence[float]], label: str = "cluster") -> DataFrame:
    """Number of the nearest centre (the first on ties). The k centres are literals in the expression."""
    features = F.col("features")
    gaps = []
    for center in centers:
        total = F.lit(0.0)
        for i, value in enumerate(center):
            gap = features[i] - F.lit(float(value))
            total = total + gap * gap
        gaps.append(total)
    distance = F.array(*gaps)
    return points.withColumn(label, (F.array_position(distance, F.array_min(distance)) - 1).cast("int"))


def kmeans_sweep(
    points: DataFrame, max_k: int = 10, restarts: int = RESTARTS, seed: int = SEED, method: str = "euclidean"
) -> tuple[DataFrame, dict[int, KMeansFit]]:
    """Metrics per k = 2..max_k and the fits behind them.

    One pass labels every point under every k; the exact silhouette then measures each distance once
    for all of them. ``method``: ``euclidean``, the same at every size, or ``squared`` if the caller asks for it.
    """
    spark = points.sparkSession
    points = reused(points)
    table = checkpointed(vectors(points))
    ks = list(range(2, max_k + 1))
    fits = fit_kmeans_many(table, ks, restarts, seed)
    labelled = points
    for k in ks:
        labelled = assign_nearest_center(labelled, ordered_centers(fits[k].model), f"k{k}")
    labelled = reused(labelled)
    if method not in ("euclidean", "squared"):
        raise ValueError(f"unknown silhouette: {method}")
    if method == "euclidean":
        scores = {r.labelling: r.silhouette for r in silhouette(labelled, [f"k{k}" for k in ks]).collect()}
    else:
        scores = {f"k{k}": silhouette_squared(labelled, f"k{k}") for k in ks}
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        spreads = dict(zip(ks, pool.map(lambda k: davies_bouldin(labelled, f"k{k}").head().davies_bouldin, ks), strict=True))
    rows = [(k, float(fits[k].wcss), float(scores[f"k{k}"]), float(spreads[k]), method) for k in ks]
    for held in (labelled, points):
        held.unpersist()
    schema = "k int, wcss double, silhouette double, davies_bouldin double, method string"
    return spark.createDataFrame(rows, schema), fits


def recommended_k(metrics: DataFrame) -> int:
    return int(choose_k(metrics).head().recommended_k)


def kmeans_fit(points: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED) -> list[list[float]]:
    """Centres of the best fit, in scaled units."""
    fit = fit_kmeans_many(checkpointed(vectors(points)), [k], restarts, seed)[k]
    return ordered_centers(fit.model)


def label_customers(z: DataFrame, kept: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """The kept customers with their cluster; ``z`` holds the same customers scaled."""
    labels = assign_nearest_center(z.select("customer_id", "features"), centers).drop("features")
    return kept.join(labels, "customer_id")


def cluster_centers(
    customers: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES, label: str = "cluster"
) -> DataFrame:
    """Mean of each feature per cluster, in original units: the centre at convergence."""
    return customers.groupBy(label).agg(*[F.avg(c).alias(c) for c in features])


def cluster_sizes(customers: DataFrame, label: str = "cluster") -> DataFrame:
    sizes = customers.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).scalar()
    return sizes.withColumn("percentage", F.try_divide(F.col("size") * 100.0, total))


def hierarchical_clusters(points: DataFrame, k: int, tree: DataFrame | None = None) -> DataFrame:
    """Bottom-up hierarchical clustering into k groups by Ward's criterion; ``tree`` is their linkage, if it is at hand."""
    return linkage.cut(points, linkage.ward_linkage(points) if tree is None else tree, k)


def bisecting_clusters(points: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Top-down hierarchical clustering into k groups (bisecting k-means).

    The first split starts from a disturbance proportional to the centre's length, which is nothing for
    centred data; a shift, which changes no distance, gives it one.
    """
    shifted = points.withColumn("features", F.transform("features", lambda v: v + 10.0))
    table = reused(vectors(shifted))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster").fit(table)
    return model.transform(table).select("point_id", F.col("cluster").cast("int").alias("cluster"))


@dataclass
class Components:
    points: DataFrame
    explained: DataFrame


def pca_2d(points: DataFrame, k: int = 2) -> Components:
    """The first principal components of the (already centred) points.

    A component's sign is arbitrary; the loading of largest magnitude is made positive.
    """
    spark = points.sparkSession
    table = vectors(points)
    model = PCA(k=k, inputCol="vector", outputCol="pc").fit(table)
    loadings = model.pc.toArray()
    flips = [1.0 if loadings[np.abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    scores = model.transform(table).withColumn("pc", vector_to_array("pc"))
    ratio = [float(v) for v in model.explainedVariance.toArray()]
    explained = spark.createDataFrame(
        [(i + 1, v, float(sum(ratio[: i + 1]))) for i, v in enumerate(ratio)],
        "component int, explained_variance_ratio double, cumulative_ratio double",
    )
    return Components(
        scores.select("point_id", *[(F.col("pc")[i] * flips[i]).alias(f"pc{i + 1}") for i in range(k)]), explained
    )


@dataclass
class MethodComparison:
    summary: DataFrame
    labels: DataFrame
    eps: float


def method_comparison(points: DataFrame, k: int, min_samples: int = 5, seed: int = SEED) -> MethodComparison:
    """k-means, hierarchical and density clustering side by side: cluster counts, noise, agreement."""
    points = reused(points)
    kmeans = assign_nearest_center(points, kmeans_fit(points, k, 1, seed), "kmeans").select("point_id", "kmeans")
    tree = hierarchical_clusters(points, k).withColumnRenamed("cluster", "hierarchical")
    packed = density.pack(points)
    eps = float(density.estimate_eps(density.knn_distance(points, packed=packed)).head().eps)
    dense = density.dbscan(points, eps, min_samples, packed=packed).select("point_id", F.col("cluster").alias("dbscan"))
    labels = reused(kmeans.join(tree, "point_id").join(dense, "point_id"))
    agreement = adjusted_rand(labels, "kmeans", "hierarchical").scalar()
    summary = labels.agg(
        F.countDistinct("kmeans").alias("kmeans_clusters"),
        F.countDistinct("hierarchical").alias("hierarchical_clusters"),
        F.countDistinct(F.when(F.col("dbscan") != density.NOISE, F.col("dbscan"))).alias("dbscan_clusters"),
        F.count_if(F.col("dbscan") == density.NOISE).alias("dbscan_noise"),
    ).withColumn("kmeans_vs_hierarchical", agreement)
    return MethodComparison(summary, labels, eps)


def pca_points(components: Components, labels: DataFrame) -> DataFrame:
    """Component scores beside the labels of the three methods."""
    return components.points.join(labels, "point_id")


def centers_table(spark, centers: Sequence[Sequence[float]], features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    schema = T.StructType(
        [*[T.StructField(c, T.DoubleType()) for c in features], T.StructField("cluster", T.IntegerType())]
    )
    return spark.createDataFrame([(*map(float, c), i) for i, c in enumerate(centers)], schema)


def unscale_centers(centers: DataFrame, stats: DataFrame, features: Sequence[str] = CLUSTERING_FEATURES) -> DataFrame:
    """Centres in original units: z * std + mean, with the one-row-per-feature scaling table."""
    out = centers
    for c in features:
        one = stats.filter(F.col("feature") == c)
        out = out.withColumn(c, F.col(c) * one.select("std").scalar() + one.select("mean").scalar())
    return out
