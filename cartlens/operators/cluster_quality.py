"""Quality of a labelling: WCSS, silhouette, Davies-Bouldin, adjusted Rand, choice of k.

Points come as ``point_id``, ``features`` (array<double>) and an integer label column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.blocks import BLOCK_ROWS, dimension, distance_sums, fold_all, mutual_sums, pack_blocks


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)


def centroids(points: DataFrame, label: str = "cluster") -> DataFrame:
    """Mean of every coordinate per label: a plain aggregate, one row per label."""
    d = dimension(points)
    return points.groupBy(label).agg(
        F.array(*[F.avg(F.col("features")[i]) for i in range(d)]).alias("center"), F.count(F.lit(1)).alias("size")
    )


def with_center(points: DataFrame, label: str = "cluster") -> DataFrame:
    """Each point with its cluster's centre, looked up in one map value of a centre per cluster: the
    points are not shuffled, however many of them share a label."""
    centers = centroids(points, label).agg(F.map_from_entries(F.collect_list(F.struct(label, "center")))).scalar()
    return points.withColumn("_centers", centers).withColumn("center", F.col("_centers")[F.col(label)]).drop("_centers")


def wcss(points: DataFrame, label: str = "cluster") -> DataFrame:
    """Within-cluster sum of squares: per label and coordinate, the rows times their variance. No point meets its centre."""
    d = dimension(points)
    spread = lambda i: F.var_pop(F.col("features")[i])
    each = points.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.array(*[spread(i) for i in range(d)]).alias("spread"))
    return each.select((F.col("n") * F.aggregate("spread", F.lit(0.0), lambda s, x: s + x)).alias("d2")).agg(F.sum("d2").alias("wcss"))


def davies_bouldin(points: DataFrame, label: str = "cluster") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d(c_i, c_j).

    All centres travel as one array value, so each cluster row meets the others without a join.
    """
    spread = (
        with_center(points, label)
        .groupBy(label)
        .agg(F.first("center").alias("center"), F.avg(F.sqrt(squared_distance(F.col("features"), F.col("center")))).alias("s"))
    )
    every = spread.agg(F.collect_list(F.struct(label, "center", "s")).alias("all")).scalar()
    other = F.explode(every).alias("o")
    pairs = spread.select(label, "center", "s", other).filter(F.col(f"o.{label}") != F.col(label))
    separation = F.sqrt(squared_distance(F.col("center"), F.col("o.center")))
    return (
        pairs.withColumn("ratio", F.coalesce(F.try_divide(F.col("s") + F.col("o.s"), separation), F.lit(float("inf"))))
        .groupBy(label)
        .agg(F.max("ratio").alias("worst"))
        .agg(F.avg("worst").alias("davies_bouldin"))
    )


def silhouette_points(
    points: DataFrame, labels: Sequence[str] = ("cluster",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact Euclidean silhouette value of every point under each labelling in ``labels``.

    Every distance is needed, and taken once for its two points, so all blocks meet, in tiles; several labellings share one
    pass over them. A state is the sum of a point's distances to each cluster, of all labellings side by side.
    Rows: ``point_id``, ``labelling``, ``silhouette``.
    """
    labels = list(labels)
    tagged = points.select("point_id", "features", F.array(*[F.col(c).cast("long") for c in labels]).alias("tags"))
    sizes: list[dict[int, int]] = []
    counted = tagged.select(F.posexplode("tags").alias("which", "label")).groupBy("which", "label").count().collect()
    for i in range(len(labels)):
        sizes.append({row.label: row["count"] for row in counted if row.which == i})
    names = [sorted(s) for s in sizes]
    blocks = pack_blocks(tagged, block_rows, near=False)

    starts = np.cumsum([0, *map(len, names)])

    def start(own):
        return np.zeros((len(own.x), starts[-1]))

    def kinds(block):
        """Which kind each point is of, as ones in its row, and the columns that each kind counts for. Points of equal labels are
        of one kind, and blocks hold few kinds."""
        first = np.flatnonzero(np.r_[True, (block.tags[1:] != block.tags[:-1]).any(axis=1)])
        member = np.zeros((len(block.x), len(first)))
        member[np.arange(len(block.x)), np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(block.x)]))] = 1.0
        columns = np.zeros((len(first), starts[-1]))
        for i, known in enumerate(names):
            columns[np.arange(len(first)), starts[i] + np.searchsorted(known, block.tags[first, i])] = 1.0
        return member, columns

    def fold(state, own, other):
        member, columns = kinds(other)
        state += distance_sums(own.x, other.x, member) @ columns

    def mutual(state, own, other_state, other):
        (of_own, own_columns), (of_other, other_columns) = kinds(own), kinds(other)
        for_own, for_other = mutual_sums(own.x, other.x, of_own, of_other)
        state += for_own @ other_columns
        other_state += for_other @ own_columns

    def finish(state, own):
        parts = []
        for i, known in enumerate(names):
            sums = state[:, starts[i] : starts[i + 1]]
            size = np.array([sizes[i][v] for v in known], dtype=np.float64)
            mine = np.searchsorted(known, own.tags[:, i])
            row = np.arange(len(mine))
            inner = sums[row, mine] / np.maximum(size[mine] - 1, 1)
            outer = sums / size[None, :]
            outer[row, mine] = np.inf
            nearest = outer.min(axis=1)
            top = np.maximum(inner, nearest)
            value = np.where((size[mine] > 1) & (top > 0) & np.isfinite(top), (nearest - inner) / np.where(top > 0, top, 1), 0.0)
            parts.append(pd.DataFrame({"point_id": own.ids, "labelling": labels[i], "silhouette": value}))
        return pd.concat(parts)

    return fold_all(blocks, start, fold, finish, "point_id string, labelling string, silhouette double", mutual=mutual)


def silhouette(points: DataFrame, labels: Sequence[str] = ("cluster",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean silhouette per labelling (exact, Euclidean)."""
    return (
        silhouette_points(points, labels, block_rows)
        .groupBy("labelling")
        .agg(F.avg("silhouette").alias("silhouette"), F.lit("euclidean").alias("method"))
    )


def silhouette_squared(points: DataFrame, label: str = "cluster") -> float:
    """Silhouette with *squared* distances: linear in the points, but a different figure."""
    vectors = points.select(array_to_vector("features").alias("features"), F.col(label).cast("int").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(vectors)


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Chance-corrected agreement of two label columns, from their contingency counts."""
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2.0)
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs.alias("p")).scalar()
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs.alias("p")).scalar()
    total = F.sum("n")
    return (
        cells.agg(pairs.alias("same"), (total * (total - 1) / 2.0).alias("possible"))
        .withColumn("left_pairs", left)
        .withColumn("right_pairs", right)
        .withColumn("expected", F.try_divide(F.col("left_pairs") * F.col("right_pairs"), F.col("possible")))
        .withColumn("largest", (F.col("left_pairs") + F.col("right_pairs")) / 2)
        .select(
            F.coalesce(
                F.try_divide(F.col("same") - F.col("expected"), F.col("largest") - F.col("expected")), F.lit(1.0)
            ).alias("adjusted_rand")
        )
    )


# The ks preferred when the two criteria disagree.
PREFERRED_K = [4, 5, 6]


def choose_k(metrics: DataFrame) -> DataFrame:
    """One row: best k by silhouette, by Davies-Bouldin, and the recommended one.

    ``metrics`` has ``k``, ``silhouette``, ``davies_bouldin``. Ties go to the smaller k. If the two
    disagree, the best silhouette among the preferred ks decides, if any of them was tried.
    """
    k = F.col("k").cast("long")
    best = F.struct("silhouette", -F.col("k"))
    preferred = F.col("k").isin(PREFERRED_K)
    return metrics.agg(
        F.max_by(k, best).alias("k_silhouette"),
        F.min_by(k, F.struct("davies_bouldin", "k")).alias("k_davies_bouldin"),
        F.max_by(k, F.when(preferred, best)).alias("k_preferred"),
    ).select(
        "k_silhouette",
        "k_davies_bouldin",
        F.when(F.col("k_silhouette") == F.col("k_davies_bouldin"), F.col("k_silhouette"))
        .otherwise(F.coalesce("k_preferred", "k_silhouette"))
        .alias("recommended_k"),
    )
