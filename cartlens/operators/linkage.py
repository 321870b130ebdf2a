"""Bottom-up hierarchical clustering by Ward's criterion, without a distance matrix.

A cluster is its centre and size; merging a and b costs |a||b| / (|a| + |b|) times the squared distance of their
centres. Ward's criterion is reducible: merging two clusters that are each other's nearest brings nobody closer, so all
such pairs can be merged at once and the tree is that of merging the cheapest pair again and again. A round is one
search for the nearest cluster over packed blocks, ruled out by their boxes, and one join; a constant share of the
clusters goes in every round. The last ``FINISH_ROWS`` clusters, and no more, are merged in one task by the same rounds.

Clusters are named by their smallest point id, so every point but the first is absorbed exactly once, and the tree is a
table with one row per absorbed point. Ties go by a hash of the pair, which depends neither on the order of rows nor
on their distribution and leaves no chain of ties that merges pair by pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.blocks import FEW, NEAR_ROWS, ROUNDING, Block, distances, fold_near, near_squares, pack_blocks, pair_distances
from cartlens.session import checkpointed, written

# Clusters that one task may finish: a bounded number, whatever the input; and the rows of costs it holds at a time.
FINISH_ROWS = 8192
FINISH_STRIP = 256
MERGES = "absorbed string, into string, height double, brought long"


def merge_costs(gaps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The increase of the sum of squares for merging clusters of sizes ``a`` (rows) and ``b`` (columns)."""
    return gaps * gaps * (a[:, None] * b[None, :] / (a[:, None] + b[None, :]))


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What decides ties: the same for (a, b) and (b, a), and like random for the hashes of ids."""
    return tie_key(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :])


def tie_key(both: np.ndarray) -> np.ndarray:
    mixed = both * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


NONE = np.iinfo(np.uint64).max
PARTNER = [("cost", "<f8"), ("key", "<u8"), ("block", "<i8"), ("position", "<i8")]


def _cheapest(x: np.ndarray, tags: np.ndarray, host: Block, itself: bool = False) -> np.ndarray:
    """The cheapest partner in ``host`` of every cluster: cost, key, block and position.

    Costs from squares of a matrix product leave the few partners that may be the cheapest; only these are measured.
    """
    found = np.zeros(len(x), dtype=PARTNER)
    size, sizes = tags[:, 0].astype(float), host.tags[:, 0].astype(float)
    hashes, theirs = np.ascontiguousarray(tags[:, 1]).view(np.uint64), np.ascontiguousarray(host.tags[:, 1]).view(np.uint64)
    for part, square, wrong in near_squares(x, host.x):
        rows, strip = np.arange(len(x))[part], found[part]
        own = rows if itself else np.full(len(rows), -1)
        p = q = None
        if square is not None:
            costs = np.divide(square, 1.0 / size[part, None] + 1.0 / sizes, out=square)
            if itself:
                costs[np.arange(len(rows)), own] = np.inf
            # A cost is the square times at most the own size; the figures for the few are those of ``merge_costs``.
            low = costs.min(axis=1)
            p, q = np.nonzero(costs <= (low + 2 * wrong * size[part] + ROUNDING * np.abs(np.where(np.isfinite(low), low, 0.0)))[:, None])
            if len(p) > square.size // FEW + len(rows):
                p = None
        if p is None:
            # Many ties, or numbers too large for the product: all costs, of which the cheapest are left.
            costs = merge_costs(distances(x[part], host.x), size[part], sizes)
            if itself:
                costs[np.arange(len(rows)), own] = np.inf
            keys = np.where(costs > costs.min(axis=1)[:, None], NONE, tie_key(hashes[part][:, None] ^ theirs))
            p, q = np.arange(len(rows)), keys.argmin(axis=1)
        alone = q == own[p]
        p, q = p[~alone], q[~alone]
        gap = pair_distances(x[part], host.x, p, q)
        a, b = size[part][p], sizes[q]
        cost, key = gap * gap * (a * b / (a + b)), tie_key(hashes[part][p] ^ theirs[q])
        order = np.lexsort((q, key, cost, p))
        first = order[np.r_[True, np.diff(p[order]) > 0][: len(order)]]
        strip["cost"], strip["key"], strip["block"], strip["position"] = np.inf, NONE, -1, -1
        first = first[np.isfinite(cost[first])]
        at = p[first]
        strip["cost"][at], strip["key"][at], strip["block"][at], strip["position"][at] = cost[first], key[first], host.number, q[first]
    return found


def nearest_clusters(blocks: DataFrame) -> DataFrame:
    """(block, position, id, center, size, cost, near_block, near_position) of every cluster in ``blocks``.

    A first pass inside the blocks bounds what a cheaper partner may cost; then a cluster visits the blocks in which one
    of the smallest size there could cost as little.
    """

    def wanted(state, own, positions, square, least):
        size = own.tags[positions, 0].astype(float)
        return square * (size * least / (size + least)) <= state["cost"][positions] * (1 + 1e-9)

    def merge(state, positions, found):
        now = state[positions]
        better = (found["cost"] < now["cost"]) | ((found["cost"] == now["cost"]) & (found["key"] < now["key"]))
        better &= np.isfinite(found["cost"])
        state[positions[better]] = found[better]

    def finish(state, own):
        return pd.DataFrame({
            "block": own.number, "position": np.arange(len(own.x)), "id": own.ids, "center": [c.tolist() for c in own.x],
            "size": own.tags[:, 0], "cost": state["cost"], "near_block": state["block"], "near_position": state["position"],
        })

    return fold_near(
        blocks, lambda own: _cheapest(own.x, own.tags, own, True), wanted, lambda host, ask: _cheapest(ask.x, ask.tags, host), merge, finish,
        "block long, position long, id string, center array<double>, size long, cost double, near_block long, near_position long",
    )


def _packed(clusters: DataFrame, block_rows: int) -> DataFrame:
    tags = F.array(F.col("size"), F.xxhash64("id"))
    return pack_blocks(clusters.select(F.col("id").alias("point_id"), F.col("center").alias("features"), tags.alias("tags")), block_rows)


def _finished(clusters: DataFrame) -> DataFrame:
    """The merges among the last clusters, of which there are at most ``FINISH_ROWS``."""

    def run(batches):
        parts = list(batches)
        if sum(map(len, parts)) > 1:
            rows = pd.concat(parts).sort_values("id")
            yield merged_locally(
                rows["id"].to_list(), np.stack(rows["center"].to_list()), rows["size"].to_numpy(dtype=float), rows["hash"].to_numpy(dtype=np.int64)
            )

    return clusters.select("id", "center", "size", F.xxhash64("id").alias("hash")).coalesce(1).mapInPandas(run, MERGES)


def merged_locally(ids: list[str], x: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> pd.DataFrame:
    """The rounds over arrays, with ids in ascending order.

    A cluster's nearest stays its nearest until one of the two is merged, as merging brings nobody closer. So a round
    measures only the clusters that were merged, or whose nearest was, against all others, a few rows of costs at a time.
    """
    names, out = np.array(ids, dtype=object), []
    n = len(names)
    near, least, keys = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.full(n, NONE, dtype=np.uint64)
    stale, merged = np.arange(n), np.zeros(0, dtype=np.int64)
    while n > 1:
        for rows, shared in ((stale, False), (merged, True)):
            for at in range(0, len(rows), FINISH_STRIP):
                part = rows[at : at + FINISH_STRIP]
                costs = merge_costs(distances(x[part], x), size[part], size)
                costs[np.arange(len(part)), part] = np.inf
                key = pair_keys(hashes[part], hashes)
                low = costs.min(axis=1)
                own = np.where(costs > low[:, None], NONE, key)
                near[part], least[part] = own.argmin(axis=1), low
                keys[part] = own[np.arange(len(part)), near[part]]
                if shared:
                    # What a new cluster costs the others; less than before only where rounding or a tie has it so.
                    for i, row in enumerate(part):
                        better = (costs[i] < least) | ((costs[i] == least) & (key[i] < keys))
                        better[row] = False
                        near[better], least[better], keys[better] = row, costs[i][better], key[i][better]
        here = np.arange(n)
        first = here[(near[near] == here) & (here < near)]
        second = near[first]
        for a, b in zip(first, second):
            out.append((names[b], names[a], float(np.sqrt(2 * least[a])), int(size[b])))
        total = size[first] + size[second]
        x[first] = (x[first] * size[first][:, None] + x[second] * size[second][:, None]) / total[:, None]
        size[first] = total
        touched = np.zeros(n, dtype=bool)
        touched[first] = touched[second] = True
        left = np.setdiff1d(here, second)
        place = np.full(n, -1, dtype=np.int64)
        place[left] = np.arange(len(left))
        merged = place[first]
        lost = touched[near][left] & ~touched[left]
        stale, near = np.flatnonzero(lost), place[near][left]
        names, x, size, hashes, least, keys = names[left], x[left], size[left], hashes[left], least[left], keys[left]
        n = len(names)
    return pd.DataFrame(out, columns=["absorbed", "into", "height", "brought"])


def ward_linkage(points: DataFrame, block_rows: int = NEAR_ROWS, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """The tree: (absorbed, into, height, brought), one row for every ``point_id`` but the smallest.

    The cluster named ``absorbed``, of ``brought`` points, joins the cluster named ``into`` at ``height``, the square root
    of twice the merging cost. Heights never fall on the way up. Equal points are merged first, at height 0.
    """
    named = points.select(F.col("point_id").cast("string").alias("id"), F.col("features").alias("center"))
    distinct = named.groupBy("center").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    clusters = written(distinct.select("id", "center", "size"))
    copies = named.join(clusters.where("size > 1").select("center", F.col("id").alias("into")), "center").where("id <> into").select(
        F.col("id").alias("absorbed"), "into", F.lit(0.0).alias("height"), F.lit(1).cast("long").alias("brought")
    )
    merges = [checkpointed(copies)]
    while clusters.count() > finish_rows:
        a = written(nearest_clusters(_packed(clusters, block_rows)))
        b = a.select(*[F.col(c).alias(f"{c}_b") for c in a.columns])
        mutual = (
            (F.col("near_block") == F.col("block_b")) & (F.col("near_position") == F.col("position_b"))
            & (F.col("near_block_b") == F.col("block")) & (F.col("near_position_b") == F.col("position"))
        )
        both = written(a.join(b, mutual, "left").where("id_b IS NULL OR id < id_b"))
        merges.append(written(both.where("id_b IS NOT NULL").select(
            F.col("id_b").alias("absorbed"), F.col("id").alias("into"), F.sqrt(2 * F.col("cost")).alias("height"), F.col("size_b").alias("brought")
        )))
        total = F.col("size") + F.col("size_b")
        middle = F.zip_with("center", "center_b", lambda p, q: (p * F.col("size") + q * F.col("size_b")) / total)
        clusters = written(both.select(
            "id", F.when(F.col("id_b").isNull(), F.col("center")).otherwise(middle).alias("center"), F.coalesce(total, "size").alias("size")
        ))
    merges.append(checkpointed(_finished(clusters)))
    out = merges[0]
    for m in merges[1:]:
        out = out.unionByName(m)
    return out


def cut(points: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(point_id, cluster): the ``k`` clusters below the ``k`` - 1 highest merges of ``tree``, numbered by their smallest id.

    Every point hops to the cluster that absorbed it and then to that one's own end, so long chains halve every round.
    """
    ids = points.select(F.col("point_id").cast("string").alias("point_id"))
    # Of equal heights, the merge of the larger names counts as the higher one, as it comes later.
    highest = [r["absorbed"] for r in tree.orderBy(F.desc("height"), F.desc("absorbed")).limit(k - 1).collect()]
    first = ids.agg(F.min("point_id")).head()[0]
    ends = sorted([*highest, *([] if first is None else [first])])
    below = tree.where(~F.col("absorbed").isin(highest)) if highest else tree
    state = written(ids.join(below.select(F.col("absorbed").alias("point_id"), F.col("into").alias("end")), "point_id", "left")
                         .withColumn("end", F.coalesce("end", "point_id")))
    while True:
        open_ = state.where(~F.col("end").isin(ends))
        if open_.isEmpty():
            break
        hops = state.select(F.col("point_id").alias("end"), F.col("end").alias("next"))
        state = written(open_.join(hops, "end").select("point_id", F.col("next").alias("end")).unionByName(
            state.where(F.col("end").isin(ends)).select("point_id", "end")
        ))
    return state.select("point_id", (F.array_position(F.array(*[F.lit(e) for e in ends]), F.col("end")) - 1).cast("int").alias("cluster"))
