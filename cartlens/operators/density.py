"""Nearest-neighbour distances and density clustering over blocks of points.

Points come as ``point_id`` and ``features`` (array<double>).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.blocks import NEAR_ROWS, Asks, Block, distances, each_block, fold_near, meet, nearest, pack_blocks, within
from cartlens.functions.quantiles import exact_quantiles
from cartlens.session import checkpointed, written

NOISE = -1
# Distances to boxes and to points round differently; a box this little beyond the radius is visited too.
SLACK = 1 + 1e-9


def _untagged(points: DataFrame) -> DataFrame:
    return points.select("point_id", "features", F.array(F.lit(0).cast("long")).alias("tags"))


def pack(points: DataFrame, block_rows: int = NEAR_ROWS) -> DataFrame:
    """Blocks of the points; pack once and hand them to the functions below to share the work."""
    return pack_blocks(_untagged(points), block_rows)


def _nearest_start(own: Block) -> np.ndarray:
    gaps = distances(own.x, own.x)
    np.fill_diagonal(gaps, np.inf)
    return gaps.min(axis=1)


def knn_distance(points: DataFrame, block_rows: int = NEAR_ROWS, packed: DataFrame | None = None) -> DataFrame:
    """Exact distance from each point to its nearest other point (0 for an exact copy).

    A first pass inside each block gives every point an upper bound; then a point visits only the
    blocks whose box is closer than its own bound. Nothing is approximated.
    """
    blocks = pack(points, block_rows) if packed is None else packed

    def wanted(state, own, positions, square, least):
        return square < (state * state)[positions] * SLACK

    def answer(host: Block, ask: Asks) -> np.ndarray:
        return nearest(ask.x, host.x)

    def merge(state, positions, found):
        state[positions] = np.minimum(state[positions], found)

    def finish(state, own):
        return pd.DataFrame({"point_id": own.ids, "distance": state})

    return fold_near(blocks, _nearest_start, wanted, answer, merge, finish, "point_id string, distance double").withColumn(
        "distance", F.when(F.col("distance") < float("inf"), F.col("distance"))
    )


def _within(eps: float):
    """The points that want to visit a box: those it may be within ``eps`` of."""
    return lambda state, own, positions, square, least: (positions >= 0) & (square <= eps * eps * SLACK)


def estimate_eps(distances_df: DataFrame, share: float = 0.95) -> DataFrame:
    """The radius: this quantile of the nearest-neighbour distances."""
    return exact_quantiles(distances_df, ["distance"], [share]).select(F.col("value").alias("eps"))


def _retag(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """Blocks with the ``tags`` column replaced; ``tags`` has one row per block, points in block order."""
    return checkpointed(blocks.drop("tags").join(tags, "block"))


def _tag_rows(values: np.ndarray, own: Block) -> pd.DataFrame:
    return pd.DataFrame({"block": [own.number], "tags": [np.ascontiguousarray(values, dtype=np.int64).tobytes()]})


TAG_SCHEMA = "block long, tags binary"


def neighbour_counts(
    points: DataFrame, eps: float, block_rows: int = NEAR_ROWS, packed: DataFrame | None = None
) -> DataFrame:
    """Points within ``eps`` of each point, itself included."""
    blocks = pack(points, block_rows) if packed is None else packed
    return _counts(
        blocks, eps, lambda state, own: pd.DataFrame({"point_id": own.ids, "n_neighbours": state}), "point_id string, n_neighbours long"
    )


def _counts(blocks, eps, finish, schema):
    def start(own):
        return np.count_nonzero(within(own.x, own.x, eps), axis=1)

    def answer(host, ask):
        return np.count_nonzero(within(ask.x, host.x, eps), axis=1)

    def merge(state, positions, found):
        state[positions] += found

    return fold_near(blocks, start, _within(eps), answer, merge, finish, schema)


def _groups(near: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Connected groups of the core points of one block: the position of each group's first point, or -1."""
    group = np.full(len(core), -1, dtype=np.int64)
    for seed in np.flatnonzero(core):
        if group[seed] >= 0:
            continue
        front = np.array([seed])
        group[seed] = seed
        while len(front):
            reached = near[front].any(axis=0) & core & (group < 0)
            front = np.flatnonzero(reached)
            group[front] = seed
    return group


def _joining_links(mine: np.ndarray, theirs: np.ndarray) -> list[int]:
    """Indices of the links that join something new: a spanning forest of the linked groups."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    kept = []
    for i, (a, b) in enumerate(zip(mine.tolist(), theirs.tolist(), strict=True)):
        ra, rb = root(2 * a), root(2 * b + 1)
        if ra != rb:
            parent[ra] = rb
            kept.append(i)
    return kept


def dbscan(
    points: DataFrame,
    eps: float,
    min_samples: int = 5,
    block_rows: int = NEAR_ROWS,
    packed: DataFrame | None = None,
) -> DataFrame:
    """Density clustering: ``point_id``, ``core``, ``cluster``; noise is -1.

    A core point has ``min_samples`` points within ``eps``, itself included. Clusters are numbered from
    0 by their smallest core ``point_id``; a border point joins the lowest-numbered cluster in reach, so
    the outcome does not depend on the order of the rows.

    Core points are first grouped inside each block. Between blocks only links that join two groups
    for the first time are emitted (a spanning forest), so a dense crowd costs a few links per block
    pair and not one per pair of points.
    """
    blocks = pack(points, block_rows) if packed is None else packed

    # Counts decide which points are core; core points are grouped inside their block at once. A group is
    # known by its block and the position of its first point; -1 marks the points that are not core.
    def own_groups(counts, own):
        return _tag_rows(_groups(within(own.x, own.x, eps), counts >= min_samples), own)

    grouped = _retag(blocks, _counts(blocks, eps, own_groups, TAG_SCHEMA))

    near_by = _within(eps)

    def core_wants(state, own, positions, square, least):
        return near_by(state, own, positions, square, least) & (own.tags[positions, 0] >= 0)

    def link(host, asks):
        rows = []
        core = np.flatnonzero(host.tags[:, 0] >= 0)
        lower = [ask for ask in asks.parts if ask.own < host.number]
        if len(core) and lower:
            asks = Asks(lower)
            a, b = np.nonzero(within(asks.x, host.x[core], eps))
            pairs = asks.tags[a, 0] << 32 | host.tags[core[b], 0]
            ends = np.searchsorted(a, asks.starts)
            for ask, low, high in zip(asks.parts, ends, ends[1:]):
                if low < high:
                    both = np.unique(pairs[low:high])
                    mine, theirs = both >> 32, both & 0xFFFFFFFF
                    rows += [(ask.own, int(mine[i]), host.number, int(theirs[i])) for i in _joining_links(mine, theirs)]
        return pd.DataFrame(rows, columns=["ablock", "agroup", "bblock", "bgroup"])

    link_schema = "ablock long, agroup long, bblock long, bgroup long"
    # Written, as they are read in both directions.
    links = written(meet(grouped, lambda own: None, core_wants, None, link_schema, link)).select(
        F.struct(F.col("ablock").alias("block"), F.col("agroup").alias("grp")).alias("u"),
        F.struct(F.col("bblock").alias("block"), F.col("bgroup").alias("grp")).alias("v"),
    )

    unpacked = each_block(
        grouped,
        lambda own: pd.DataFrame(
            {"block": own.number, "position": np.arange(len(own.ids)), "point_id": own.ids, "grp": own.tags[:, 0]}
        ),
        "block long, position long, point_id string, grp long",
    )
    nodes = (
        unpacked.filter("grp >= 0")
        .groupBy(F.struct("block", "grp").alias("node"))
        .agg(F.min("point_id").alias("first_id"))
    )
    component = connected_components(nodes, links)
    numbered = _number_clusters(component)

    # Core points take their group's cluster; the rest look for the lowest cluster among core neighbours.
    core_labels = unpacked.join(
        numbered.select(F.col("node.block").alias("block"), F.col("node.grp").alias("grp"), "cluster"),
        ["block", "grp"], "left",
    )
    by_block = core_labels.groupBy("block").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", F.coalesce("cluster", F.lit(NOISE).cast("long")).alias("c")))),
            lambda e: e["c"],
        ).alias("labels")
    )

    def encode(batches):
        for batch in batches:
            yield pd.DataFrame(
                {"block": batch["block"], "tags": [np.asarray(v, dtype=np.int64).tobytes() for v in batch["labels"]]}
            )

    labelled = _retag(grouped, by_block.mapInPandas(encode, TAG_SCHEMA))
    unreached = np.iinfo(np.int64).max

    def lowest(x, host):
        core = np.flatnonzero(host.tags[:, 0] >= 0)
        near = within(x, host.x[core], eps)
        return np.where(near, host.tags[core, 0][None, :], unreached).min(axis=1, initial=unreached)

    def start(own):
        label = np.full(len(own.x), unreached, dtype=np.int64)
        loose = np.flatnonzero(own.tags[:, 0] == NOISE)
        label[loose] = lowest(own.x[loose], own)
        return label

    def loose_wants(state, own, positions, square, least):
        return near_by(state, own, positions, square, least) & (own.tags[positions, 0] == NOISE)

    def merge(state, positions, found):
        state[positions] = np.minimum(state[positions], found)

    def finish(state, own):
        core = own.tags[:, 0] >= 0
        border = np.where(state < unreached, state, NOISE)
        return pd.DataFrame({"point_id": own.ids, "core": core, "cluster": np.where(core, own.tags[:, 0], border)})

    return fold_near(
        labelled, start, loose_wants, lambda host, ask: lowest(ask.x, host), merge, finish, "point_id string, core boolean, cluster long"
    )


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node, first_id) with ``root``: the smallest ``first_id`` connected to each node.

    Every round takes the smallest root among the neighbours and then hops to the root's own root, so
    long chains shrink by half, until nothing changes. Each round is written as a table: a checkpoint would keep the
    product of the estimated sizes, which has four times the digits after every round.
    """
    both = written(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    state = written(nodes.withColumn("root", F.col("first_id")))
    if both.isEmpty():
        return state
    while True:
        heard = (
            both.join(state.select(F.col("node").alias("v"), "root"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("root").alias("heard"))
        )
        lowered = state.join(heard, "node", "left").select(
            "node", "first_id", F.col("root").alias("before"), F.least("root", F.coalesce("heard", "root")).alias("root")
        )
        hop = lowered.select(F.col("first_id").alias("root"), F.col("root").alias("hop"))
        after = written(
            lowered.join(hop, "root", "left").select(
                "node", "first_id", "before", F.least("root", F.coalesce("hop", "root")).alias("root")
            )
        )
        changed = after.filter("root <> before").limit(1).count()
        state = after.drop("before")
        if not changed:
            return state


def _number_clusters(component: DataFrame) -> DataFrame:
    """Number the components 0, 1, ... by root, without sorting them in one task: each range partition
    numbers its own rows and adds the sizes of the partitions before it."""
    roots = checkpointed(
        component.select("root").distinct().repartitionByRange("root").sortWithinPartitions("root")
        .withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33)
    sizes = roots.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.agg(F.array_sort(F.collect_list(F.struct("part", "n")))).scalar()
    offset = F.aggregate(
        F.filter("_before", lambda e: e["part"] < part), F.lit(0).cast("long"), lambda s, e: s + e["n"]
    )
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbers = roots.withColumn("_before", before).select("root", (offset + place).alias("cluster"))
    return component.join(numbers, "root")
