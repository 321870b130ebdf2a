"""Point-to-point work over packed blocks of rows.

Questions about every pair of points (mean distance to a cluster, nearest neighbour, neighbours within
a radius) are asked per *block*. A block is one row holding up to ``rows`` points as a packed
array, whatever the data looks like: a crowd of equal points fills several blocks. For questions about
near points the blocks are the leaves of a k-d tree, and a point travels only to the blocks whose bounding
box it may matter to. No pair of points is ever a row.
"""

from __future__ import annotations

import math
from ast import literal_eval
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import cartlens
from cartlens.session import checkpointed

# The task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(cartlens)

BLOCK_ROWS = 2048
# Bytes of points and states that a tile's own side may hold, its points at most, and the tiles wanted for every core.
TILE_BYTES, TILE_POINTS, TILES_PER_CORE = 128 << 20, 1 << 19, 4
# Rows of a block where only near points matter; blocks of a region, which one task splits, and by how much one may be
# larger; rows of the sample that the planes between the regions come from.
NEAR_ROWS = 512
REGION_BLOCKS = 32
REGION_ROOM = 4
SAMPLE_PER_LEAF, SAMPLE_ROWS = 200, 200_000
# Blocks that a task hosts, the number of such tasks up to which adaptive execution sizes them, points that ask a block in one
# go, and answers to such that leave a task together.
TASK_BLOCKS, FEW_TASKS, ASK_POINTS, ANSWER_FRAMES = 32, 16, 4096, 64
# Rows of a strip of distances, and the share of the spread under which a square from a matrix product is not trusted.
STRIP_ROWS = 64
CLOSE = 1e-6
# Rows of a strip of squares between near blocks, the share of the spread by which these are wrong at most (a thousand times
# what products of some ten terms lose), and the share of pairs up to which they are measured one by one.
NEAR_STRIP, ROUNDING, FEW = 256, 1e-12, 16
BLOCK_SCHEMA = "block long, n int, ids array<string>, x binary, tags binary, lo array<double>, hi array<double>"


def dimension(points: DataFrame) -> int:
    row = points.select(F.size("features").alias("d")).head()
    return int(row.d) if row else 0


def _split(x: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """Positions of ``x`` in groups of at most ``rows``: halves along the widest coordinate, again and again."""
    open_ = [np.arange(len(x))]
    while open_:
        at = open_.pop()
        if len(at) <= rows:
            yield np.sort(at)
            continue
        own = x[at]
        order = np.argsort(own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))], kind="stable")
        open_ += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]


def _planes(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """A k-d tree over a sample: (axis, value, left, right); a child below 0 is the leaf -1 - child."""
    planes: list[tuple[int, float, int, int]] = []
    n_leaves = 0

    def grow(own: np.ndarray, want: int) -> int:
        nonlocal n_leaves
        wide = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(1)
        axis = int(np.argmax(wide))
        if want < 2 or not wide[axis] > 0:
            n_leaves += 1
            return -n_leaves
        value = float(np.median(own[:, axis]))
        if value >= own[:, axis].max():
            value = float(own[own[:, axis] < value, axis].max())
        low, here = own[:, axis] <= value, len(planes)
        planes.append((axis, value, 0, 0))
        left = grow(own[low], want // 2)
        planes[here] = (axis, value, left, grow(own[~low], want - want // 2))
        return here

    grow(x, leaves)
    return planes


def _leaf_of(x: np.ndarray, planes: list[tuple[int, float, int, int]]) -> np.ndarray:
    leaf, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))] if planes else []
    while todo:
        node, at = todo.pop()
        axis, value, left, right = planes[node]
        low = x[at, axis] <= value
        for child, some in ((left, at[low]), (right, at[~low])):
            if child < 0:
                leaf[some] = -1 - child
            elif len(some):
                todo.append((child, some))
    return leaf


def _regions(base: DataFrame, rows: int) -> DataFrame:
    """``base`` with ``region``: leaves of a k-d tree whose planes come from a bounded sample (any planes do, they only
    decide how tight the boxes are). A leaf that holds far more than its share is dealt by the hash of the ids."""
    count = base.count()
    leaves = -(-count // (rows * REGION_BLOCKS))
    planes = []
    if leaves > 1:
        wanted = min(SAMPLE_ROWS, SAMPLE_PER_LEAF * leaves)
        sample = base.select("features").sample(min(1.0, wanted / count), seed=1).toPandas()["features"]
        if len(sample):
            planes = _planes(np.nan_to_num(np.stack(sample.to_list()).astype(np.float64)), leaves)

    @F.pandas_udf("long")
    def leaf(features: pd.Series) -> pd.Series:
        return pd.Series(_leaf_of(np.stack(features.to_list()).astype(np.float64), planes) if len(features) else [], dtype="int64")

    placed = base.withColumn("leaf", leaf("features") if planes else F.lit(0).cast("long"))
    most = REGION_ROOM * rows * REGION_BLOCKS
    large = {r["leaf"]: -(-r["count"] // most) for r in placed.groupBy("leaf").count().where(F.col("count") > most).collect()}
    deal = F.lit(0).cast("long")
    if large:
        parts = F.create_map(*[F.lit(v).cast("long") for kv in large.items() for v in kv])
        deal = F.pmod(F.xxhash64("point_id"), F.coalesce(F.get(F.array(parts), F.lit(0))[F.col("leaf")], F.lit(1).cast("long")))
    return placed.withColumn("region", F.col("leaf") * F.lit(1 << 20) + deal).drop("leaf")


def pack_blocks(points: DataFrame, rows: int = BLOCK_ROWS, near: bool = True) -> DataFrame:
    """Pack ``point_id``, ``features`` and ``tags`` (array<long>) into blocks of at most ``rows`` points.

    With ``near`` the blocks are leaves of a k-d tree: its upper planes deal the points to regions of about
    ``REGION_BLOCKS`` blocks, which are split further in one task each. Without, a block holds points of equal tags, as far
    as these go. The result is checkpointed: block numbers stay what they are.
    """
    base = points.select(F.col("point_id").cast("string").alias("point_id"), "features", "tags")
    if near:
        base = _regions(base, rows).repartition("region").sortWithinPartitions("region", "point_id")
    else:
        base = base.repartitionByRange("tags", "point_id").sortWithinPartitions("tags", "point_id").withColumn("region", F.lit(0).cast("long"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        held: list[pd.DataFrame] = []
        count, at = 0, None

        def blocks_of() -> Iterator[pd.DataFrame]:
            nonlocal first
            own = pd.concat(held)
            x = np.stack(own["features"].to_list()).astype(np.float64)
            for part in _split(x, rows) if near else [np.arange(len(own))]:
                yield _one_block(own.iloc[part], first)
                first += 1

        for batch in batches:
            for region, own in batch.groupby("region", sort=False):
                if region != at and held:
                    yield from blocks_of()
                    held, count = [], 0
                at = region
                while len(own):
                    take = own if near else own.iloc[: rows - count]
                    held.append(take)
                    count += len(take)
                    own = own.iloc[len(take) :]
                    if not near and count == rows:
                        yield from blocks_of()
                        held, count = [], 0
        if held:
            yield from blocks_of()

    return checkpointed(base.mapInPandas(pack, BLOCK_SCHEMA))


def _one_block(points: pd.DataFrame, number: int) -> pd.DataFrame:
    x = np.ascontiguousarray(np.stack(points["features"].to_list()), dtype=np.float64)
    tags = np.ascontiguousarray(np.stack(points["tags"].to_list()), dtype=np.int64)
    return pd.DataFrame(
        {
            "block": [number], "n": [len(points)], "ids": [points["point_id"].to_list()],
            "x": [x.tobytes()], "tags": [tags.tobytes()],
            "lo": [x.min(axis=0).tolist()], "hi": [x.max(axis=0).tolist()],
        }
    )


class Block:
    """One packed block inside a task."""

    __slots__ = ("number", "ids", "x", "tags")

    def __init__(self, row: Any):
        self.number, self.ids = row.other, row.ids
        self.x = np.frombuffer(row.x, dtype=np.float64).reshape(row.n, -1)
        self.tags = np.frombuffer(row.tags, dtype=np.int64).reshape(row.n, -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by direct differences: equal points are exactly 0 apart. In strips that stay in the cache."""
    total, axes = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    gap = np.empty((min(STRIP_ROWS, len(a)), len(b)))
    for at in range(0, len(a), STRIP_ROWS):
        part, strip = a[at : at + STRIP_ROWS], total[at : at + STRIP_ROWS]
        for axis in range(a.shape[1]):
            side = np.subtract(part[:, axis, None], axes[axis], out=gap[: len(part)])
            strip += np.multiply(side, side, out=side)
        np.sqrt(strip, out=strip)
    return total


def pair_distances(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``distances(a, b)[p, q]``, to the last bit."""
    total = np.zeros(len(p))
    for axis in range(a.shape[1]):
        side = a[p, axis] - b[q, axis]
        total += side * side
    return np.sqrt(total, out=total)


def near_squares(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray | None, np.ndarray | None]]:
    """Squared distances of strips of ``a`` by one matrix product, and by how much those of a row may be wrong at most; neither
    where the numbers are too large or missing."""
    shift = b.mean(axis=0) if len(b) else np.zeros(a.shape[1])
    moved, b = a - shift, b - shift
    a2, b2 = (moved * moved).sum(axis=1), (b * b).sum(axis=1)
    left = np.concatenate([moved, a2[:, None], np.ones((len(a), 1))], axis=1)
    right = np.concatenate([-2.0 * b.T, np.ones((1, len(b))), b2[None]])
    wrong = ROUNDING * (a2 + b2.max(initial=0.0))
    for at in range(0, len(a), NEAR_STRIP):
        part = slice(at, at + NEAR_STRIP)
        yield (part, left[part] @ right, wrong[part]) if np.isfinite(wrong[part]).all() else (part, None, None)


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """``distances(a, b) <= radius``; only pairs too close to the radius for the matrix product are measured one by one."""
    out = np.empty((len(a), len(b)), dtype=bool)
    for part, square, wrong in near_squares(a, b):
        if square is not None:
            slack = (wrong + ROUNDING * radius * radius)[:, None]
            near = np.less_equal(square, radius * radius + slack, out=out[part])
            p, q = np.nonzero(near & (square >= radius * radius - slack))
            if len(p) <= near.size // FEW:
                near[p, q] = pair_distances(a[part], b, p, q) <= radius
                continue
        out[part] = distances(a[part], b) <= radius
    return out


def nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``distances(a, b).min(axis=1)``; only the pairs that may be the nearest are measured one by one."""
    out = np.full(len(a), np.inf)
    for part, square, wrong in near_squares(a, b):
        if square is not None:
            p, q = np.nonzero(square <= (square.min(axis=1) + 2 * wrong)[:, None])
            if len(p) <= square.size // FEW + len(square):
                np.minimum.at(out[part], p, pair_distances(a[part], b, p, q))
                continue
        out[part] = distances(a[part], b).min(axis=1)
    return out


def distance_sums(a: np.ndarray, b: np.ndarray, member: np.ndarray) -> np.ndarray:
    """``distances(a, b) @ member``, with the squares of a strip from one matrix product.

    The product loses digits where points are close beside their spread; those squares are taken from the differences, so
    equal points are exactly 0 apart and the others right to about nine digits.
    """
    shift = np.nan_to_num(b.mean(axis=0))
    a, b = a - shift, b - shift
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    left = np.concatenate([a, a2[:, None], np.ones((len(a), 1))], axis=1)
    right = np.concatenate([-2.0 * b.T, np.ones((1, len(b))), b2[None]])
    close = CLOSE * (a2 + np.nan_to_num(b2).max())
    out = np.empty((len(a), member.shape[1]))
    for at in range(0, len(a), STRIP_ROWS):
        part = slice(at, at + STRIP_ROWS)
        square = left[part] @ right
        limit = close[part]
        if (square.min(axis=1) <= limit).any():
            p, q = np.nonzero(square <= limit[:, None])
            gap = a[part][p] - b[q]
            square[p, q] = (gap * gap).sum(axis=1)
        np.sqrt(square, out=square)
        np.matmul(square, member, out=out[part])
    return out


def mutual_sums(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``distances(a, b) @ of_b`` and ``distances(a, b).T @ of_a``: as ``distance_sums``, with every distance taken once for both."""
    shift = np.nan_to_num(b.mean(axis=0))
    a, b = a - shift, b - shift
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    left = np.concatenate([a, a2[:, None], np.ones((len(a), 1))], axis=1)
    right = np.concatenate([-2.0 * b.T, np.ones((1, len(b))), b2[None]])
    close = CLOSE * (a2 + np.nan_to_num(b2).max())
    for_a, for_b = np.empty((len(a), of_b.shape[1])), np.zeros((len(b), of_a.shape[1]))
    room = np.empty((min(STRIP_ROWS, len(a)), len(b)))
    for at in range(0, len(a), STRIP_ROWS):
        part = slice(at, at + STRIP_ROWS)
        square = np.matmul(left[part], right, out=room[: len(left[part])])
        limit = close[part]
        if (square.min(axis=1) <= limit).any():
            p, q = np.nonzero(square <= limit[:, None])
            gap = a[part][p] - b[q]
            square[p, q] = (gap * gap).sum(axis=1)
        np.sqrt(square, out=square)
        np.matmul(square, of_b, out=for_a[part])
        for_b += (of_a[part].T @ square).T
    return for_a, for_b


def each_block(blocks: DataFrame, work: Callable[[Block], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on every block by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield work(Block(row))

    return blocks.select(F.col("block").alias("other"), "n", "ids", "x", "tags").mapInPandas(run, schema)


class Ask:
    """Points of block ``own`` that want to hear from another block: their positions, coordinates and tags."""

    __slots__ = ("own", "positions", "x", "tags")

    def __init__(self, row: Any):
        self.own = row.own
        self.positions = np.frombuffer(row.positions, dtype=np.int64)
        self.x = np.frombuffer(row.x, dtype=np.float64).reshape(len(self.positions), -1)
        self.tags = np.frombuffer(row.tags, dtype=np.int64).reshape(len(self.positions), -1)


class Asks:
    """Several asks of one block as one: their points one after another, and where each ask begins and the last one ends."""

    __slots__ = ("parts", "starts", "x", "tags")

    def __init__(self, parts: list[Ask]):
        self.parts = parts
        self.starts = np.cumsum([0, *(len(a.positions) for a in parts)])
        self.x, self.tags = np.concatenate([a.x for a in parts]), np.concatenate([a.tags for a in parts])


def _dealt(stream: DataFrame, key: str, count: int) -> DataFrame:
    """``stream`` by ``key``: few blocks are left to adaptive execution, of many a task takes ``TASK_BLOCKS``."""
    tasks = -(-count // TASK_BLOCKS)
    return stream.repartition(tasks, key) if tasks > FEW_TASKS else stream.repartition(key)


def meet(
    blocks: DataFrame,
    start: Callable[[Block], Any],
    wanted: Callable[..., np.ndarray],
    answer: Callable[[Block, Ask], pd.DataFrame] | None,
    schema: str,
    answers: Callable[[Block, Asks], pd.DataFrame] | None = None,
) -> DataFrame:
    """Points visit the other blocks that may matter to them; ``answer`` makes rows of a block and the points that came,
    ``answers`` those of several asks in one go.

    ``wanted(state, own, positions, square, least)`` says which of the own block's points want to visit a box at that
    squared distance whose smallest first tag is ``least``; the arrays broadcast. It must not grow with the distance.
    The boxes, a row for a whole block, are known to every task; of the points only those travel that want to.
    """
    boxes = each_block(
        blocks,
        lambda own: pd.DataFrame({
            "block": [own.number], "least": [int(own.tags[:, 0].min())], "lo": [own.x.min(axis=0).tolist()], "hi": [own.x.max(axis=0).tolist()],
        }),
        "block long, least long, lo array<double>, hi array<double>",
    ).toPandas()
    number, least = boxes["block"].to_numpy(dtype=np.int64), boxes["least"].to_numpy(dtype=np.int64)
    lo, hi = (np.array(boxes[c].to_list(), dtype=np.float64).reshape(len(boxes), -1) for c in ("lo", "hi"))

    def asks_of(own: Block) -> pd.DataFrame:
        state = start(own)
        apart = np.maximum(0.0, np.maximum(lo - own.x.max(axis=0), own.x.min(axis=0) - hi))
        square = (apart * apart).sum(axis=1)
        p, q = np.nonzero(wanted(state, own, np.arange(len(own.x))[:, None], square[None, :], least[None, :]) & (number != own.number)[None, :])
        square = np.zeros(len(p))
        for i in range(lo.shape[1]):
            x = own.x[p, i]
            side = np.maximum(0.0, np.maximum(lo[q, i] - x, x - hi[q, i]))
            square += side * side
        stay = wanted(state, own, p, square, least[q])
        p, q = p[stay], q[stay]
        order = np.argsort(q, kind="stable")
        p, q = p[order].astype(np.int64), q[order]
        rows = []
        for some in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1) if len(q) else []:
            at = p[some]
            rows.append((int(number[q[some[0]]]), own.number, at.tobytes(), own.x[at].tobytes(), own.tags[at].tobytes()))
        return pd.DataFrame(rows, columns=["other", "own", "positions", "x", "tags"])

    asks = each_block(blocks, asks_of, "other long, own long, positions binary, x binary, tags binary")
    hosts = blocks.select(F.col("block").alias("other"), F.lit(0).alias("kind"), "n", "x", "tags")
    guests = asks.withColumn("kind", F.lit(1))
    stream = _dealt(hosts.unionByName(guests, allowMissingColumns=True), "other", len(boxes)).sortWithinPartitions("other", "kind", "own")
    every = answers or (lambda host, asks: pd.concat([answer(host, ask) for ask in asks.parts]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, held, points, found = None, [], 0, []
        for batch in batches:
            for row in batch.assign(ids=None).itertuples(index=False):
                if held and (row.kind == 0 or points >= ASK_POINTS):
                    found.append(every(host, Asks(held)))
                    held, points = [], 0
                if row.kind == 0:
                    host = Block(row._replace(n=int(row.n)))
                else:
                    held.append(Ask(row._replace(own=int(row.own))))
                    points += len(held[-1].positions)
                if len(found) >= ANSWER_FRAMES:
                    yield pd.concat(found)
                    found = []
        if held:
            found.append(every(host, Asks(held)))
        if found:
            yield pd.concat(found)

    return stream.mapInPandas(run, schema)


def fold_near(
    blocks: DataFrame,
    start: Callable[[Block], Any],
    wanted: Callable[..., np.ndarray],
    answer: Callable[[Block, Asks], np.ndarray],
    merge: Callable[[Any, np.ndarray, np.ndarray], None],
    finish: Callable[[Any, Block], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """For each own block: ``start`` a state from its own points, ``merge`` in what the blocks of ``wanted`` (as in ``meet``)
    answer to its points, ``finish`` it into rows. An answer is an array with an entry for every point that asked."""

    def packed(host: Block, asks: Asks) -> pd.DataFrame:
        found = np.ascontiguousarray(answer(host, asks))
        kind = str(found.dtype.descr if found.dtype.names else found.dtype.str)
        return pd.DataFrame({
            "own": [a.own for a in asks.parts], "other": host.number, "positions": [a.positions.tobytes() for a in asks.parts],
            "answer": [found[p:q].tobytes() for p, q in zip(asks.starts, asks.starts[1:])], "type": kind,
        })

    answers = meet(blocks, start, wanted, None, "own long, other long, positions binary, answer binary, type string", packed)
    own = blocks.select(F.col("block").alias("own"), "n", "ids", "x", "tags")
    stream = _dealt(own.unionByName(answers, allowMissingColumns=True), "own", blocks.count()).sortWithinPartitions(
        "own", F.col("other").asc_nulls_first()
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, state = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.positions is None:
                    if mine is not None:
                        yield finish(state, mine)
                    mine = Block(row._replace(n=int(row.n), other=row.own))
                    state = start(mine)
                else:
                    kind = np.dtype(literal_eval(row.type) if row.type[0] == "[" else row.type)
                    merge(state, np.frombuffer(row.positions, dtype=np.int64), np.frombuffer(row.answer, dtype=kind))
        if mine is not None:
            yield finish(state, mine)

    return stream.mapInPandas(run, schema)


def fold_all(
    blocks: DataFrame,
    start: Callable[[Block], np.ndarray],
    fold: Callable[[np.ndarray, Block, Block], None],
    finish: Callable[[np.ndarray, Block], pd.DataFrame],
    schema: str,
    side: int | None = None,
    mutual: Callable[[np.ndarray, Block, np.ndarray, Block], None] | None = None,
) -> DataFrame:
    """``fold`` every block into a state for each own block, where states are arrays that add up.

    The pairs of blocks form a square that is cut into tiles of ``side`` x ``side``, of which those on and above the diagonal
    are tasks: one holds the own blocks of its row, with their states, reads the blocks of its column as a stream, and folds
    every pair into the states of both, at once where ``mutual`` (state, own, other state, other) can. With g tiles along a
    side every block travels g + 1 times, as does its state. The states of a block are then added up, in the order of the
    tiles. Without ``side``, g is what keeps the cores busy, or more, as a task holds no more than ``TILE_BYTES``.
    """
    count, points, most = blocks.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).head()
    if side is None:
        one = blocks.select(F.col("block").alias("other"), "n", F.lit(None).alias("ids"), "x", "tags").where(F.col("n") == most).head()
        held = (len(one.x) + len(one.tags) + 8 * np.size(start(Block(one)))) / most if one else 1
        wanted = math.isqrt(2 * TILES_PER_CORE * blocks.sparkSession.sparkContext.defaultParallelism)
        side = -(-count // max(wanted, math.ceil((points or 0) / min(TILE_POINTS, TILE_BYTES / held)), 1)) or 1
    tiles = max(1, -(-count // side))
    group = F.pmod(F.xxhash64("block"), F.lit(tiles)).cast("int")
    columns = ["block", "n", "x", "tags"]
    tile_of = lambda row, col: row * F.lit(tiles) - F.expr("row * (row - 1) / 2").cast("int") + col - row
    rows = blocks.select(group.alias("row"), F.explode(F.sequence(group, F.lit(tiles - 1))).alias("col"), F.lit(0).alias("kind"), *columns)
    cols = blocks.select(F.explode(F.sequence(F.lit(0), group)).alias("row"), group.alias("col"), F.lit(1).alias("kind"), *columns)
    by_tile = (
        rows.unionByName(cols).withColumn("tile", tile_of(F.col("row"), F.col("col")))
        .repartitionById(tiles * (tiles + 1) // 2, F.col("tile")).sortWithinPartitions("tile", "kind", "block")
    )

    def both(state: np.ndarray, own: Block, other_state: np.ndarray, other: Block) -> None:
        fold(state, own, other)
        fold(other_state, other, own)

    meeting = mutual or both

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def found(pairs: list[tuple[Block, np.ndarray]], kind: int) -> pd.DataFrame:
            return pd.DataFrame({"own": [b.number for b, _ in pairs], "tile": at, "kind": kind, "state": [s.tobytes() for _, s in pairs]})

        for batch in batches:
            for row in batch.assign(ids=None, other=batch["block"]).itertuples(index=False):
                if row.tile != at:
                    if held:
                        yield found(held, 0)
                    at, held = row.tile, []
                block = Block(row)
                state = np.ascontiguousarray(start(block), dtype=np.float64)
                if row.kind == 0:
                    held.append((block, state))
                    continue
                for own, own_state in held:
                    if row.row != row.col or own.number < block.number:
                        meeting(own_state, own, state, block)
                    elif own.number == block.number:
                        fold(own_state, own, block)
                yield found([(block, state)], 1)
        if held:
            yield found(held, 0)

    parts = by_tile.mapInPandas(tile, "own long, tile int, kind int, state binary")
    empty = F.lit(None).cast("binary")
    own = blocks.select(F.col("block").alias("own"), F.lit(-1).alias("tile"), F.lit(-1).alias("kind"), empty.alias("state"), "n", "ids", "x", "tags")
    stream = own.unionByName(parts, allowMissingColumns=True).repartition("own").sortWithinPartitions("own", "tile", "kind")

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, state = None, None
        for batch in batches:
            for row in batch.assign(other=batch["own"]).itertuples(index=False):
                if row.state is None:
                    if mine is not None:
                        yield finish(state, mine)
                    mine = Block(row._replace(n=int(row.n)))
                    state = np.ascontiguousarray(start(mine), dtype=np.float64)
                else:
                    state += np.frombuffer(row.state, dtype=np.float64).reshape(state.shape)
        if mine is not None:
            yield finish(state, mine)

    return stream.mapInPandas(total, schema)
