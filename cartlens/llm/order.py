"""Places, running aggregates and joins for groups of any size: no group has to fit in one task.

Lists that are too long for one window are cut: by the partitions of a range shuffle for numbering, by blocks of places
for running aggregates. What lies before a part comes from one small row per part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.session import checkpointed

# Places of a group that one window holds.
BLOCK = 1024
# Keys with at least one in so many rows are joined by broadcast: there can be no more than HOT of them.
HOT = 1000


def numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place from 0 of a row among those of its key by ``order`` (nulls first), and ``n``, the
    rows of the key. Key columns hold no nulls.

    The range shuffle deals a long group over several partitions in order, so a window sees only one partition's part.
    """
    ranged = checkpointed(rows.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy(*key)
    parts = ranged.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        *key, "_part", (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    here = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order))
    return (
        ranged.withColumn("at", here).join(parts, [*key, "_part"])
        .withColumn("at", F.col("at") - 1 + F.col("_before")).drop("_part", "_before")
    )


def running(rows: DataFrame, key: str, at: str, length: str, folds: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with an aggregate over the rows of the same key up to place ``at``, itself included, for each entry
    ``name: (column, kind)`` of ``folds``; ``kind`` is ``sum`` or ``bit_xor``.

    ``length`` is a bound on ``at`` that all rows of a key share. Keys of one block need one window; for longer ones
    the totals of the blocks before are joined.
    """
    of = {"sum": F.sum, "bit_xor": F.bit_xor}
    add = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    rows = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    inside = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    inner = checkpointed(rows.select("*", *[of[k](c).over(inside).alias(n) for n, (c, k) in folds.items()]))
    long = inner.where(F.col(length) >= BLOCK)
    totals = long.groupBy(key, "_block").agg(*[of[k](c).alias(f"_{n}") for n, (c, k) in folds.items()])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        key, "_block", *[F.coalesce(of[k](f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n, (c, k) in folds.items()]
    )
    later = long.join(offsets, [key, "_block"]).select(
        *[c for c in inner.columns if c not in folds],
        *[add[k](F.col(n), F.col(f"_{n}")).alias(n) for n, (c, k) in folds.items()],
    )
    return inner.where(F.col(length) < BLOCK).unionByName(later).drop("_block")


def with_each(rows: DataFrame, table: DataFrame, key: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row per key; ``weight`` is the number of ``rows`` with that key).

    Keys that hold a thousandth of the rows are few by their share, and are broadcast; the others shuffle.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) * HOT >= total)
    rest = table.where(F.col(weight) * HOT < total)
    first = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    added = [c for c in table.columns if c not in key]
    return first.where("_hot").drop("_hot").unionByName(
        first.where("_hot IS NULL").drop("_hot", *added).join(rest, key)
    )
