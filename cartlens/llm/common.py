"""What the corpus operators share: reading tables, words, private names, state that lives as long as a worker."""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import cartlens

# Executors need no copy of the package: task functions travel with the task.
cloudpickle.register_pickle_by_value(cartlens)

# Words are runs of anything but the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of ``text``, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACES), "")


def wrapped(df: DataFrame, **columns: str) -> DataFrame:
    """All columns of ``df`` in one struct ``row``, beside the named ones under the operator's own names.

    Extra input columns can then not clash with what an operator adds; ``select("row.*")`` restores them.
    """
    return df.select(F.struct("*").alias("row"), *[F.col(c).alias(name) for name, c in columns.items()])


def worker_state(kind: str, key, make):
    """The value for ``key``, made once per Python worker and kept between its tasks; one value per ``kind``.

    Broadcasts hold plain data only (their classes would have to be installed on the executors); what tasks
    build from them is kept here.
    """
    module = sys.modules.setdefault("_cartlens_worker_state", types.ModuleType("_cartlens_worker_state"))
    store = module.__dict__.setdefault("store", {})
    if kind not in store or store[kind][0] != key:
        store[kind] = (key, make())
    return store[kind][1]


class BoundedCache(dict):
    """A dict that computes missing entries and holds at most twice ``limit`` of them.

    Entries are young or old; a full young generation becomes the old one, and old entries that are used become
    young again. What is used often stays. Results do not depend on the limit.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
