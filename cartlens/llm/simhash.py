"""SimHash near-duplicates by segment popcounts: a grid range join, exact checks, and connected components.

A fingerprint has 64 bits; two fingerprints link if at most ``max_bits`` (3) differ. The 32 two-bit segments of a
fingerprint give a vector of popcounts (0 to 2 each), and the Manhattan distance of two vectors never exceeds the
number of differing bits. Of the two halves of a linked pair one has a popcount distance of at most 1. So each
distinct fingerprint is placed in two cells of a grid, the popcount vectors of its halves, and looks into the cells
one step away; two vectors one step apart differ in the parity of their sum, so only the odd one has to look.
Whatever shares a cell is compared exactly.

Hot groups: copies share a fingerprint and are one row before any join. A cell with many different fingerprints is
compared in one sweep that reports a spanning forest, not all pairs; cells above ``CELL_ROWS`` are cut into blocks,
and each pair of blocks is a task of its own. No pair is left out.

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle make one
shingle. Rows without doc_id are fingerprinted and linked, and never name a component; a component with no id at all
has a null component_id. Repeated rows are kept. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import table, wrapped
from cartlens.llm.components import connected
from cartlens.session import checkpointed

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42

# More fingerprints than this in one cell are compared block by block.
CELL_ROWS = 4096
# Runs up to this length are compared by shifting the sorted column; longer ones by a sweep.
SHORT_RUN = 12


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit integer. bytes.lower and bytes.split know ASCII only, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(s, seed) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits for long texts
        block = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(shingle_words: int):
    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return udf


def fingerprinted(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` as struct ``row``, beside ``fp`` (long)."""
    df = wrapped(docs, _text=text)
    return df.select("row", _fingerprints(shingle_words)(F.col("_text").cast("string")).alias("fp"))


def _popcounts(half: Column) -> Column:
    """The popcounts of the 16 two-bit segments of a 32-bit half, two bits each: the usual first step of a popcount."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))


def cells(prints: DataFrame) -> DataFrame:
    """(cell, home, fp): the cells of every fingerprint; ``home`` is false where it looks into a neighbour cell."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    grid = prints.select("fp", F.posexplode(F.array(low, high)).alias("half", "bits")).select(
        "fp", "half", _popcounts(F.col("bits")).alias("v"), (F.bit_count("bits") % 2 == 1).alias("odd")
    )
    steps = []
    for s in range(16):
        count = F.shiftright("v", 2 * s).bitwiseAND(F.lit(3))
        one = F.lit(1 << (2 * s))
        steps += [F.when(F.col("odd") & (count < 2), F.col("v") + one), F.when(F.col("odd") & (count > 0), F.col("v") - one)]
    return (
        grid.withColumn("to", F.array_compact(F.array(F.col("v"), *steps)))
        .select("fp", "half", F.posexplode("to").alias("at", "v"))
        .select((F.col("v") + F.col("half") * F.lit(1 << 32)).alias("cell"), (F.col("at") == 0).alias("home"), "fp")
    )


def _split_hot(rows: DataFrame, cell_rows: int) -> DataFrame:
    """(cell, block, fp): rows of cells with too many fingerprints go to every pair of blocks they belong to."""
    hot = checkpointed(
        rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
        .select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks"))
    )
    if hot.isEmpty():
        return rows.select("cell", F.lit(0).alias("block"), "fp")
    own = F.pmod(F.hash("fp"), F.col("blocks"))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(own, k) * F.col("blocks") + F.greatest(own, k)
    )
    return rows.join(hot, "cell", "left").select(
        "cell", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("block"), "fp"
    )


def _bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # bitwise_count takes the absolute value of signed numbers.
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among ``fps``: each reached fingerprint looks at the unreached ones only."""
    left, found = np.unique(fps), []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _bits_between(left, at) <= max_bits
            if near.any():
                reached, left = left[near], left[~near]
                found.append((np.full(len(reached), at), reached))
                frontier.extend(reached)
    return found


def _linker(max_bits: int):
    """Links within the cells of a partition sorted by (cell, block); a run may span batches."""

    def settle(cell, block, fps):
        edges = []
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])])
        lengths = np.diff(np.r_[starts, len(cell)])
        short = np.repeat(lengths <= SHORT_RUN, lengths)
        run = np.repeat(np.arange(len(starts)), lengths)
        for d in range(1, SHORT_RUN):
            i = np.flatnonzero((run[d:] == run[:-d]) & short[d:])
            if not len(i):
                break
            i = i[_bits_between(fps[i], fps[i + d]) <= max_bits]
            edges.append((fps[i], fps[i + d]))
        for s, n in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN]):
            edges += _forest(fps[s : s + n], max_bits)
        u = np.concatenate([e[0] for e in edges]) if edges else np.empty(0, np.int64)
        v = np.concatenate([e[1] for e in edges]) if edges else np.empty(0, np.int64)
        different = u != v
        return pd.DataFrame({"u": u[different], "v": v[different]}).drop_duplicates()

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        for batch in batches:
            now = [batch[c].to_numpy(dtype=np.int64) for c in ("cell", "block", "fp")]
            if not len(now[0]):
                continue
            kept = [np.concatenate(x) for x in zip(kept, now)]
            # The last run may go on in the next batch.
            same = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield settle(*(x[:cut] for x in kept))
                kept = [x[cut:] for x in kept]
        if len(kept[0]):
            yield settle(*kept)

    return link


def links(prints: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(u, v): links between different fingerprints of ``prints`` (fp), enough of them to connect what links connect."""
    if not 0 <= max_bits <= 3:
        raise ValueError("one half within a popcount distance of 1 is only certain up to 3 bits")
    rows = _split_hot(cells(prints), cell_rows)
    placed = rows.repartition("cell", "block").sortWithinPartitions("cell", "block")
    return placed.mapInPandas(_linker(max_bits), "u long, v long")


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(doc_id, fp, component_fp, component_id), one row per row of ``docs``.

    ``component_fp`` is the smallest fingerprint of the component, ``component_id`` its smallest doc_id.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = checkpointed(fingerprinted(own, shingle_words=shingle_words).select("row.doc_id", "fp"))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    component = connected(links(distinct.select("fp"), max_bits, cell_rows))
    labelled = distinct.join(component.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("component_fp")
    )
    # A component of one fingerprint needs no sum over the others.
    named = labelled.groupBy("component_fp").agg(F.min("first_id").alias("component_id"))
    of_print = checkpointed(labelled.join(named, "component_fp").select("fp", "component_fp", "component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_fp", "component_id")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: fingerprint and component of every document."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: the row with the smallest doc_id of each component, unchanged.

    Where several rows share that doc_id (or none has one), one of them stays.
    """
    chosen = (
        classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("doc_id", "component_fp").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"))
    )
    chosen = checkpointed(chosen)
    rows = wrapped(docs, _id="doc_id")
    single = chosen.where("n = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"))
    kept = rows.join(single, "_id", "left_semi").select("row.*")
    doubtful = chosen.where("n > 1 OR doc_id IS NULL")
    if doubtful.isEmpty():
        return kept
    again = fingerprinted(docs).join(
        doubtful.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")),
        F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")),
    ).dropDuplicates(["_id", "_fp"])
    return kept.unionByName(again.select("row.*"))
