"""Benchmark decontamination by greedy string tiling.

A text leaks a benchmark item if non-overlapping matching passages (tiles) cover most of the item's words, in
whatever order the text has them. Seeds, the five-word sequences of the items, find the candidates; greedy tiling
then marks the longest common unmarked passage on both sides again and again; running Karp-Rabin hashes find the
passages, down to five words. Words are runs of ASCII letters, digits and non-ASCII
characters, in ASCII lower case, so punctuation and line breaks don't matter.

The documents are read once and never shuffled, however often a passage occurs: what a document needs of the
benchmark comes to it. The benchmark is a stated query set; it goes to the tasks in blocks of at most
``BLOCK_WORDS`` words, each block one more set of expressions over the same rows, so no broadcast grows with it.

Defined cases: null and empty texts leak nothing; so do items without words. Items of fewer than five words leak
where their whole word sequence occurs. Items that repeat (same id, or same text under two ids) are all reported. Rows
without doc_id and repeated rows are reported like others. Empty tables give an empty result. Extra columns are kept
by the stage and ignored by the query.
"""

from __future__ import annotations

import heapq
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import table, worker_state, wrapped

SEED_WORDS = 5
MIN_COVERAGE = 0.8
# The bound of one broadcast: words of benchmark text in a block.
BLOCK_WORDS = 500_000

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TILES = (
    "array<struct<item_id:bigint,item_words:int,covered_words:int,"
    "tiles:array<struct<doc_start:int,item_start:int,length:int>>>>"
)

_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _rolling(tokens: list[int], length: int):
    """(start, Karp-Rabin hash) of every sequence of ``length`` tokens."""
    first, h = pow(_BASE, length - 1, _MOD), 0
    for i, t in enumerate(tokens):
        if i >= length:
            h = (h - (tokens[i - length] + 2) * first) % _MOD
        h = (h * _BASE + t + 2) % _MOD
        if i >= length - 1:
            yield i - length + 1, h


def greedy_tiles(doc: list[int], item: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the tiles, longest first; equal lengths in order of their starts.

    Rolling hashes give the places where ``min_words`` words agree; each passage is grown to its full length once.
    The longest one is marked on both sides, and what marks have cut into goes back with its free parts, until
    nothing of ``min_words`` words is left. A negative number in ``doc`` matches nothing.
    """
    at: dict[int, list[int]] = {}
    for j, h in _rolling(item, min_words):
        at.setdefault(h, []).append(j)
    heap = []
    for i, h in _rolling(doc, min_words):
        for j in at.get(h, ()):
            if (i == 0 or j == 0 or doc[i - 1] != item[j - 1]) and doc[i : i + min_words] == item[j : j + min_words]:
                n, most = min_words, min(len(doc) - i, len(item) - j)
                while n < most and doc[i + n] == item[j + n]:
                    n += 1
                heap.append((-n, i, j))
    heapq.heapify(heap)
    doc_marked, item_marked, tiles = bytearray(len(doc)), bytearray(len(item)), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [not (a or b) for a, b in zip(doc_marked[i : i + n], item_marked[j : j + n])]
        if all(free):
            doc_marked[i : i + n] = item_marked[j : j + n] = b"\x01" * n
            tiles.append((i, j, n))
            continue
        run = 0
        for k, f in enumerate([*free, False]):
            if f:
                run += 1
                continue
            if run >= min_words:
                heapq.heappush(heap, (-run, i + k - run, j + k - run))
            run = 0
    return tiles


class Benchmark:
    """One block of items, ready for the tasks: their words as numbers, and their seeds."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int):
        self.seed_words = seed_words
        self.items = [(item_id, words(text)) for item_id, text in items]
        self.items = [(item_id, ws) for item_id, ws in self.items if ws]
        self.seeds: dict[int, dict[tuple, set[int]]] = {}
        for n, (_, ws) in enumerate(self.items):
            size = min(seed_words, len(ws))
            for i in range(len(ws) - size + 1):
                self.seeds.setdefault(size, {}).setdefault(tuple(ws[i : i + size]), set()).add(n)
        self.keys = {size: set(seeds) for size, seeds in self.seeds.items()}

    def leaks(self, text: str | None, min_coverage: float) -> list[tuple]:
        ws = words(text)
        candidates: set[int] = set()
        for size, keys in self.keys.items():
            for seed in keys.intersection(zip(*(ws[i:] for i in range(size)))):
                candidates |= self.seeds[size][seed]
        found = []
        for n in sorted(candidates):
            item_id, item = self.items[n]
            size = min(self.seed_words, len(item))
            numbers: dict[bytes, int] = {}
            item_numbers = [numbers.setdefault(w, len(numbers)) for w in item]
            own = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
            zone, until, kept, places = [], 0, [], []
            # Tiles consist of seeds: only the passages that seeds cover are tiled.
            for i, gram in enumerate(zip(*(ws[k:] for k in range(size)))):
                if gram in own:
                    if i > until and kept:
                        kept.append(-1)
                        places.append(-1)
                    for k in range(max(i, until), i + size):
                        kept.append(numbers[ws[k]])
                        places.append(k)
                    until = i + size
            tiles = [(places[i], j, n_) for i, j, n_ in greedy_tiles(kept, item_numbers, size)]
            covered = sum(t[2] for t in tiles)
            if covered >= min_coverage * len(item):
                found.append((item_id, len(item), covered, tiles))
        return found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    """Blocks of items with about ``block_words`` words each. The items stream through the driver block by block."""
    block, size = [], 0
    items = benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string"))
    for key, value in items.toLocalIterator():
        block.append((key, value))
        size += len(value or "") // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _leaks_of(n: int, shared, seed_words: int, min_coverage: float):
    key = uuid.uuid4().hex

    @F.pandas_udf(TILES)
    def udf(texts: pd.Series) -> pd.Series:
        leaks = worker_state(f"benchmark {n}", key, lambda: Benchmark(shared.value, seed_words)).leaks
        return pd.Series([
            [
                {
                    "item_id": i, "item_words": size, "covered_words": c,
                    "tiles": [{"doc_start": a, "item_start": b, "length": k} for a, b, k in tiles],
                }
                for i, size, c, tiles in leaks(t, min_coverage)
            ]
            for t in texts
        ], dtype=object)

    return udf


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    seed_words: int = SEED_WORDS, min_coverage: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` as struct ``row``, beside ``leaks``: the items that the text covers, with their tiles."""
    found = wrapped(docs, _text=text).withColumn("leaks", F.array().cast(TILES))
    for n, block in enumerate(_blocks(benchmark, item_id, item_text, block_words)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        leaks = _leaks_of(n, shared, seed_words, min_coverage)(F.col("_text").cast("string"))
        found = found.withColumn("leaks", F.concat("leaks", leaks))
    return found.select("row", "leaks")


def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: one row per document and benchmark item that leaks into it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") > 0).select("row.doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.item_words", "leak.covered_words",
        F.size("leak.tiles").alias("n_tiles"),
        F.array_max(F.transform("leak.tiles", lambda t: t["length"])).alias("longest_tile"),
        (F.col("leak.covered_words") / F.col("leak.item_words")).alias("coverage"),
    )


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: the documents that leak no item, unchanged."""
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select("row.*")
