"""The trie of conversation prefixes: which conversations begin alike, and how many words sharing the prefixes saves.

A node is a distinct sequence of first turns (role, text). Every turn of a conversation stands for the prefix that ends
with it; the prefix has a digest, the exclusive or of hashes of place and turn, which is a running aggregate and so
works for conversations of any length. A count-min sketch over the digests, two rows of counters, estimates how often each occurs. An estimate of one proves
that no other conversation has the prefix: its node is emitted where the row is read, and only what may be shared
shuffles for exact grouping. The sketch is built sparsely in every task and merged by segments of counters; what is
broadcast is one bit per counter ("two or more"), ``MAX_SEGMENTS`` x 8 KB at most. A full sketch proves less and lets more rows shuffle,
with the same results.

Sums over subtrees need no rounds: a node belongs to its smallest member. A conversation adds what the nodes it owns
hold, from the end towards each of its prefixes, as running sums; these are added up per node.

Turns are equal if 128 bits of the SHA-256 of role and text are; that nodes of equal digest have equal last turns and
equal parents is checked, and the digests are salted anew if not.

Defined cases: null role or text is empty; turns are ordered by turn (null first), then by digest; equal rows are
several turns. Rows without conv_id belong to no conversation. For negative ids, % keeps the sign, as in SQL. Repeated conversations are members of the same nodes.
An empty table has no node. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import table
from cartlens.llm.order import numbered, running, with_each
from cartlens.session import checkpointed

# Counters in a segment of the sketch, and the most segments: the bound of the broadcast.
CELLS = 1 << 16
MAX_SEGMENTS = 4096
# Counters a task holds before it hands them on.
HELD_CELLS = 1 << 20
# Neighbouring ids in one part of a list of ends: 2 to this power.
ENDS_BITS = 9
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["pos", "p1", "p2"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, words): turns by digest, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("_sha"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).select("conv_id", "turn", *[F.conv(F.substring("_sha", a, 16), 16, -10).cast("long").alias(t) for a, t in ((1, "t1"), (17, "t2"))],
             "words")


def with_heads(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, len, t1, t2, words): conversations that begin with turns of the first one of their twenty.

    Of ``turns`` (conv_id, turn, t1, t2, words), the first h of a conversation are replaced by the first h of
    conversation conv_id - conv_id % 20; h is the CRC32 of the decimal conv_id, modulo 4. ``pos`` counts from 1; every
    conversation also has a row at 0, the root.
    """
    ordered = checkpointed(numbered(turns, ["conv_id"], ["turn", "t1", "t2"]))
    convs = ordered.where("at = 0").select(
        "conv_id", "n", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 20).alias("base"),
    )
    bases = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = checkpointed(convs.join(bases, "base", "left").select(
        "conv_id", "n", "h", "base", head.alias("head"), (head + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")
    ))
    turn = ["t1", "t2", "words"]
    own = with_each(ordered.drop("turn", "n"), convs.select("conv_id", "n", "h", "head", "len"), ["conv_id"], "n").where("at >= h").select(
        "conv_id", (F.col("at") + 1 - F.col("h") + F.col("head")).alias("pos"), "len", *turn
    )
    firsts = ordered.where("conv_id % 20 = 0 AND at < 3").select(F.col("conv_id").alias("base"), "at", *turn)
    heads = convs.where("head > 0").select("conv_id", "base", "head", "len").join(firsts, "base").where("at < head").select(
        "conv_id", (F.col("at") + 1).alias("pos"), "len", *turn
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("pos"), "len", *[zero.alias(c) for c in turn])
    return own.unionByName(heads).unionByName(roots)


def _cells(p1: np.ndarray, p2: np.ndarray, half: int) -> np.ndarray:
    """The counter of each digest in the two rows of the sketch."""
    return np.stack([p1.view(np.uint64) % np.uint64(half), p2.view(np.uint64) % np.uint64(half) + np.uint64(half)]).astype(np.int64)


def sketch(digests: DataFrame) -> np.ndarray:
    """One bit per counter of a count-min sketch over the rows (p1, p2): whether it counts two or more."""
    count = digests.count()
    # Four counters a digest in each row, as far as the bound allows.
    segments = min(MAX_SEGMENTS, 2 << max(0, (4 * count // CELLS).bit_length()))
    half = segments * CELLS // 2
    columns = ["segment", "once", "more"]

    def parts(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.flatnonzero(np.diff(cells // CELLS)) + 1
        rows = [(int(c[0] // CELLS), (c[k == 1] % CELLS).astype("<u2").tobytes(), (c[k > 1] % CELLS).astype("<u2").tobytes())
                for c, k in zip(np.split(cells, cuts), np.split(counts, cuts))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], columns)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_cells(batch["p1"].to_numpy(), batch["p2"].to_numpy(), half).ravel())
                size += len(held[-1])
            if size >= HELD_CELLS:
                yield parts(held)
                held, size = [], 0
        if size:
            yield parts(held)

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, dtype=np.uint8)
        for batch in batches:
            for once, more in zip(batch["once"].to_pylist(), batch["more"].to_pylist()):
                places = np.frombuffer(once, "<u2")
                seen[places] = np.minimum(seen[places] + 1, 2)
                seen[np.frombuffer(more, "<u2")] = 2
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(seen > 1).tobytes()])], ["segment", "bits"])

    parts_of = digests.select("p1", "p2").mapInArrow(counted, "segment long, once binary, more binary")
    bits = np.zeros(segments * CELLS // 8, dtype=np.uint8)
    for row in parts_of.groupBy("segment").applyInArrow(merged, "segment long, bits binary").toLocalIterator():
        start = row["segment"] * CELLS // 8
        bits[start : start + CELLS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _proven(spark: SparkSession, bits: np.ndarray, pos: Column, p1: Column, p2: Column) -> Column:
    """Whether the sketch proves that the prefix is one conversation's alone; never so for the root."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def udf(pos: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.Series:
        counters = shared.value
        cells = _cells(p1.to_numpy(), p2.to_numpy(), 4 * len(counters))
        several = (counters[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
        return pd.Series((pos.to_numpy() > 0) & ~several.all(axis=0))

    return udf(pos, p1, p2)


def _digests(rows: DataFrame, salt: int) -> DataFrame:
    """``rows`` with the digest of the prefix that ends there (p1, p2) and of the one before it (q1, q2)."""
    root = F.col("pos") == 0
    hashed = [
        F.when(root, F.lit(0)).otherwise(F.xxhash64(F.lit(salt + k), "pos", "t1", "t2")).cast("long").alias(f"x{k}") for k in (1, 2)
    ]
    found = running(rows.select("*", *hashed), "conv_id", "pos", "len", {"p1": ("x1", "bit_xor"), "p2": ("x2", "bit_xor")})
    return found.select(
        *rows.columns, "p1", "p2", *[F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"q{k}") for k in (1, 2)]
    )


def _ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): the hash of the ids in ascending order, joined by commas.

    Neighbouring ids are joined first, 512 at most; a hash over a list cannot be split, so the parts of one node pass
    through one task in order, as a stream.
    """
    parts = ends.groupBy(*NODE, F.shiftright("conv_id", ENDS_BITS).alias("part")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch[c].to_pylist() for c in (*NODE, "ids")]):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], [*NODE, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], [*NODE, "ends_sha256"])

    ordered = parts.repartition(*NODE).sortWithinPartitions(*NODE, "part")
    return ordered.mapInArrow(hashed, "pos long, p1 long, p2 long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes over ``rows`` (conv_id, pos, len, t1, t2, words), which hold every place from 0 to ``len`` once."""
    spark = rows.sparkSession
    for salt in itertools.count(1, 2):
        prefixes = _digests(rows, salt)
        bits = sketch(prefixes.where("pos > 0"))
        flagged = prefixes.withColumn("alone", _proven(spark, bits, F.col("pos"), F.col("p1"), F.col("p2"))).withColumn(
            "above_alone", _proven(spark, bits, F.col("pos") - 1, F.col("q1"), F.col("q2"))
        )
        shared = checkpointed(flagged.where("NOT alone").drop("alone"))
        differ = [F.min(c) != F.max(c) for c in ("t1", "t2", "q1", "q2")]
        nodes = checkpointed(shared.groupBy(*NODE).agg(
            F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"),
            F.count_if(F.col("len") > F.col("pos")).alias("longer"), (differ[0] | differ[1] | differ[2] | differ[3]).alias("clash"),
        ))
        if nodes.where("clash").isEmpty():
            break
    members = checkpointed(with_each(shared.drop("t1", "t2"), nodes.drop("clash"), NODE, "n_convs"))
    own = F.col("conv_id") == F.col("owner")
    zero = F.lit(0).cast("long")
    held = members.select(
        "conv_id", "len", *NODE, F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(zero).alias("saved"),
        F.when(own & (F.col("longer") == 0), 1).otherwise(0).cast("long").alias("leaf"),
    )
    alone_ends = flagged.where("alone AND pos = len").select(
        "conv_id", "len", "pos", *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")], zero.alias("saved"), (zero + 1).alias("leaf")
    )
    from_end = running(
        held.unionByName(alone_ends).withColumn("from_end", F.col("len") - F.col("pos")), "conv_id", "from_end", "len",
        {"saved_tokens": ("saved", "sum"), "n_leaves": ("leaf", "sum")},
    )
    tops = flagged.where("alone AND NOT above_alone")
    below = members.where(own & (F.col("pos") > 0) & ~F.col("above_alone")).select("pos", "q1", "q2").unionByName(tops.select("pos", "q1", "q2"))
    sums = (
        from_end.where("p1 IS NOT NULL").select(*NODE, "saved_tokens", "n_leaves", zero.alias("n_children"))
        .unionByName(below.select(
            (F.col("pos") - 1).alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), zero.alias("saved_tokens"),
            zero.alias("n_leaves"), (zero + 1).alias("n_children"),
        ))
        .groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("saved_tokens", "n_leaves", "n_children")])
    )
    grouped = nodes.join(sums, NODE).join(_ends(shared.where("len = pos").select(*NODE, "conv_id")), NODE, "left")
    at_end = F.when(F.col("pos") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS))
    measures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    def single(part: DataFrame) -> DataFrame:
        """Nodes of one conversation, from its own rows."""
        return part.select(
            "conv_id", "pos", (zero + 1).alias("n_convs"), (F.col("pos") < F.col("len")).cast("long").alias("n_children"),
            (zero + 1).alias("n_leaves"), zero.alias("saved_tokens"), at_end.alias("ends_sha256"),
        )

    # The parent belongs to the same conversation, but for the first node that a conversation owns.
    first = members.where(~own).groupBy("conv_id").agg(
        F.max_by("owner", "pos").alias("parent"), (F.max("pos") + 1).alias("pos")
    )
    placed = grouped.select(
        F.col("owner").alias("conv_id"), "pos", *[F.coalesce(m, F.lit(NO_ENDS)).alias(m) if m == "ends_sha256" else m for m in measures]
    ).unionByName(single(tops)).join(first, ["conv_id", "pos"], "left")
    tails = single(flagged.where("alone AND above_alone")).withColumn("parent", F.lit(None).cast("long"))
    parent = F.when(F.col("pos") > 0, F.coalesce("parent", "conv_id"))
    return placed.unionByName(tails).select("conv_id", F.col("pos").alias("depth"), parent.alias("parent_conv_id"), *measures)


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all nodes of the conversations, rebuilt with shared heads."""
    return trie(with_heads(turn_rows(table(spark, sf_dir, "conversations"))))


# CRC32 of the ASCII characters of a string, bit by bit: -1 stands for a shift.
CRC32_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split({0}, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

SQL = f"""
WITH c AS (
  SELECT conv_id, turn, sha256(strlen(r) || ':' || r || t) AS sha, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
),
o AS (
  SELECT conv_id, sha, words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha, 1) < '8', sha) AS place FROM c
),
v AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32_SQL.format("CAST(conv_id AS VARCHAR)")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)
),
r AS (
  SELECT v.conv_id, 0 AS part, place, sha, words FROM v JOIN o ON o.conv_id = v.base WHERE place <= h
  UNION ALL SELECT v.conv_id, 1, place, sha, words FROM v JOIN o ON o.conv_id = v.conv_id WHERE place > h
),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS pos FROM r),
d AS (SELECT conv_id, pos, words, sha256(string_agg(sha, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM p),
m AS (
  SELECT *, max(pos) OVER (PARTITION BY conv_id) AS size, lag(node) OVER (PARTITION BY conv_id ORDER BY pos) AS parent
  FROM (SELECT * FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM v)
),
n AS (
  SELECT pos, node, min(parent) AS parent, min(conv_id) AS owner, count(*) AS n_convs, max(words) AS words,
    coalesce(string_agg(CASE WHEN pos = size THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
  FROM m GROUP BY pos, node
),
k AS (SELECT pos - 1 AS pos, parent AS node, count(*) AS n_children FROM n WHERE pos > 0 GROUP BY ALL),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (pos, node)),
s AS (
  SELECT m.pos, m.node, sum((u.n_convs - 1) * u.words) AS saved, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM u JOIN m ON m.conv_id = u.owner AND m.pos <= u.pos GROUP BY ALL
)
SELECT u.owner AS conv_id, u.pos AS depth, above.owner AS parent_conv_id, u.n_convs, u.n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN s ON s.pos = u.pos AND s.node = u.node LEFT JOIN n above ON above.pos = u.pos - 1 AND above.node = u.parent
"""
