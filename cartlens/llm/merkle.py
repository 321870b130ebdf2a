"""A Merkle manifest of a dataset: a leaf per row, a subtree per group, one root, and a proof for every row.

Leaves of a group are hashed in runs of ``ARITY`` neighbours, level by level, until one node is left, the subroot; the
subroots are hashed likewise into the root. A level is a set of window expressions: a row carries a node if it is the
first leaf below it; lag and lead columns at the fixed offsets of the run's other slots give the siblings, masked by
slot and run length, and the first child hashes the parent. Up to ten levels form a tier: they share one window over
blocks of ``ARITY ** 10`` neighbouring leaves, so they take one shuffle, and no group has to fit in a task. What is left
are the leaves of the next tier; three tiers hold 2^30 rows. Siblings then travel down, one join per tier with at
most a block's rows per key.

Rows shuffle as digests and keys, never as texts. Places within a group come from a range shuffle (``order.numbered``).

Defined cases: null fields are hashed as "-"; a null group is a group of its own, the first one. Equal keys in a group
are ordered by leaf, null keys come first. Rows that repeat in every field are leaves of their own with proofs of their
own. A row without key is never tampered with. An empty table has no root and gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.common import table
from cartlens.llm.order import numbered, with_each
from cartlens.llm.trie import CRC32_SQL
from cartlens.session import checkpointed

ARITY = 2
# Levels of a tier; one block of a tier has ARITY to this power leaves.
TIER_LEVELS = 10
GROUP = ["_named", "_group"]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings, put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field in the form that leaves hash: its UTF-8 length, a colon, the value; "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tier(nodes: DataFrame, key: list[str], levels: int) -> DataFrame:
    """``nodes`` (key, at, n, digest; ``at`` from 0 of ``n`` in its key) with what ``levels`` levels above them hold.

    ``siblings`` are the digests of the siblings on the way up, level by level, left to right, in one string; ``top`` is
    the node above a block where the row is the first of its ``block``, else null.
    """
    block = Window.partitionBy(*key, "block").orderBy("at")
    latest = block.rowsBetween(Window.unboundedPreceding, 0)
    offsets = [k for k in range(1 - ARITY, ARITY) if k]
    df = nodes.withColumn("block", F.floor(F.col("at") / ARITY**levels)).withColumn("top", F.col("digest"))
    df = df.withColumn("siblings", F.lit(""))
    for level in range(levels):
        step = ARITY**level
        # The group ends where one node is left.
        grows = F.col("n") > step
        slot = F.floor(F.col("at") / step) % ARITY
        near = [(F.lag("top", -k * step) if k < 0 else F.lead("top", k * step)).over(block).alias(f"_near{k}") for k in offsets]
        df = df.select("*", *near)

        def run(which: list[int], slot: Column = slot) -> Column:
            """The nodes at these offsets, as far as the run reaches."""
            return F.concat(F.lit(""), *[
                F.when((slot + k >= 0) & (slot + k < ARITY), F.coalesce(f"_near{k}", F.lit(""))).otherwise("") for k in which
            ])

        # What stands at the first leaf of a node holds for all leaves below it.
        here = F.when(F.col("at") % step == 0, run(offsets))
        parent = F.when(grows, digest(F.col("top"), run([k for k in offsets if k > 0]))).otherwise(F.col("top"))
        df = df.select(
            *nodes.columns, "block", F.when(F.col("at") % (step * ARITY) == 0, parent).alias("top"),
            F.concat("siblings", F.when(grows, F.last(here, ignorenulls=True).over(latest)).otherwise("")).alias("siblings"),
        )
    return df


def hashed_up(nodes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``nodes`` with ``siblings`` up to the last node of their key, (key, root)); ``nodes`` as for ``tier``."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    tiers, current = [], nodes
    while True:
        levels = min(TIER_LEVELS, next(k for k in range(64) if ARITY**k >= largest))
        span = ARITY**levels
        tiers.append(checkpointed(tier(current, key, levels)))
        tops = tiers[-1].where("top IS NOT NULL")
        if largest <= span:
            break
        largest = -(-largest // span)
        current = tops.select(
            *key, F.col("block").alias("at"), F.ceil(F.col("n") / span).alias("n"), F.col("top").alias("digest")
        )
    proofs = tiers.pop().drop("top", "block")
    while tiers:
        above = proofs.select(*key, F.col("at").alias("block"), F.col("siblings").alias("_up"))
        proofs = tiers.pop().drop("top").join(above, [*key, "block"]).withColumn(
            "siblings", F.concat("siblings", "_up")
        ).drop("block", "_up")
    return proofs, tops.select(*key, F.col("top").alias("root"))


def climbed(start: Column, siblings: Column, at: Column, n: Column) -> Column:
    """``start`` hashed up with ``siblings`` from place ``at`` among ``n`` nodes, while several nodes remain."""
    state = F.struct(start.alias("d"), at.cast("long").alias("at"), n.cast("long").alias("n"), F.lit(1).alias("next"))

    def up(s: Column, _level: Column) -> Column:
        slot = s["at"] % ARITY
        others = F.least(F.lit(ARITY), s["n"] - s["at"] + slot) - 1
        taken = F.substring(siblings, s["next"], (64 * others).cast("int"))
        before = (64 * slot).cast("int")
        parent = digest(F.substring(taken, F.lit(1), before), s["d"], F.substring(taken, before + 1, F.length(taken)))
        return F.when(s["n"] > 1, F.struct(
            parent.alias("d"), F.floor(s["at"] / ARITY).alias("at"), F.ceil(s["n"] / ARITY).alias("n"),
            (s["next"] + 64 * others).cast("int").alias("next"),
        )).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(n.cast("double")) / F.log2(F.lit(ARITY)) + 1).cast("int")), state, up, lambda s: s["d"])


def manifest(rows: DataFrame, group: str, key: str, fields: list[Column], changed: list[Column], tampered: Column) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, folded_root, verified) of ``rows``.

    ``fields`` make a leaf. ``proof`` holds the siblings from the leaf to the root, as hex digests. Where ``tampered``
    holds, the fold begins with the leaf of the ``changed`` fields, which the proof must not verify.
    """
    leaves = rows.select(
        F.col(group).isNotNull().alias("_named"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_group"),
        F.col(key).alias("_key"), digest(*map(field, fields)).alias("digest"),
        F.when(tampered, digest(*map(field, changed))).alias("_changed"),
    )
    placed = checkpointed(numbered(leaves, GROUP, ["_key", "digest"]))
    proofs, subroots = hashed_up(placed, GROUP)
    # Every group once, with its number of rows.
    subroots = checkpointed(subroots.join(placed.where("at = 0").select(*GROUP, F.col("n").alias("_rows")), GROUP))
    of_root = numbered(subroots.select(F.lit(0).alias("_all"), *GROUP, F.col("root").alias("digest"), "_rows"), ["_all"], GROUP)
    above, roots = hashed_up(checkpointed(of_root), ["_all"])
    root = roots.first()
    above = above.select(
        *GROUP, "_rows", F.col("digest").alias("subroot"), F.col("siblings").alias("_above"), F.col("at").alias("_place"),
        F.col("n").alias("_groups"),
    )
    joined = with_each(proofs, above, GROUP, "_rows")
    root = F.lit(None if root is None else root["root"]).cast("string")
    subroot = climbed(F.coalesce("_changed", "digest"), F.col("siblings"), F.col("at"), F.col("n"))
    folded = climbed(subroot, F.col("_above"), F.col("_place"), F.col("_groups"))
    return joined.select(
        F.col("_key").alias(key), F.when(F.col("_named"), F.col("_group")).alias(group), F.col("digest").alias("leaf"), "subroot",
        root.alias("root"), F.concat("siblings", "_above").alias("proof"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the manifest of the documents by language, with one in seven tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, "lang", "doc_id", fields, changed, tampered).select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified"
    )


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEVELS = """
  SELECT {0} lane, 0 AS level, place, digest, n FROM {1}
  UNION ALL
  SELECT lane, level + 1, place // 2, sha256(digest || coalesce(next, '')), (n + 1) // 2
  FROM (SELECT *, lead(digest) OVER (PARTITION BY lane ORDER BY place) AS next FROM {2} WHERE n > 1) WHERE place % 2 = 0
"""
SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS digest,
    CASE WHEN {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN
      sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', '(n_chars + 1)', 'text'))}) END AS changed
  FROM documents
),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS lane, row_number() OVER () AS r,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM leaf
),
up AS ({_LEVELS.format('', 'placed', 'up')}),
sub AS (SELECT lane AS place, digest, count(*) OVER () AS n FROM up WHERE n = 1),
high AS ({_LEVELS.format('0 AS', 'sub', 'high')}),
walk AS (
  SELECT r, lane, 0 AS level, place, n, coalesce(changed, digest) AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT r, w.lane, w.level + 1, w.place // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.place % 2 = 1 THEN s.digest || folded ELSE folded || coalesce(s.digest, '') END),
    proof || coalesce(s.digest, '')
  FROM walk w LEFT JOIN up s ON s.lane = w.lane AND s.level = w.level AND s.place = xor(w.place, 1) WHERE w.n > 1
),
walk2 AS (
  SELECT r, 0 AS level, sub.place, sub.n, folded, proof FROM walk JOIN sub ON sub.place = walk.lane WHERE walk.n = 1
  UNION ALL
  SELECT r, w.level + 1, w.place // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.place % 2 = 1 THEN s.digest || folded ELSE folded || coalesce(s.digest, '') END),
    proof || coalesce(s.digest, '')
  FROM walk2 w LEFT JOIN high s ON s.level = w.level AND s.place = xor(w.place, 1) WHERE w.n > 1
)
SELECT doc_id, placed.digest AS leaf, sub.digest AS subroot, high.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = high.digest AS verified
FROM placed JOIN sub ON sub.place = placed.lane JOIN high ON high.n = 1 JOIN walk2 ON walk2.r = placed.r AND walk2.n = 1
"""
