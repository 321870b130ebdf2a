"""Quality rules as a ledger of failure bits, with versioned policies and ablations on the bits.

Every rule is evaluated once per text. The ledger keeps its measurements and one bit per failed rule; a policy
is a mask of the rules that reject. Changing a policy, comparing two of them or asking what a rule costs reads
the bits only, never the texts again.

Defined cases: a null text has no words (and so fails ``few_words``); an empty text likewise. Repeated rows and
rows without an id are rows like any other. An empty table gives an empty ledger. Extra columns are ignored.
Two 8-word windows count as equal if their 64-bit hashes are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import table, words_of, wrapped

WINDOW = 8

# Rule n owns bit n of the ledger. New rules go to the end: stored ledgers stay readable.
RULES = ["few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"]

# Thresholds of the rules beyond the base ones.
MAX_SYMBOLS_PER_100_WORDS = 40
MAX_REPEATED_LINES_PER_100 = 50
WORD_LENGTH = (2, 15)

# Versioned policies: the rules that reject. A published version is never edited.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"],
}


def mask_of(rules: list[str]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as struct ``row``, with the measurements of every text. One pass, no shuffle."""
    df = wrapped(docs, _text=text).withColumn("_text", F.coalesce(F.col("_text").cast("string"), F.lit("")))
    df = df.withColumn("_words", words_of(F.col("_text"))).withColumn(
        "_lines", F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # Hashes of 2, 4 and 8 words, each from two of the half length; the incomplete ones at the end are cut off.
    for size in (1, 2, 4):
        df = df.withColumn(
            "_hashes",
            F.when(
                F.size("_hashes") > size,
                F.zip_with(
                    F.slice("_hashes", F.lit(1), F.size("_hashes") - size),
                    F.slice("_hashes", F.lit(size + 1), F.size("_hashes") - size),
                    lambda a, b: F.xxhash64(a, b),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )
    df = df.withColumn("_repeats", F.size("_hashes") > F.size(F.array_distinct("_hashes")))
    df = df.withColumn(
        "_ordered",
        F.when(
            F.col("_repeats"),
            F.array_sort(F.transform("_hashes", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ),
    )
    df = df.withColumn(
        "_at",
        F.array_sort(
            F.array_compact(
                F.transform(
                    "_ordered",
                    lambda x, k: F.when(
                        (x["g"] == F.get("_ordered", k - 1)["g"]) | (x["g"] == F.get("_ordered", k + 1)["g"]), x["i"]
                    ),
                )
            )
        ),
    )
    covered = _sum_of(
        F.zip_with(
            "_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))),
            lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))).cast("long"),
        )
    )
    return df.select(
        "row",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _failures() -> dict[str, Column]:
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": words < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * words,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * words,
        "repeated_lines": 100 * F.col("n_dup_lines") > MAX_REPEATED_LINES_PER_100 * F.col("n_lines"),
        "word_length": (words > 0) & ((chars < WORD_LENGTH[0] * words) | (chars > WORD_LENGTH[1] * words)),
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, the measurements and ``fail_bits`` (long): bit n is set if rule n of ``RULES`` failed."""
    failed = _failures()
    bits = [F.when(failed[name], F.lit(1 << n)).otherwise(F.lit(0)) for n, name in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    # A row number in the expression keeps filters on the bits above it; pushed down, they would repeat all measuring.
    here = F.monotonically_increasing_id() >= 0
    return measured(docs, text).withColumn("fail_bits", F.when(here, total.cast("long")))


def passes(policy: str, bits: Column | None = None) -> Column:
    """Whether a policy keeps the row of a ledger."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablations(entries: DataFrame, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """What each rule costs under each policy, from the bits alone.

    One row per policy and rule: ``n_failed`` rows that fail the rule, ``n_only`` rows that nothing else of the
    policy rejects, ``n_kept`` rows the whole policy keeps, ``n_kept_without`` rows it keeps without the rule.
    The ledger is first counted by bit pattern (2^rules patterns at most), so nothing grows beyond that.
    """
    policies = POLICIES if policies is None else policies
    pairs = F.array(*[
        F.struct(
            F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask_of(rules)).alias("mask"),
            F.lit(mask_of([r])).alias("bit"),
        )
        for p, rules in sorted(policies.items()) for r in rules
    ])
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("fail_bits").bitwiseAND(F.col("e.mask"))
    n, zero = F.col("n"), F.lit(0)
    return (
        patterns.withColumn("e", F.explode(pairs)).groupBy("e.policy", "e.rule")
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("e.bit")) != 0, n).otherwise(zero)).alias("n_failed"),
            F.sum(F.when(hit == F.col("e.bit"), n).otherwise(zero)).alias("n_only"),
            F.sum(F.when(hit == 0, n).otherwise(zero)).alias("n_kept"),
            F.sum(
                F.when(hit.bitwiseAND(F.bitwise_not(F.col("e.bit").cast("long"))) == 0, n).otherwise(zero)
            ).alias("n_kept_without"),
        )
    )


def quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: one ledger entry per document, with the verdict of policy v1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = mask_of(POLICIES["base"])
    return ledger(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "fail_bits",
        (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        passes("v1").alias("kept"),
    )


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: the documents that policy v1 keeps, unchanged."""
    return ledger(docs).where(passes("v1")).select("row.*")


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS gram
      FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {WINDOW - 2})) AS i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
gaps AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM twice WHERE n > 1),
covered AS (SELECT r, sum(least({WINDOW}, coalesce(j - i, {WINDOW}))) AS n FROM gaps GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines
  FROM w LEFT JOIN covered USING (r)
),
b AS (
  SELECT *, CAST(
      CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > {MAX_SYMBOLS_PER_100_WORDS} * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > {MAX_REPEATED_LINES_PER_100} * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < {WORD_LENGTH[0]} * n_words OR word_chars > {WORD_LENGTH[1]} * n_words)
        THEN 16 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
