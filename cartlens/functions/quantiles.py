"""Exact linear-interpolation quantiles that never gather a column in one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable sketch first brackets
each wanted rank, about ``8 / accuracy`` of the rows. While a bracket may hold more than ``BRACKET_ROWS`` values, a pass
over all columns and groups at once counts what lies below it, sketches what lies inside, and narrows it to a few
thousandths; so the passes follow the logarithm of the rows, and a bracket ends at the bound or at a single value. The
last pass keeps single values only inside the brackets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.session import checkpointed

ACCURACY = 10_000
# Rows of a bracket, up to which one window ranks its distinct values.
BRACKET_ROWS = 100_000
# Marks of the sketch inside a bracket, and how many of them are kept on either side of the wanted rank, besides those
# that the error of the sketch spans.
MARKS = 1000
AROUND = 3


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Long frame (*by*, ``feature``, ``prob``, ``value``, ``n``); NULLs are ignored.

    ``by`` columns must have few values (cluster labels, segments): their brackets are joined back.
    """
    by = list(by)
    slack = 4.0 / accuracy
    marks: list[float] = []
    for p in probs:
        marks += [max(p - slack, 0.0), min(p + slack, 1.0)]

    def sketch(name: str):
        col = F.col(name).cast("double")
        # A bracket must also cover the neighbouring rank; in a group this small it is not worth having.
        few = F.count(col) < F.lit(int(8 / slack))
        # Sums recomputed in another order differ in the last bits; the bracket must not be that tight.
        margin = F.lit(1e-9) * (F.max(F.abs(col)))
        approx = F.percentile_approx(col, F.array(*[F.lit(m) for m in marks]), F.lit(accuracy))
        brackets = [
            F.struct(
                F.lit(float(p)).alias("prob"),
                (F.when(few | F.lit(marks[2 * i] <= 0.0), F.min(col)).otherwise(approx[2 * i]) - margin).alias("lo"),
                (F.when(few | F.lit(marks[2 * i + 1] >= 1.0), F.max(col)).otherwise(approx[2 * i + 1]) + margin).alias("hi"),
                F.count(col).alias("n"),
            )
            for i, p in enumerate(probs)
        ]
        return F.struct(F.lit(name).alias("feature"), F.array(*brackets).alias("brackets"))

    sketches = df.groupBy(*by).agg(F.array(*[sketch(c) for c in columns]).alias("s"))
    brackets = (
        sketches.select(*by, F.explode("s").alias("s"))
        .select(*by, "s.feature", F.explode("s.brackets").alias("b"))
        .select(*by, "feature", "b.prob", "b.lo", "b.hi", "b.n")
    )

    values = df.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("x"),
    ).select(*by, "x.feature", "x.v").filter("v is not null")

    keys = [*by, "feature", "prob"]
    brackets, values = _narrowed(brackets, values, [*by, "feature"], slack, accuracy, bracket_rows)
    # Below the bracket only the count matters, so those rows share one NULL key.
    counts = (
        values.join(brackets, [*by, "feature"])
        .filter("v <= hi")
        .withColumn("v", F.when(F.col("v") >= F.col("lo"), F.col("v")))
        .groupBy(*keys, "v")
        .agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    )
    running = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rank = (F.col("n") - 1) * F.col("prob")
    at = lambda position: F.max(
        F.when((F.col("upto") - F.col("c") <= position) & (position < F.col("upto")), F.col("v"))
    )
    return (
        counts.withColumn("upto", F.sum("c").over(running))
        .groupBy(*keys)
        .agg(
            at(F.floor(rank)).alias("low"),
            at(F.ceil(rank)).alias("high"),
            F.max("n").alias("n"),
        )
        .withColumn("rank", (F.col("n") - 1) * F.col("prob"))
        .select(
            *keys,
            F.when(
                F.col("low").isNull() | F.col("high").isNull(),
                F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
            )
            .otherwise(F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank")))
            .alias("value"),
            "n",
        )
    )


def _narrowed(
    brackets: DataFrame, values: DataFrame, by: list[str], slack: float, accuracy: int, bracket_rows: int
) -> tuple[DataFrame, DataFrame]:
    """``brackets`` (by, prob, lo, hi, n), narrowed until none holds more than ``bracket_rows`` of the ``values`` (by, v) or
    only copies of one, and the values, written down if they are read several times."""
    brackets = checkpointed(brackets)
    # Groups too small for a bracket keep all their rows, at most 8 / slack.
    largest = brackets.agg(F.max("n")).first()[0] or 0
    if min(largest, max(3 * slack * largest, 8 / slack)) <= bracket_rows:
        return brackets, values
    # Written, sums have the same last bits in every pass, so marks need no margin.
    values = checkpointed(values)
    keys, around = [*by, "prob"], AROUND + -(-2 * MARKS // accuracy)
    wide = brackets
    while True:
        inside = F.col("v").between(F.col("lo"), F.col("hi"))
        counted = checkpointed(values.join(wide, by).where("v <= hi").groupBy(*keys).agg(
            F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(inside).alias("inside"),
            F.percentile_approx(F.when(inside, F.col("v")), F.array(*[F.lit(k / MARKS) for k in range(MARKS + 1)]), F.lit(accuracy)).alias("marks"),
        ))
        # Where the two ranks beside the quantile stand among the values inside, in marks.
        at = MARKS * (F.floor((F.col("n") - 1) * F.col("prob")) - F.col("below")) / F.col("inside")
        low, high = F.floor(at).cast("int") - around, F.ceil(at).cast("int") + around
        narrow = counted.where(F.col("inside") > bracket_rows).join(brackets, keys).select(
            *keys, F.when(low > 0, F.get("marks", low)).otherwise(F.col("lo")).alias("lo1"),
            F.when(high < MARKS, F.get("marks", high)).otherwise(F.col("hi")).alias("hi1"),
        )
        after = checkpointed(brackets.join(narrow, keys, "left").select(
            *keys, F.coalesce("lo1", "lo").alias("lo"), F.coalesce("hi1", "hi").alias("hi"), "n",
            ((F.col("lo1") > F.col("lo")) | (F.col("hi1") < F.col("hi"))).alias("moved"),
        ))
        brackets, wide = after.drop("moved"), after.where("moved AND hi > lo").drop("moved")
        if wide.isEmpty():
            return brackets, values


def quantile_name(column: str, prob: float) -> str:
    return f"{column}_q{round(prob * 100)}"


def quantile_table(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """The same quantiles, one row per group: columns ``<column>_q<percent>``."""
    long = exact_quantiles(df, columns, probs, by)
    return long.groupBy(*by).agg(
        *[
            F.max(F.when((F.col("feature") == c) & (F.col("prob") == float(p)), F.col("value"))).alias(
                quantile_name(c, p)
            )
            for c in columns
            for p in probs
        ]
    )
