"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, or 0 where the denominator is not positive."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator)).otherwise(F.lit(0.0))


def percent_of(part: Column, total: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), total)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


# Cut-offs and names of the three lift scales.
def lift_band(lift: Column) -> Column:
    """Right-closed bands (0, 1.5], (1.5, 2.5], (2.5, inf); NULL outside."""
    return (
        F.when((lift > 0) & (lift <= 1.5), "Weak")
        .when((lift > 1.5) & (lift <= 2.5), "Moderate")
        .when(lift > 2.5, "Strong")
    )


def lift_label4(lift: Column) -> Column:
    return (
        F.when(lift > 3, "Very Strong").when(lift > 2, "Strong").when(lift > 1.5, "Moderate").otherwise("Weak")
    )


def lift_label3(lift: Column) -> Column:
    return F.when(lift > 2, "Strong").when(lift > 1.5, "Moderate").otherwise("Weak")


def item_text(items: Column) -> Column:
    """A set of items as one sorted, comma-separated string."""
    return F.concat_ws(", ", F.array_sort(items))


def shorten(text: Column, width: int = 40) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def percent_text(fraction: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", fraction * 100)


def number_text(value: Column, decimals: int = 0) -> Column:
    return F.format_string(f"%,.{decimals}f", value)


def money_text(value: Column, decimals: int = 0) -> Column:
    return F.format_string(f"$%,.{decimals}f", value)


def parse_percent(text: Column) -> Column:
    return F.rtrim(text, F.lit("%")).cast("double") / 100


def title_text(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def cluster_text(cluster: Column, name: Column) -> Column:
    return F.format_string("Cluster %d: %s", cluster, name)
