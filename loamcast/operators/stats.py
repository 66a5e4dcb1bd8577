"""Column statistics that make predicate pushdown work: bounds, null counts, truncation, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_FLOATS = (T.FloatType, T.DoubleType)


def bounds(column: str, kind: T.DataType) -> dict[str, Column]:
    """Aggregates min, max and null_count of a column.

    NaN is left out of the bounds; a zero minimum is -0.0 and a zero maximum +0.0, so that either zero
    passes a test against them.
    """
    c = F.col(column)
    if isinstance(kind, _FLOATS):
        real = F.when(~F.isnan(c), c)
        low, high = F.min(real), F.max(real)
        low, high = F.when(low == 0, F.lit(-0.0)).otherwise(low), F.when(high == 0, F.lit(0.0)).otherwise(high)
    else:
        low, high = F.min(c), F.max(c)
    return {"min": low, "max": high, "null_count": F.count(F.lit(1)) - F.count(c)}


def column_stats(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row per group with <column>_min, <column>_max, <column>_nulls and n_rows."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        b = bounds(c, df.schema[c].dataType)
        aggs += [b["min"].alias(f"{c}_min"), b["max"].alias(f"{c}_max"), b["null_count"].alias(f"{c}_nulls")]
    return df.groupBy(*by).agg(*aggs)


def truncated_min(value: Column, size: int = 16) -> Column:
    """Lower bound of at most `size` bytes, and whether it is exact, as a struct (bound, exact)."""
    return F.struct(F.substring(value, 1, size).alias("bound"), (F.octet_length(value) <= size).alias("exact"))


def truncated_max(value: Column, size: int = 16) -> Column:
    """Upper bound of at most `size` bytes: cut, with its last byte below 0xFF raised; null if all are 0xFF."""
    head = F.substring(value, 1, size)
    digits = F.regexp_replace(F.hex(head), "(FF)+$", "")
    # The hex string has whole bytes, so trailing FF pairs go only at even places.
    digits = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("F"))).otherwise(digits)
    last = F.conv(F.right(digits, F.lit(2)), 16, 10).cast("int") + 1
    raised = F.unhex(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 2), F.lpad(F.hex(last), 2, "0")))
    exact = F.octet_length(value) <= size
    return F.struct(F.when(exact, value).when(F.length(digits) > 0, raised).alias("bound"), exact.alias("exact"))


def stats_prune(stats: DataFrame, column: str, low, high) -> DataFrame:
    """Groups that a test low <= column <= high can't rule out by their bounds."""
    return stats.where((F.col(f"{column}_min") <= F.lit(high)) & (F.col(f"{column}_max") >= F.lit(low)))
