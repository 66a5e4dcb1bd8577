"""Row numbers over a whole table without a single-partition window.

A bounded sample of order keys gives range bounds; rows are numbered inside their range and shifted by
the counts of the ranges before. Bounds are values, so every evaluation deals rows out alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Keys that are sampled for the bounds, and ranges for each shuffle partition, which evens these out.
SAMPLE, SPREAD = 1 << 13, 4


def range_bounds(df: DataFrame, column: str, ranges: int) -> tuple[str, int]:
    """Ascending bounds that cut the column's values into ranges: as JSON, and how many.

    Of the values, those with the least hashes are taken; a second pass through JSON shows what it keeps of them.
    """
    kind = f"array<{df.schema[column].dataType.simpleString()}>"
    sample = df.select(F.col(column).alias("k")).where("k is not null").orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    keys = sample.agg(F.array_sort(F.collect_set("k")).alias("k"))
    cuts = keys.select(F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), lambda i: F.get("k", F.floor(F.size("k") * i / ranges).cast("int"))).alias("k"))
    again = F.array_sort(F.array_distinct(F.array_compact(F.from_json(F.to_json(F.slice("k", 2, ranges)), kind))))
    text, n = cuts.select(again.alias("k")).select(F.to_json("k"), F.size("k")).first()
    return text, n


def with_range(df: DataFrame, column: str, bounds: tuple[str, int], name: str) -> DataFrame:
    """df with `name` (int): how many of the bounds a row's value reaches; 0 for null.

    A binary search, one projection for each halving: code grows with the logarithm of the bounds, so that it is
    compiled, and each row takes as many steps. A sum of one test per bound is too large to be compiled.
    """
    text, n = bounds
    out = df.withColumn(name, F.lit(0))
    if not n:
        return out
    all_ = F.from_json(F.lit(text), f"array<{df.schema[column].dataType.simpleString()}>")  # folded into a literal
    step = 1 << (n.bit_length() - 1)
    while step:
        reached = F.get(all_, F.col(name) + F.lit(step - 1)) <= F.col(column)
        out = out.withColumn(name, F.col(name) + F.when(reached, step).otherwise(0))
        step //= 2
    return out


def numbered(df: DataFrame, order_by: list[str], name: str = "pos", ranges: int | None = None) -> DataFrame:
    """df with `name` (long, from 0): each row's place in ascending order, nulls first.

    order_by must tell all rows apart if the result is to be unique; the first column also deals rows
    into ranges, so it should have many values.
    """
    spark, first = df.sparkSession, order_by[0]
    ranges = ranges or min(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), SAMPLE // 4)
    dealt = with_range(df, first, range_bounds(df, first, ranges), "__range")
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__range", before.alias("__shift"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order_by))
    out = dealt.withColumn("__k", inside).join(F.broadcast(shifts), "__range")
    return out.withColumn(name, F.col("__shift") + F.col("__k") - 1).drop("__range", "__k", "__shift")
