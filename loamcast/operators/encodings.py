"""What the column encodings would see: deltas, shared prefixes, runs, byte planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamcast.operators.order import numbered

BLOCK, MINI = 128, 32
#: Rows that one task orders at a time; ranges meet by looking at the last row of the one before.
CHUNK = 1 << 16


def bit_width(x: Column) -> Column:
    """Bits that a non-negative long needs; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("int")


def zigzag(x: Column) -> Column:
    """Signed longs to unsigned ones with small magnitudes small."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def with_previous(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """df with pos and prev_<column>: the row before, found by chunk; each chunk also gets its forerunner."""
    at = numbered(df, order_by).withColumn("__chunk", F.floor(F.col("pos") / CHUNK))
    carried = at.where((F.col("pos") + 1) % CHUNK == 0).withColumns({"__chunk": F.col("__chunk") + 1, "__extra": F.lit(True)})
    both = at.withColumn("__extra", F.lit(False)).unionByName(carried)
    w = Window.partitionBy("__chunk").orderBy("pos")
    out = both.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
    return out.where(~F.col("__extra")).drop("__chunk", "__extra")


def delta_blocks(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """(block, miniblock, n_deltas, min_delta, bit_width): delta encoding of a non-null integer column.

    The first value is the header's, so deltas count from the second; min_delta is its block's.
    """
    d = with_previous(df.select(*dict.fromkeys([column, *order_by])), [column], order_by).where("pos > 0")
    d = d.select(F.floor((F.col("pos") - 1) / BLOCK).cast("long").alias("block"), F.floor((F.col("pos") - 1) % BLOCK / MINI).cast("long").alias("miniblock"), (F.col(column) - F.col(f"prev_{column}")).cast("long").alias("delta"))
    minis = d.groupBy("block", "miniblock").agg(F.count(F.lit(1)).alias("n_deltas"), F.min("delta").alias("lo"), F.max("delta").alias("hi"))
    least = F.min("lo").over(Window.partitionBy("block"))
    return minis.withColumn("min_delta", least).select("block", "miniblock", "n_deltas", "min_delta", bit_width(F.col("hi") - F.col("min_delta")).alias("bit_width"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Code points that two strings share from the start; 0 if either is null."""
    n = F.least(F.length(a), F.length(b))
    hits = F.filter(F.sequence(F.lit(1), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.size(hits)).cast("int")


def delta_prefixes(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """Columns of order_by with prefix_length and suffix_length against the value before."""
    d = with_previous(df.select(*dict.fromkeys([column, *order_by])), [column], order_by)
    p = shared_prefix(F.col(column), F.col(f"prev_{column}"))
    return d.select(*order_by, p.alias("prefix_length"), (F.length(column) - p).cast("int").alias("suffix_length"))


def runs(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """(run, value, n, first_pos): runs of equal values in order; nulls equal each other."""
    d = with_previous(df.select(*dict.fromkeys([column, *order_by])), [column], order_by)
    starts = d.where((F.col("pos") == 0) | ~F.col(column).eqNullSafe(F.col(f"prev_{column}")))
    s = numbered(starts.select(F.col("pos").alias("first_pos"), F.col(column).alias("value")), ["first_pos"], "run")
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    nxt = s.select((F.col("run") - 1).alias("run"), F.col("first_pos").alias("__next"))
    return s.join(nxt, "run", "left").crossJoin(F.broadcast(total)).select("run", "value", (F.coalesce("__next", "__total") - F.col("first_pos")).cast("long").alias("n"), "first_pos")


def byte_planes(df: DataFrame, column: str, planes: int = 8) -> DataFrame:
    """(plane, distinct_bytes, n): how varied each byte of a long column is; flat planes compress best."""
    x = F.col(column).cast("long")
    split = F.explode(F.array(*(F.struct(F.lit(k).alias("plane"), F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)).alias("b")) for k in range(planes))))
    return df.where(x.isNotNull()).select(split.alias("s")).groupBy("s.plane").agg(F.count_distinct("s.b").alias("distinct_bytes"), F.count(F.lit(1)).alias("n"))
