"""Dictionary encoding: whether to use one, its entries, and the encoded values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamcast.operators.order import numbered
from loamcast.storage import shared_path

SAMPLE, MOST = 1000, 0.5


def dictionary_choice(df: DataFrame, order_by: list[str], columns: list[str] | None = None, sample: int = SAMPLE, most: float = MOST) -> DataFrame:
    """Per column: sampled, distinct_values, use_dictionary, from the first `sample` rows in order.

    A dictionary pays unless more than `most` of the sample differ; null counts as a value. Booleans
    never take one.
    """
    columns = columns or df.columns
    head = df.orderBy(*order_by).limit(sample)
    kinds = dict(df.dtypes)
    distinct = [(F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]
    wide = head.agg(F.count(F.lit(1)).alias("__n"), *distinct)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("distinct_values"), F.lit(kinds[c] != "boolean").alias("ok")) for c in columns)))
    long = wide.select(F.col("__n").alias("sampled"), pairs.alias("p"))
    use = (F.col("p.distinct_values") <= F.col("sampled") * most) & F.col("p.ok")
    return long.select("p.column", "sampled", "p.distinct_values", use.alias("use_dictionary"))


def build_dictionary(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """(value, index, n): distinct non-null values in order of first appearance.

    Only each value's first row is put in order, by its order_by; the dictionary is written once, as numbering reads it again.
    """
    keys = [f"__k{k}" for k in range(len(order_by))]
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.struct(*(F.col(c).alias(k) for c, k in zip(order_by, keys, strict=True))).alias("first"))
    firsts = rows.groupBy("value").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    path = shared_path(df.sparkSession, "dictionary")
    firsts.select("value", "n", "first.*").write.parquet(path)
    return numbered(df.sparkSession.read.parquet(path), keys, "index").select("value", "index", "n")


def dictionary_encode(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """df with <column>_index; null stays null. Spark broadcasts the dictionary only where it is small."""
    entries = build_dictionary(df, column, order_by).select(F.col("value").alias(column), F.col("index").alias(f"{column}_index"))
    return df.join(entries, column, "left").select(*df.columns, f"{column}_index")
