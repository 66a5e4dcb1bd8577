"""Row groups and pages: which row goes where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamcast.operators.order import numbered

#: A small first group for previews, then large ones.
ROW_GROUPS, PAGE_BYTES = (1000, 100_000), 1 << 20
#: Pages that one task puts in order at a time.
CHUNK = 1 << 14


def row_group_of(pos: Column, sizes: tuple[int, ...] = ROW_GROUPS) -> tuple[Column, Column]:
    """(row group, place in it) of a row number; the last size repeats."""
    if not sizes or min(sizes) <= 0:
        raise ValueError("row group sizes must be positive")
    *heads, last = sizes
    start, group, within = 0, None, None
    for k, n in enumerate(heads):
        here = pos < start + n
        g, w = F.lit(k).cast("long"), pos - start
        group, within = (F.when(here, g), F.when(here, w)) if group is None else (group.when(here, g), within.when(here, w))
        start += n
    rest, rest_in = F.floor((pos - start) / last) + len(heads), (pos - start) % last
    return (rest, rest_in) if group is None else (group.otherwise(rest), within.otherwise(rest_in))


def assign_row_groups(df: DataFrame, order_by: list[str], sizes: tuple[int, ...] = ROW_GROUPS) -> DataFrame:
    """df with pos, row_group and row_in_group (long)."""
    out = numbered(df, order_by)
    group, within = row_group_of(F.col("pos"), sizes)
    return out.withColumns({"row_group": group.cast("long"), "row_in_group": within.cast("long")})


def values_per_page(width: float, page_bytes: int = PAGE_BYTES) -> int:
    """Fixed-width values of a page: it closes before the value that would reach the size."""
    return max(1, -(-page_bytes // width) - 1) if width == int(width) else max(1, int(-(-page_bytes // width)) - 1)


def fixed_pages(df: DataFrame, column: str, width: float, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """df (with row_group, row_in_group) with `page`; nulls take no room and go with the value before."""
    n = values_per_page(width, page_bytes)
    upto = Window.partitionBy("row_group").orderBy("row_in_group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.greatest(F.count(column).over(upto) - 1, F.lit(0))
    return df.withColumn("page", F.floor(rank / n).cast("long"))


def variable_pages(df: DataFrame, size: Column, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row per page of every row group: row_group, page, first_row, n_rows, n_bytes.

    The split is a fold that starts over at each page, so it runs once per row group over its sizes
    alone; a row group has a bounded number of rows.
    """
    sizes = df.groupBy("row_group").agg(F.array_sort(F.collect_list(F.struct("row_in_group", F.coalesce(size, F.lit(0)).cast("long").alias("n")))).alias("v"))
    # Accumulator: the pages that are closed, and the open one.
    page = "struct<first_row:bigint,n_rows:bigint,n_bytes:bigint>"
    empty = F.expr(f"named_struct('done', cast(array() as array<{page}>), 'f', 0L, 'r', 0L, 'b', 0L)")
    step = lambda a, x: F.when(
        (a["r"] > 0) & (a["b"] + x["n"] >= page_bytes),
        F.struct(F.concat(a["done"], F.array(F.struct(a["f"].alias("first_row"), a["r"].alias("n_rows"), a["b"].alias("n_bytes")))).alias("done"), x["row_in_group"].alias("f"), F.lit(1).cast("long").alias("r"), x["n"].alias("b")),
    ).otherwise(F.struct(a["done"].alias("done"), a["f"].alias("f"), (a["r"] + 1).alias("r"), (a["b"] + x["n"]).alias("b")))
    close = lambda a: F.concat(a["done"], F.array(F.struct(a["f"].alias("first_row"), a["r"].alias("n_rows"), a["b"].alias("n_bytes"))))
    pages = sizes.select("row_group", F.posexplode(F.aggregate("v", empty, step, close)).alias("page", "p"))
    return pages.select("row_group", F.col("page").cast("long").alias("page"), "p.first_row", "p.n_rows", "p.n_bytes")


def boundary_order(pages: DataFrame, low: str, high: str, by: str = "page", within: list[str] | None = None) -> DataFrame:
    """ASCENDING, DESCENDING or UNORDERED for each group of pages by their bounds.

    Pages without values (null bounds) are passed over; one that fits both orders is ASCENDING. Pages are
    compared in stretches of CHUNK, and then the ends of one stretch with the next, so no task orders all.
    """
    within = within or []
    real = pages.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("__c", F.floor(F.col(by) / CHUNK))
    in_order = lambda a, b: F.bool_and(F.coalesce(a, F.lit(True)) & F.coalesce(b, F.lit(True)))
    w = Window.partitionBy(*within, "__c").orderBy(by)
    near = real.withColumns({"__l": F.lag(low).over(w), "__h": F.lag(high).over(w)})
    up = in_order(F.col("__l") <= F.col(low), F.col("__h") <= F.col(high)).alias("up")
    down = in_order(F.col("__l") >= F.col(low), F.col("__h") >= F.col(high)).alias("down")
    ends = F.struct(F.col(low).alias("l"), F.col(high).alias("h"))
    parts = near.groupBy(*within, "__c").agg(up, down, F.min_by(ends, by).alias("a"), F.max_by(ends, by).alias("z"))
    before = F.lag("z").over((Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("__c"))
    parts = parts.withColumn("p", before)  # a row per stretch
    up = F.bool_and("up") & in_order(F.col("p.l") <= F.col("a.l"), F.col("p.h") <= F.col("a.h"))
    down = F.bool_and("down") & in_order(F.col("p.l") >= F.col("a.l"), F.col("p.h") >= F.col("a.h"))
    return parts.groupBy(*within).agg(F.when(up, "ASCENDING").when(down, "DESCENDING").otherwise("UNORDERED").alias("boundary_order"))


def first_rows(slots: DataFrame, per_page: int, order_by: list[str]) -> DataFrame:
    """Page of each slot of a nested column, and the rows that begin before it.

    slots: one row per value slot, with rep (0 where a row begins); the order tells all slots apart.
    Returns page, first_row_index, n_values.
    """
    at = numbered(slots, order_by, "slot").withColumn("page", F.floor(F.col("slot") / per_page).cast("long"))
    pages = at.groupBy("page").agg(F.sum((F.col("rep") == 0).cast("long")).alias("begins"), F.count(F.lit(1)).alias("n_values"))
    return running_total(pages, "begins", "page", "first_row_index").select("page", "first_row_index", "n_values")


def running_total(df: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """df with `name` (long): the sum of value over rows of smaller `by`, which numbers the rows.

    Sums run inside stretches of CHUNK and are shifted by the totals of the stretches before.
    """
    dealt = df.withColumn("__c", F.floor(F.col(by) / CHUNK))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(upto(Window.partitionBy("__c").orderBy(by))), F.lit(0))
    totals = dealt.groupBy("__c").agg(F.sum(value).alias("__n"))  # a row per stretch
    shifts = totals.select("__c", F.coalesce(F.sum("__n").over(upto(Window.orderBy("__c"))), F.lit(0)).alias("__shift"))
    out = dealt.withColumn("__k", inside).join(shifts, "__c")
    return out.withColumn(name, (F.col("__k") + F.col("__shift")).cast("long")).drop("__c", "__k", "__shift")
