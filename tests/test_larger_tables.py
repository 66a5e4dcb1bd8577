from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import check
from pyspark.sql import functions as F

from loamcast import catalog
from loamcast.operators import bloom, dictionary
from loamcast.operators.order import numbered
from loamcast.sources import sink

ORDERS = "select i as o_orderkey, i % 977 as o_custkey, 'O' as o_orderstatus, i / 7.0 as o_totalprice, timestamp '1995-01-01' as o_orderdate, 'LOW' as o_orderpriority from range(101500) r(i)"


def _tables(tmp_path, **made):
    """A folder with the given tables, the others as in sf0.001."""
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        (tmp_path / p.name).symlink_to(p)
    for name, sql in made.items():
        (tmp_path / f"{name}.parquet").unlink()
        duckdb.sql(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
    return str(tmp_path)


def test_footer_groups_with_more_rows_than_a_default_group(spark, tmp_path):
    sf = _tables(tmp_path, orders=ORDERS)
    check(catalog.footer_groups(spark, sf), catalog.ORACLES["footer_groups"], sf)


def test_large_row_groups_pass_through_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "HELD", 1 << 12)
    table = pa.table({"a": range(10_000), "s": [None if i % 3 == 0 else f"v{i}" for i in range(10_000)]})
    with pq.ParquetWriter(tmp_path / "t.parquet", table.schema) as w:
        assert sink.write_groups(w, iter(table.to_batches(max_chunksize=700)), (1000, 8900), table.schema) == 10_000
    m = pq.read_metadata(tmp_path / "t.parquet")
    assert [m.row_group(k).num_rows for k in range(m.num_row_groups)] == [1000, 8900, 100]
    assert pq.read_table(tmp_path / "t.parquet").equals(table)


@pytest.mark.parametrize("kind", ["int", "double", "string", "timestamp", "decimal(9,2)", "binary"])
def test_numbers_over_many_ranges(spark, kind):
    n = 3000
    a = F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") * 7919 % 1009).cast("int"))
    a = a.cast("string").cast("binary") if kind == "binary" else a.cast(kind)
    a = F.when(F.col("id") % 77 == 1, float("nan")).otherwise(a) if kind == "double" else a
    df = spark.range(n).select(a.alias("a"), F.col("id").alias("b"))
    got = numbered(df, ["a", "b"], ranges=300)
    # Deals rows out by a few halvings, not by a test for each range.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") + plan.count("cast(") < 60
    want = [r.b for r in df.orderBy("a", "b").select("b").collect()]
    assert [(r.pos, r.b) for r in got.orderBy("pos").collect()] == list(enumerate(want))


def test_dictionary_orders_only_first_rows(spark, tmp_path):
    rows = [(None if i % 11 == 0 else f"v{i * 7 % 13}", None if i % 17 == 0 else i * 31 % 101, float("nan") if i % 19 == 0 else -i / 3) for i in range(400)]
    spark.createDataFrame(rows, "v string, a int, b double").write.parquet(str(tmp_path / "in"))
    got = dictionary.build_dictionary(spark.read.parquet(str(tmp_path / "in")), "v", ["a", "b"])
    assert not any("/in/" in f for f in got.inputFiles())  # the table isn't numbered
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] != r[2], 0.0 if r[2] != r[2] else r[2]))
    want = list(dict.fromkeys(r[0] for r in order))
    assert [(r["value"], r["index"], r["n"]) for r in got.orderBy("index").collect()] == [(v, k, sum(r[0] == v for r in rows)) for k, v in enumerate(want)]


def test_filters_compute_their_rows_once(spark, tmp_path):
    spark.range(5000).selectExpr("id % 700 as x", "id div 1000 as row_group").write.parquet(str(tmp_path / "in"))
    got = bloom.build_filters(spark.read.parquet(str(tmp_path / "in")), "x")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert got.columns == ["row_group", "ndv", "filter"] and {r.ndv for r in got.collect()} == {700}


def test_row_group_stats_plan_is_small_at_many_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        plan = catalog.row_group_stats(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plan.count("CASE WHEN") + plan.count("cast(") < 100
