import datetime as dt
import io
import json
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from loamcast.functions import convert, geo, variant
from loamcast.infer import infer_column, infer_schema
from loamcast.operators import bloom, encodings, layout, nested, stats
from loamcast.operators.order import numbered
from loamcast.plans.write_plan import plan_write
from loamcast.sources import frames, sink
from loamcast.types import ColumnSpec, schema_of


def test_inference():
    kind = lambda v: (infer_column("x", v).type, infer_column("x", v).nullable)
    assert kind([1, 2]) == ("INT32", False)
    assert kind([1, 2.5, None]) == ("DOUBLE", True)
    assert kind([1, 1 << 40]) == ("INT64", False)
    assert kind([True]) == ("BOOLEAN", False)
    assert kind([b"a"]) == ("BYTE_ARRAY", False)
    assert kind(["a"]) == ("STRING", False)
    assert kind([{"a": 1}]) == ("JSON", False)
    assert kind([dt.datetime(2024, 1, 1)]) == ("TIMESTAMP", False)
    assert kind([float("nan"), float("inf")]) == ("DOUBLE", False)
    assert kind([1e100]) == ("DOUBLE", False)
    assert kind([]) == kind([None]) == ("BYTE_ARRAY", True)
    assert kind(np.arange(3, dtype=np.int16)) == ("INT32", False)
    for bad in ([1, "a"], ["a", b"a"], [True, 1]):
        with pytest.raises(TypeError, match="mixes"):
            infer_column("x", bad)


def test_schema_guards():
    with pytest.raises(ValueError, match="length"):
        infer_schema({"a": [1], "b": [1, 2]})
    with pytest.raises(ValueError, match="unknown"):
        schema_of([ColumnSpec("a", "INT32")], {"b": T.StructField("b", T.LongType())})
    with pytest.raises(ValueError, match="named"):
        schema_of([ColumnSpec("a", "INT32")], {"a": T.StructField("b", T.LongType())})
    with pytest.raises(ValueError, match="flat"):
        schema_of([ColumnSpec("a", "INT32")], {"a": T.StructField("a", T.ArrayType(T.LongType()))})
    with pytest.raises(ValueError, match="fit"):
        ColumnSpec("a", "STRING", encoding="DELTA_BINARY_PACKED").check()
    with pytest.raises(ValueError, match="compressor"):
        ColumnSpec("a", "STRING", codec="brotli").check()
    with pytest.raises(ValueError, match="variants"):
        ColumnSpec("a", "STRING", shredding={"x": "INT32"}).check()


@given(st.lists(st.integers(1, 50), min_size=1, max_size=4), st.integers(0, 400))
@settings(max_examples=50, deadline=None)
def test_row_group_sizes(sizes, n):
    plan, got = sink.group_sizes(sizes), []
    while sum(got) < n:
        got.append(min(next(plan), n - sum(got)))
    assert sum(got) == n
    assert all(g == s for g, s in zip(got[:-1], sizes + [sizes[-1]] * len(got), strict=False))


def test_row_groups_match_defaults(spark):
    pos = spark.range(250_000).select(F.col("id").alias("pos"))
    group, _ = layout.row_group_of(F.col("pos"))
    assert [r[1] for r in pos.groupBy(group.alias("g")).count().orderBy("g").collect()] == [1000, 100_000, 100_000, 49_000]
    with pytest.raises(ValueError, match="positive"):
        layout.row_group_of(F.col("pos"), (0,))


def test_page_goldens(spark):
    rows = spark.range(100).select(F.col("id").alias("row_in_group"), F.lit(0).alias("row_group"), ((F.col("id") - 50) * (F.col("id") - 50)).cast("int").alias("v"))
    pages = layout.fixed_pages(rows, "v", 4, 100).groupBy("page").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("row_in_group").alias("first")).orderBy("page").collect()
    assert [r.lo for r in pages] == [729, 9, 0, 484, 2116]
    assert [r.hi for r in pages] == [2500, 676, 441, 2025, 2401]
    assert [r.first for r in pages] == [0, 24, 48, 72, 96]
    order = layout.boundary_order(spark.createDataFrame([(0, 1, 10), (1, 2, 11), (2, None, None), (3, 3, 12)], "page int, lo int, hi int"), "lo", "hi")
    assert order.first()[0] == "ASCENDING"


def test_numbering_with_ties_and_nulls(spark):
    rows = [(None, k) for k in range(5)] + [(7, k) for k in range(50)] + [(k, 0) for k in range(30)]
    got = [(r.a, r.b) for r in numbered(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], ranges=6).orderBy("pos").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_float_bounds(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (-0.0,), (None,)], "x double")
    r = stats.column_stats(df, ["x"], []).first()
    assert struct.pack("d", r.x_min) == struct.pack("d", -0.0) and struct.pack("d", r.x_max) == struct.pack("d", 0.0) and r.x_nulls == 1


def test_truncated_bounds(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 15 + b"bc"),), (bytearray(b"x" + b"\xff" * 20),), (bytearray(b"\xff" * 20),), (bytearray(b"\x0f\xff" * 10),), (bytearray(b"ab"),)], "v binary")
    got = [(bytes(r.m.bound) if r.m.bound is not None else None, r.m.exact) for r in df.select(stats.truncated_max(F.col("v")).alias("m")).collect()]
    assert got == [(b"a" * 15 + b"c", False), (b"y", False), (None, False), (b"\x0f\xff" * 7 + b"\x10", False), (b"ab", True)]
    assert bytes(df.select(stats.truncated_min(F.col("v")).alias("m")).first().m.bound) == b"a" * 15 + b"b"


def test_conversion(spark):
    one = lambda c, v, t: spark.createDataFrame([(v,)], f"x {t}").select(c(F.col("x"))).first()[0]
    assert one(lambda x: convert.scaled_decimal(x, 0), -2.5, "double") == -2
    assert one(convert.epoch_days, dt.datetime(1969, 12, 31, 23), "timestamp_ntz") == -1
    assert one(convert.uint32_bits, 4294967295, "long") == -1
    assert bytes(one(convert.uuid_bytes, "00112233-4455-6677-8899-AABBCCDDEEFF", "string")).hex() == "00112233445566778899aabbccddeeff"
    for c, v, t in ((convert.uint32_bits, 1 << 32, "long"), (convert.uuid_bytes, "zz", "string")):
        with pytest.raises(Exception, match="not a"):
            one(c, v, t)
    halves = spark.createDataFrame([(1.0,), (65504.0,), (float("inf"),), (2.0**-24,)], "x double").select(convert.half_bytes("x"))
    assert [bytes(r[0]) for r in halves.collect()] == [b"\x00\x3c", b"\xff\x7b", b"\x00\x7c", b"\x01\x00"]
    numbers = spark.createDataFrame([("0",), ("-1",), ("128",), ("-1234567890123456789",)], "x string").select(convert.twos_complement("x"))
    assert [int.from_bytes(bytes(r[0]), "big", signed=True) for r in numbers.collect()] == [0, -1, 128, -1234567890123456789]


def test_zigzag_and_widths(spark):
    df = spark.createDataFrame([(0,), (-1,), (1,), (-(1 << 40),)], "x long").select(encodings.zigzag(F.col("x")).alias("z"))
    assert [r[0] for r in df.collect()] == [0, 1, 2, (1 << 41) - 1]
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (255,), (1 << 50,)], "x long").select(encodings.bit_width(F.col("x"))).collect()] == [0, 1, 8, 51]


def test_levels_and_leaves():
    schema = T.StructType().add("a", T.ArrayType(T.StructType().add("x", T.IntegerType(), False))).add("m", T.MapType(T.StringType(), T.LongType()))
    assert nested.leaf_paths(schema) == ["a.element.x", "m.key", "m.value"]
    assert nested.max_levels(schema, "a.element.x") == (1, 3) and nested.max_levels(schema, "m.value") == (1, 3)


def test_bloom_sizes(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (1,), (20,), (1000,), (10**12,)], "n long").select(bloom.filter_bytes(F.col("n"))).collect()]
    assert got[:3] == [32, 32, 32] and got[3] % 32 == 0 and 1200 <= got[3] <= 1300 and got[4] == 128 << 20


def test_variants(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":"x"},"value":1}',), ('{"a":2,"d":[1,2]}',), (None,), ("null",)], "j string").withColumn("v", variant.encode(F.col("j")))
    assert variant.detect_shape(df.where("j like '{%'"), "v") == "struct<a:bigint,b:struct<c:string>,d:array<bigint>>"
    assert df.select(F.is_variant_null("v")).where("is_variant_null(v)").count() == 1
    deep = T.StructType().add("a", T.StructType().add("b", T.StructType().add("c", T.StructType().add("d", T.LongType()))))
    assert variant.prune(deep, 3) is None


def test_geometries():
    g = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2, 3, 4]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}]}
    w = geo.wkb(g)
    assert struct.unpack_from("<BII", w) == (1, 3007, 2)
    assert struct.unpack_from("<BI4d", w, 9) == (1, 3001, 1.0, 2.0, 3.0, 4.0)
    assert geo.type_code({"type": "LineString", "coordinates": [[0, 0, 1]]}) == 1002
    with pytest.raises(ValueError, match="unknown"):
        geo.wkb({"type": "Circle", "coordinates": []})


def test_extents(spark):
    rows = [(json.dumps({"type": "Point", "coordinates": [1, 2]}),), ('{"type":"Point","coordinates":[NaN,5,7]}',), (None,)]
    r = geo.geometry_stats(spark.createDataFrame(rows, "g string"), F.col("g"), []).first()
    assert (r.xmin, r.xmax, r.ymin, r.ymax, r.zmin) == (1, 1, 2, 5, 7) and r.codes == [1, 1001]
    lone = geo.geometry_stats(spark.createDataFrame([('{"type":"Point","coordinates":[1,NaN,3]}',)], "g string"), F.col("g"), []).first()
    assert lone[:8] == (None,) * 8 and lone.codes == [1001]  # no box without x and y


def test_bloom_filters_go_by_logical_types():
    schema = T.StructType().add("a", "string").add("b", "date").add("c", "string", True, {"logical": "JSON"})
    asked = lambda *specs: {k for k in plan_write(specs, schema=schema).options if "bloom" in k and "enabled" in k}
    assert asked(*(ColumnSpec(n, t, bloom=True) for n, t in (("u", "UUID"), ("j", "JSON"), ("h", "FLOAT16"), ("d", "DATE"), ("b", None), ("c", None), ("gone", None)))) == set()
    assert len(asked(ColumnSpec("a", None, bloom=True), ColumnSpec("x", "STRING", bloom=True), ColumnSpec("n", "INT64", bloom=True))) == 3


def test_rows_and_columns(spark):
    rows = ({"a": k, "b": f"x{k}"} if k != 1 else {"a": 3} for k in range(5))
    df = frames.from_rows(spark, rows, ["b", "a"], batch=2)
    assert df.columns == ["b", "a"] and sorted(map(tuple, df.collect()), key=repr) == sorted([("x0", 0), (None, 3), ("x2", 2), ("x3", 3), ("x4", 4)], key=repr)
    assert frames.from_rows(spark, [], [ColumnSpec("a", "INT32")]).schema == T.StructType().add("a", T.IntegerType())
    with pytest.raises(ValueError, match="not both"):
        frames.from_rows(spark, [], [ColumnSpec("a", "INT32")], T.StructType().add("a", T.LongType()))
    with pytest.raises(ValueError, match="null"):
        frames.from_columns(spark, {"a": [1, None]}, [ColumnSpec("a", "INT32", nullable=False)])


def test_native_sink(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5000).select("id", (F.col("id") % 10).cast("string").alias("s"))
    sink.write_native(df.coalesce(1), path, [ColumnSpec("id", "INT64", bloom=True, bloom_ndv=5000, encoding="DELTA_BINARY_PACKED")], codec="zstd", row_groups=(2000,))
    meta = duckdb.sql(f"select * from parquet_metadata('{path}/*.parquet')").df()
    assert sorted(set(meta.row_group_num_rows)) == [1000, 2000] and set(meta.compression) == {"ZSTD"}
    ids = meta[meta.path_in_schema == "id"]
    assert ids.encodings.str.contains("DELTA_BINARY_PACKED").all() and ids.bloom_filter_offset.notna().all()
    with pytest.raises(ValueError, match="write_arrow"):
        sink.write_native(df, path, row_groups=(10, 20))


def test_arrow_sink(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3000).select("id", (F.col("id") / 7).alias("x"), F.col("id").cast("string").alias("s"))
    specs = [ColumnSpec("x", "DOUBLE", encoding="BYTE_STREAM_SPLIT", codec="gzip"), ColumnSpec("s", "STRING", encoding="DELTA_LENGTH_BYTE_ARRAY")]
    for _ in range(2):  # overwriting leaves one file
        sink.write_arrow(df.coalesce(1), path, specs, row_groups=(100, 1000), metadata={"k": "v"})
    files = [p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet"]
    m = pq.read_metadata(files[0])
    assert len(files) == 1 and [m.row_group(g).num_rows for g in range(m.num_row_groups)] == [100, 1000, 1000, 900]
    assert m.row_group(0).column(1).compression == "GZIP" and "BYTE_STREAM_SPLIT" in m.row_group(0).column(1).encodings
    assert m.metadata[b"k"] == b"v" and pq.read_table(files[0]).num_rows == 3000
    foot = sink.footers(spark, path).where("row_group = 0").collect()
    assert {r.column: r.n_rows for r in foot} == {"id": 100, "x": 100, "s": 100}


def test_buffer_and_increments(spark, tmp_path):
    df = spark.range(250).toDF("id")
    m = pq.read_metadata(io.BytesIO(sink.to_buffer(df, (20, 50))))
    assert [m.row_group(g).num_rows for g in range(m.num_row_groups)] == [20, 50, 50, 50, 50, 30]
    w = sink.IncrementalWriter(str(tmp_path / "inc"))
    w.write(df)
    w.write(df)
    assert w.finish(spark).count() == 500
    with pytest.raises(ValueError, match="finished"):
        w.write(df)


def test_plan_lists_what_spark_cannot_write():
    plan = plan_write([ColumnSpec("a", "DOUBLE", encoding="BYTE_STREAM_SPLIT", codec="gzip")], row_groups=(1, 2), metadata={"k": "v"})
    assert len(plan.custom) == 4


def test_filters_forget_nothing():
    rng = np.random.default_rng(3)
    for x in (rng.integers(-(2**60), 2**60, 5000), rng.integers(-(2**30), 2**30, 5000).astype(np.int32), rng.normal(size=5000), rng.normal(size=5000).astype(np.float32)):
        want = [xxhash.xxh64_intdigest(v.tobytes()) for v in x]
        assert bloom.xxh64(pa.array(x)).tolist() == want
    assert bloom.xxh64(pa.array(["", "a", "é" * 40])).tolist() == [xxhash.xxh64_intdigest(v.encode()) for v in ("", "a", "é" * 40)]
    keys = bloom.xxh64(pa.array(np.arange(10_000)))
    made = bloom.create_filter(keys[:5000], 8192)
    assert bloom.may_contain(made, keys[:5000]).all() and bloom.may_contain(made, keys[5000:]).mean() < 0.03
    assert not bloom.may_contain(bloom.create_filter(keys[:0], 32), keys).any()


def test_filters_prune_groups(spark):
    df = spark.createDataFrame([(g, v) for g, vs in ((0, (10, 90)), (1, (30, 70))) for v in vs for _ in range(100)] + [(2, None)], "row_group long, code int")
    filters = bloom.build_filters(df, "code")
    assert sorted((r.row_group, r.ndv, len(r.filter)) for r in filters.collect()) == [(0, 2, 32), (1, 2, 32)]
    probes = spark.createDataFrame([(30,), (None,)], "probe int")
    assert [tuple(r) for r in bloom.filter_candidates(filters, probes).collect()] == [(30, 1)]
    assert [tuple(r) for r in bloom.probe_groups(df, "code", [30, 31]).collect()] == [(30, 1)]
    with pytest.raises(ValueError, match="no Bloom filter"):
        bloom.build_filters(df.withColumn("code", F.array("code")), "code")


def test_levels_of_maps_and_required_fields(spark):
    kind = T.StructType([T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.IntegerType(), False), True)), T.StructField("x", T.IntegerType(), False)])
    rows = [(1, {"m": {"a": [1, 2], "b": None, "c": []}, "x": 5}), (2, None), (3, {"m": None, "x": 6}), (4, {"m": {}, "x": 7})]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", kind)]))
    got = lambda *path: [tuple(r)[1:] for r in nested.nested_levels(df, "v", list(path), ["id"]).orderBy("id", "slot").collect()]
    assert got("x") == [(0, 0, 1, 5), (0, 0, 0, None), (0, 0, 1, 6), (0, 0, 1, 7)]
    assert got("m", "key") == [(0, 0, 3, "a"), (1, 1, 3, "b"), (2, 1, 3, "c"), (0, 0, 0, None), (0, 0, 1, None), (0, 0, 2, None)]
    assert got("m", "value", "element") == [(0, 0, 5, 1), (1, 2, 5, 2), (2, 1, 3, None), (3, 1, 4, None), (0, 0, 0, None), (0, 0, 1, None), (0, 0, 2, None)]
    assert nested.max_levels(df.schema, "v.m.value.element") == (2, 5)
    for bad in (("m",), ("y",), ("x", "z")):
        with pytest.raises(KeyError):
            got(*bad)


def test_map_entries_refuse_other_shapes(spark):
    one = spark.range(1)
    entries = lambda sql: [tuple(e) for e in one.select(F.expr(sql).alias("v")).transform(lambda d: d.select(nested.map_entries_of(F.col("v"), d.schema["v"].dataType).alias("e"))).first().e or ()]
    assert entries("array(named_struct('_1', 1, '_2', 2), named_struct('_1', 1, '_2', 3))") == [(1, 2), (1, 3)]
    assert entries("cast(null as map<string, int>)") == entries("cast(null as array<array<int>>)") == []
    for bad in ("array(array(1, 2, 3))", "array(array(null, 2))", "array(cast(null as struct<key: int, value: int>))"):
        with pytest.raises(Exception, match="map (entry|key)"):
            entries(bad)
    with pytest.raises(TypeError):
        entries("1")


def test_pages_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(layout, "CHUNK", 4)
    df = spark.range(23).toDF("page")
    assert [r.s for r in layout.running_total(df, "page", "page", "s").orderBy("page").collect()] == [sum(range(k)) for k in range(23)]
    for dip, want in ((None, "ASCENDING"), (8, "UNORDERED"), (9, "UNORDERED")):
        low = F.when(F.col("page") == dip, -1).otherwise(F.when(F.col("page") % 5 != 2, F.col("page"))) if dip else F.when(F.col("page") % 5 != 2, F.col("page"))
        assert layout.boundary_order(df.select("page", low.alias("lo"), low.alias("hi")), "lo", "hi").first()[0] == want
    assert layout.boundary_order(df.select("page", (-F.col("page")).alias("lo"), (-F.col("page")).alias("hi")), "lo", "hi").first()[0] == "DESCENDING"


def test_shredding_settings():
    shape = variant.shredding_shape({"a": "INT64", "value": "STRING", "o": {"typed_value": "INT32"}, "l": [{"b": "STRING"}]})
    assert shape == "`a` bigint, `l` array<struct<b:string>>" and variant.shredding_shape({"o": {}}) is None
    schema = T.StructType([T.StructField("v", T.VariantType()), T.StructField("w", T.VariantType())])
    alike = plan_write([ColumnSpec("v", "VARIANT", shredding={"a": "INT64"}), ColumnSpec("w", "VARIANT", shredding="a bigint")], schema=schema)
    assert "`a` bigint" in alike.session.values()
    with pytest.raises(ValueError, match="alike"):
        plan_write([ColumnSpec("v", "VARIANT", shredding={"a": "INT64"})], schema=schema)
    with pytest.raises(ValueError, match="no shredding shape"):
        variant.shredding_shape({"a": 3})


def test_annotated_values_and_order(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(3, bytes(16), 1.5), (None, None, None), (1, bytes(range(16)), -2.0)], "k int, u binary, h float")
    sink.write_arrow(df.coalesce(1), path, [ColumnSpec("u", "UUID"), ColumnSpec("h", "FLOAT16")], sorting=["-k"])
    t = pq.read_table(next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet"))
    assert t.column("k").to_pylist() == [3, 1, None] and t.schema.field("h").type == pa.float16()
    assert {r.column: (r.logical, r.sorting) for r in sink.footers(spark, path).collect()} == {"k": ("NONE", 0), "u": ("UUID", None), "h": ("FLOAT16", None)}
    with pytest.raises(ValueError, match="write_arrow"):
        sink.write_native(df, path, [ColumnSpec("u", "UUID")])


def test_keys_at_any_level(spark):
    df = spark.createDataFrame([('{"b":{"a":[{"c":1}]}}',), ("[1,[]]",), (None,), ("3",)], "j string").select(F.parse_json("j").alias("v"))
    assert [tuple(r) for r in variant.all_keys(df, "v").orderBy("id").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(Exception, match="deeper"):
        variant.all_keys(df, "v", depth=1).collect()
