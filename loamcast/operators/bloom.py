"""Split-block Bloom filters: sizes, writer options, building, and which groups a probe can't rule out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

FPP, MOST = 0.01, 1 << 20
#: Types whose plain bytes are hashed as readers expect; others get no filter.
HASHABLE = ("int", "bigint", "float", "double", "string", "binary")
#: Logical types whose values have other forms than the stored ones, so that a filter of these couldn't be asked.
UNHASHED = ("UUID", "JSON", "FLOAT16", "GEOMETRY", "GEOGRAPHY", "VARIANT", "UINT32", "UINT64")

# Fixed values of the format: a word's salt each, and the primes of XXH64.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def filter_bytes(ndv: Column, fpp: float = FPP) -> Column:
    """Bytes of a split-block filter: 32-byte blocks, a power of two below 1 KiB, 128 MiB at most."""
    bits = -8.0 * ndv.cast("double") / F.lit(math.log(1 - fpp ** (1 / 8)))
    blocks = F.greatest(F.ceil(bits / 256) * 32, F.lit(32))
    power = F.pow(F.lit(2.0), F.ceil(F.log2(blocks.cast("double")) - 1e-9)).cast("long")
    return F.least(F.when(blocks < 1024, power).otherwise(blocks), F.lit(128 << 20)).cast("long")


def bloom_options(ndv: dict[str, int], fpp: float = FPP, most: int = MOST) -> dict[str, str]:
    """Writer options that give the columns of ndv their filters."""
    out = {"parquet.bloom.filter.max.bytes": str(most)}
    for c, n in ndv.items():
        out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(max(1, n)), f"parquet.bloom.filter.fpp#{c}": str(fpp)}
    return out


def xxh64(values: pa.Array) -> np.ndarray:
    """Unsigned XXH64 (seed 0) of each value's plain bytes, as filters hash them."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        plain = values.cast(pa.large_binary()).to_pylist()
        return np.array([xxhash.xxh64_intdigest(x) for x in plain], np.uint64)
    x = values.to_numpy(zero_copy_only=False)
    raw = x.astype(x.dtype.newbyteorder("<")).view(f"<u{x.dtype.itemsize}").astype(np.uint64)
    with np.errstate(over="ignore"):
        h = _P5 + np.uint64(x.dtype.itemsize)
        if x.dtype.itemsize == 8:
            h = _rotated(h ^ _rotated(raw * _P2, 31) * _P1, 27) * _P1 + _P4
        else:
            h = _rotated(h ^ raw * _P1, 23) * _P2 + _P3
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _words_and_bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash, the eight words of its block and the bit that it has in each."""
    block = (hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    words = block.astype(np.int64)[:, None] * 8 + np.arange(8)
    return words, np.uint32(1) << (hashes.astype(np.uint32)[:, None] * SALTS >> np.uint32(27))


def create_filter(hashes: np.ndarray, size: int) -> bytes:
    """A split-block filter of `size` bytes (a multiple of 32) that holds the hashes."""
    words = np.zeros(size // 4, np.uint32)
    if len(hashes):
        at, bits = _words_and_bits(hashes, size // 32)
        np.bitwise_or.at(words, at.ravel(), bits.ravel())
    return words.astype("<u4").tobytes()


def may_contain(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; never false for one that is."""
    words = np.frombuffer(filter_, "<u4")
    at, bits = _words_and_bits(hashes, len(words) // 8)
    return ((words[at] & bits) == bits).all(1)


def build_filters(df: DataFrame, column: str, group: str = "row_group", fpp: float = FPP) -> DataFrame:
    """(group, ndv, filter): the filter of each group's distinct non-null values.

    Values are made distinct before the shuffle; a group is a row group, of a bounded number of rows.
    """
    kind = df.schema[column].dataType.simpleString()
    if kind not in HASHABLE:
        raise ValueError(f"{column} of type {kind} gets no Bloom filter")
    values = df.where(F.col(column).isNotNull()).select(group, column).distinct()
    # Counted where they are put together, so that df is computed once.
    counted = values.withColumn("ndv", F.count(F.lit(1)).over(Window.partitionBy(group)))
    sized = counted.withColumn("size", filter_bytes(F.col("ndv"), fpp))
    schema = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("ndv", T.LongType()), T.StructField("filter", T.BinaryType())])

    def run(key, table):
        hashes = xxh64(table.column(column).combine_chunks())
        made = create_filter(hashes, table.column("size")[0].as_py())
        return pa.table({group: pa.array([key[0].as_py()], table.schema.field(group).type), "ndv": pa.array([table.num_rows], pa.int64()), "filter": pa.array([made], pa.binary())})

    return sized.select(group, column, "size").groupBy(group).applyInArrow(run, schema)


def filter_candidates(filters: DataFrame, probes: DataFrame, probe: str = "probe", group: str = "row_group") -> DataFrame:
    """(probe, group) pairs that the filters can't rule out.

    probes is a list that a query names and is handed to every task; filters stay where they are.
    """
    values = probes.select(probe).where(F.col(probe).isNotNull()).distinct().toArrow().column(0).combine_chunks()
    hashes = xxh64(values) if len(values) else np.empty(0, np.uint64)
    schema = T.StructType([probes.schema[probe], filters.schema[group]])

    def run(batches):
        for b in batches:
            for g, f in zip(b.column(0), b.column(1), strict=True):
                hit = values.filter(pa.array(may_contain(f.as_py(), hashes)))
                yield pa.RecordBatch.from_arrays([hit, pa.array([g.as_py()] * len(hit), b.schema.field(0).type)], names=[probe, group])

    return filters.select(group, "filter").mapInArrow(run, schema)


def probe_groups(df: DataFrame, column: str, probes: list, group: str = "row_group") -> DataFrame:
    """(probe, group): groups that hold a probe. Filters rule groups out, the rest are looked into."""
    values = df.sparkSession.createDataFrame([(p,) for p in probes], T.StructType([T.StructField("probe", df.schema[column].dataType)]))
    left = filter_candidates(build_filters(df, column, group), values, group=group)
    return df.select(F.col(column).alias("probe"), group).join(left, ["probe", group], "left_semi").distinct()
