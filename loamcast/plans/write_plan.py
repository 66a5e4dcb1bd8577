"""Which sink and options a write needs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

from loamcast.functions.variant import shredding_shape
from loamcast.operators.bloom import HASHABLE, UNHASHED, bloom_options
from loamcast.operators.layout import PAGE_BYTES, ROW_GROUPS
from loamcast.types import LOGICAL, ColumnSpec

WRITE_SHREDDED, INFER_SHAPE, FORCED_SHAPE = "spark.sql.variant.writeShredding.enabled", "spark.sql.variant.inferShreddingSchema", "spark.sql.variant.forceShreddingSchemaForTest"
_DELTA = ("DELTA_BINARY_PACKED", "DELTA_BYTE_ARRAY")


@dataclass
class WritePlan:
    """options go to Spark's Parquet writer, session to the session while it writes; `custom` says that only
    the Arrow sink can do it."""

    session: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)
    custom: list[str] = field(default_factory=list)


def plan_write(specs: Sequence[ColumnSpec] = (), codec: str = "snappy", row_groups: Sequence[int] = (100_000,), page_bytes: int = PAGE_BYTES, statistics: bool = True, metadata: dict[str, str] | None = None, schema: T.StructType | None = None) -> WritePlan:
    """Options for the columns' encodings, filters and statistics, and what they leave to the Arrow sink.

    schema gives the types of columns whose spec has none; without either a column gets no Bloom filter.
    """
    written = {f.name: f for f in schema or ()}
    plan = WritePlan()
    o = plan.options
    o["compression"] = codec
    o["parquet.page.size"] = str(page_bytes)
    o["parquet.writer.version"] = "v2"
    if not row_groups or min(row_groups) <= 0:
        raise ValueError("row group sizes must be positive")
    o["parquet.block.row.count.limit"] = str(row_groups[-1])
    if len(row_groups) > 1:
        plan.custom.append("row group sizes that vary")
    if metadata:
        plan.custom.append("footer key-values")
    if not statistics:
        o["parquet.column.statistics.enabled"] = "false"
    for s in specs:
        if s.type is not None:
            s.check()
        if s.codec and s.codec.lower() != codec:
            plan.custom.append(f"codec of {s.name}")
        if s.encoding in _DELTA or s.encoding == "PLAIN":
            o[f"parquet.enable.dictionary#{s.name}"] = "false"
        elif s.encoding in ("BYTE_STREAM_SPLIT", "DELTA_LENGTH_BYTE_ARRAY"):
            plan.custom.append(f"encoding of {s.name}")
        if isinstance(s.type, str) and s.type in LOGICAL:
            plan.custom.append(f"logical type of {s.name}")
        if not s.statistics:
            o[f"parquet.column.statistics.enabled#{s.name}"] = "false"
        if s.bloom:
            at = written.get(s.name)
            kind = s.data_type() if s.type is not None else at.dataType if at else None
            logical = s.type if isinstance(s.type, str) else at.metadata.get("logical") if at else None
            if kind is not None and kind.simpleString() in HASHABLE and logical not in UNHASHED:
                o |= bloom_options({s.name: s.bloom_ndv or 100_000}, s.bloom_fpp)
    plan.session = shredding_settings(specs, schema)
    return plan


def shredding_settings(specs: Sequence[ColumnSpec], schema: T.StructType | None = None) -> dict[str, str]:
    """Session settings that shred variants as their specs say.

    Spark shreds all variants of a write by one given shape, or each file's by the shapes it finds; so
    variants with shapes that differ, or some with a shape and some without, are refused.
    """
    asked = {s.name: shredding_shape(s.shredding) if s.shredding != "auto" else "auto" for s in specs if s.shredding is not None}
    shapes = {s for s in asked.values() if s is not None}
    if not shapes:
        return {WRITE_SHREDDED: "false"} if asked else {}
    variants = {f.name for f in schema or () if isinstance(f.dataType, T.VariantType)} or set(asked)
    if len(shapes) > 1 or any(asked.get(v) is None for v in variants):
        raise ValueError("all variants of a table must be shredded alike")
    shape = shapes.pop()
    return {WRITE_SHREDDED: "true", INFER_SHAPE: str(shape == "auto").lower(), FORCED_SHAPE: "" if shape == "auto" else shape}


DEFAULT_ROW_GROUPS = ROW_GROUPS
