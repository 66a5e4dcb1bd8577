"""Column types and specifications, and the schemas that they give."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Basic type names and their Spark types. Annotations that Spark can't read back (UUID, half floats,
#: geometries, counts since midnight or of nanoseconds) live in field metadata; the Arrow sink writes them.
BASIC: dict[str, T.DataType] = {
    "BOOLEAN": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
    "BYTE_ARRAY": T.BinaryType(), "STRING": T.StringType(), "JSON": T.StringType(), "TIMESTAMP": T.TimestampType(), "DATE": T.DateType(),
    "UUID": T.BinaryType(), "FLOAT16": T.FloatType(), "GEOMETRY": T.BinaryType(), "GEOGRAPHY": T.BinaryType(), "VARIANT": T.VariantType(),
    "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0), "TIME": T.LongType(), "TIME_MILLIS": T.LongType(), "TIMESTAMP_NANOS": T.LongType(),
}

#: What each encoding takes, by Spark type name.
ENCODINGS = {
    "PLAIN": None, "RLE": {"boolean"}, "RLE_DICTIONARY": {"int", "bigint", "float", "double", "string", "binary", "date", "timestamp"},
    "DELTA_BINARY_PACKED": {"int", "bigint", "date", "timestamp"}, "DELTA_LENGTH_BYTE_ARRAY": {"string", "binary"},
    "DELTA_BYTE_ARRAY": {"string", "binary"}, "BYTE_STREAM_SPLIT": {"int", "bigint", "float", "double"},
}
#: Types that are more than their Spark type says.
LOGICAL = ("JSON", "UUID", "FLOAT16", "GEOMETRY", "GEOGRAPHY", "UINT32", "UINT64", "TIME", "TIME_MILLIS", "TIMESTAMP_NANOS")
CODECS = ("none", "snappy", "gzip", "zstd", "lz4")


@dataclass(frozen=True)
class ColumnSpec:
    """How one column is typed and written. Unset fields leave the choice to inference and the writer."""

    name: str
    type: str | T.DataType | None = None
    nullable: bool = True
    encoding: str | None = None
    codec: str | None = None
    bloom: bool = False
    bloom_ndv: int | None = None
    bloom_fpp: float = 0.01
    statistics: bool = True
    #: "auto", or the shape to shred by: a Spark type, its DDL, or names of basic types in dicts and lists.
    shredding: object = None
    metadata: dict = field(default_factory=dict)

    def data_type(self) -> T.DataType:
        if isinstance(self.type, T.DataType):
            return self.type
        if self.type in BASIC:
            return BASIC[self.type]
        if self.type is None:
            raise ValueError(f"column {self.name} has no type; infer one first")
        return T._parse_datatype_string(self.type)

    def field(self) -> T.StructField:
        note = {"logical": self.type} if self.type in LOGICAL else {}
        return T.StructField(self.name, self.data_type(), self.nullable, note | self.metadata)

    def check(self) -> None:
        """Refuse encodings and codecs that the column can't have."""
        kind = self.data_type().simpleString()
        if self.encoding is not None:
            if self.encoding not in ENCODINGS:
                raise ValueError(f"unknown encoding {self.encoding}")
            takes = ENCODINGS[self.encoding]
            if takes is not None and kind not in takes:
                raise ValueError(f"{self.encoding} doesn't fit column {self.name} of type {kind}")
        if self.codec is not None and self.codec.lower() not in CODECS:
            raise ValueError(f"no compressor for codec {self.codec}")
        if self.shredding is not None and kind != "variant":
            raise ValueError(f"only variants are shredded; {self.name} is {kind}")


def schema_of(specs: Sequence[ColumnSpec], overrides: dict[str, T.StructField] | None = None) -> T.StructType:
    """Schema of specs; overrides replace whole flat fields by name and must name known columns."""
    overrides = dict(overrides or {})
    names = [s.name for s in specs]
    if len(set(names)) != len(names):
        raise ValueError("column names repeat")
    out = T.StructType()
    for s in specs:
        o = overrides.pop(s.name, None)
        if o is not None:
            if o.name != s.name:
                raise ValueError(f"an override for {s.name} is named {o.name}")
            if isinstance(o.dataType, (T.StructType, T.ArrayType, T.MapType)):
                raise ValueError(f"an override for {s.name} must be flat")
            out = out.add(o)
        else:
            out = out.add(s.field())
    if overrides:
        raise ValueError(f"overrides for unknown columns: {sorted(overrides)}")
    return out
