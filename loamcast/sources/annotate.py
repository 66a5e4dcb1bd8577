"""Logical types that Spark has no name for, set on Arrow batches as they are written."""

from __future__ import annotations

import pyarrow as pa


class Wkb(pa.ExtensionType):
    """WKB bytes that are written as GEOMETRY, or GEOGRAPHY with spherical edges."""

    def __init__(self, spherical: bool = False):
        self.spherical = spherical
        super().__init__(pa.binary(), "geoarrow.wkb")

    def __arrow_ext_serialize__(self) -> bytes:
        return b'{"edges":"spherical"}' if self.spherical else b"{}"

    @classmethod
    def __arrow_ext_deserialize__(cls, storage_type, serialized):
        return cls(b"spherical" in serialized)


#: Logical name to the Arrow type that carries it into the file.
ARROW: dict[str, pa.DataType] = {
    "UUID": pa.uuid(), "JSON": pa.json_(), "FLOAT16": pa.float16(), "UINT32": pa.uint32(), "UINT64": pa.uint64(),
    "TIME_MILLIS": pa.time32("ms"), "TIME": pa.time64("us"), "TIMESTAMP_NANOS": pa.timestamp("ns", "UTC"),
    "GEOMETRY": Wkb(), "GEOGRAPHY": Wkb(True),
}


def annotated_schema(schema: pa.Schema, logical: dict[str, str]) -> pa.Schema:
    return pa.schema([pa.field(f.name, ARROW[logical[f.name]] if f.name in logical else f.type, f.nullable) for f in schema])


def annotated(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with the types of an annotated schema; values that don't fit one are an error."""
    return pa.RecordBatch.from_arrays([_cast(x, f.type) for x, f in zip(batch.columns, schema, strict=True)], schema=schema)


def _cast(x: pa.Array, kind: pa.DataType) -> pa.Array:
    if x.type == kind:
        return x
    if isinstance(kind, pa.BaseExtensionType):
        return pa.ExtensionArray.from_storage(kind, x.cast(kind.storage_type))
    # Times are counted in the unit's own integers; half floats round.
    if pa.types.is_time32(kind):
        return x.cast(pa.int32()).cast(kind)
    return x.cast(kind)
