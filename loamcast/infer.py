"""Types inferred from values: a bounded look at the first ones, strict about mixtures."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from itertools import islice

import numpy as np
from pyspark.sql import types as T

from loamcast.types import ColumnSpec, schema_of

SAMPLE = 1000
_NUMPY = {"b": T.BooleanType(), "U": T.StringType(), "M": T.TimestampType()}


def _kind(v: object) -> str:
    if isinstance(v, bool | np.bool_):
        return "BOOLEAN"
    if isinstance(v, int | np.integer):
        return "INT32" if -(1 << 31) <= int(v) < 1 << 31 else "INT64"
    if isinstance(v, float | np.floating):
        return "DOUBLE"
    if isinstance(v, bytes | bytearray | memoryview):
        return "BYTE_ARRAY"
    if isinstance(v, str):
        return "STRING"
    if isinstance(v, dt.datetime):
        return "TIMESTAMP"
    if isinstance(v, dt.date):
        return "DATE"
    if isinstance(v, dict | list | tuple):
        return "JSON"
    raise TypeError(f"no column type for {type(v).__name__}")


#: Numbers widen among themselves; nothing else mixes.
_WIDER = {frozenset(("INT32", "INT64")): "INT64", frozenset(("INT32", "DOUBLE")): "DOUBLE", frozenset(("INT64", "DOUBLE")): "DOUBLE"}


def infer_column(name: str, values: Iterable, sample: int = SAMPLE) -> ColumnSpec:
    """Spec of a column by its first `sample` values.

    None makes it nullable; no values or nulls alone give a nullable BYTE_ARRAY. Integers beyond 32 bits
    widen to INT64, integers and floats to DOUBLE; other mixtures are an error.
    """
    if isinstance(values, np.ndarray) and values.dtype.kind in "iuf":
        wide = {"f": {2: "FLOAT", 4: "FLOAT", 8: "DOUBLE"}, "i": {8: "INT64"}, "u": {4: "INT64", 8: "UINT64"}}[values.dtype.kind].get(values.dtype.itemsize, "INT32")
        return ColumnSpec(name, wide, nullable=False)
    found, nullable, seen = None, False, False
    for v in islice(values, sample):
        if v is None:
            nullable = True
            continue
        seen, kind = True, _kind(v)
        if found is None or found == kind:
            found = kind
        elif (wider := _WIDER.get(frozenset((found, kind)))) is not None:
            found = wider
        else:
            raise TypeError(f"column {name} mixes {found} and {kind}")
    return ColumnSpec(name, found or "BYTE_ARRAY", nullable=nullable or not seen)


def infer_schema(columns: dict[str, Sequence], declared: dict[str, ColumnSpec] | None = None, overrides: dict[str, T.StructField] | None = None) -> T.StructType:
    """Schema of columns of equal length; declared specs win over inference, overrides over both."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    declared = declared or {}
    return schema_of([declared.get(n) or infer_column(n, v) for n, v in columns.items()], overrides)
