"""DataFrames from column arrays, rows and iterables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loamcast.infer import SAMPLE, infer_column, infer_schema
from loamcast.types import ColumnSpec, schema_of


def from_columns(spark: SparkSession, columns: dict[str, Sequence], specs: Iterable[ColumnSpec] = (), schema: T.StructType | None = None, overrides: dict | None = None) -> DataFrame:
    """A DataFrame of column arrays of equal length. A schema excludes specs and overrides."""
    declared = {s.name: s for s in specs}
    if schema is not None and (declared or overrides):
        raise ValueError("give a schema or column types, not both")
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    if missing := set(declared) - set(columns):
        raise ValueError(f"no data for columns {sorted(missing)}")
    schema = schema or infer_schema(columns, declared, overrides)
    if any(isinstance(f.dataType, T.VariantType) for f in schema.fields):
        return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)
    plain = {n: v.tolist() if isinstance(v, np.ndarray) else list(v) for n, v in columns.items()}
    _no_nulls(plain, schema)
    return spark.createDataFrame(pa.table(plain, schema=to_arrow_schema(schema)), schema)


def _no_nulls(columns: dict[str, list], schema: T.StructType) -> None:
    for f in schema.fields:
        if not f.nullable and any(v is None for v in columns[f.name]):
            raise ValueError(f"column {f.name} isn't nullable and holds a null")


def from_rows(spark: SparkSession, rows: Iterable[dict], columns: Sequence[str | ColumnSpec], schema: T.StructType | None = None, batch: int = 100_000) -> DataFrame:
    """A DataFrame of row dicts: the listed columns in their order; a missing field is null.

    Rows may come from a generator. Types that aren't given are fixed by the first SAMPLE rows. The
    rows pass in batches through the driver, so sources that don't fit belong in a reader or a stream.
    """
    specs = [c if isinstance(c, ColumnSpec) else ColumnSpec(c) for c in columns]
    if schema is not None and any(s.type is not None for s in specs):
        raise ValueError("give a schema or column types, not both")
    it = iter(rows)
    head = list(islice(it, SAMPLE))
    if schema is None:
        done = []
        for s in specs:
            if s.type is None:
                found = infer_column(s.name, [r.get(s.name) for r in head])
                s = ColumnSpec(s.name, found.type, True)
            done.append(s)
        schema = schema_of(done)
    parts = [spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in part], schema) for part in _batches(head, it, batch)]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.union(p)
    return out


def _batches(head: list, rest: Iterator, size: int) -> Iterator[list]:
    part = head + list(islice(rest, max(0, size - len(head))))
    while part:
        yield part
        part = list(islice(rest, size))


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in that order; the scan reads no others."""
    return df.select(*names)
