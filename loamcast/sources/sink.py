"""Parquet sinks: Spark's writer with planned options, an Arrow sink for finer control, and a buffer."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loamcast.operators.layout import ROW_GROUPS
from loamcast.plans.write_plan import plan_write
from loamcast.sources.annotate import ARROW, annotated, annotated_schema
from loamcast.types import ColumnSpec

FORMAT = "loamcast"
#: Bytes of an open row group that a writer holds in memory.
HELD = 256 << 20


def write_native(df: DataFrame, path: str, specs: Sequence[ColumnSpec] = (), mode: str = "overwrite", **layout) -> None:
    """Write through Spark's Parquet writer; refuses what only the Arrow sink can do."""
    plan = plan_write(specs, schema=df.schema, **layout)
    if plan.custom:
        raise ValueError(f"use write_arrow for: {', '.join(plan.custom)}")
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in plan.session}
    try:
        for k, v in plan.session.items():
            conf.set(k, v)
        df.write.mode(mode).options(**plan.options).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def group_sizes(sizes: Sequence[int]) -> Iterator[int]:
    """Sizes of successive row groups; the last repeats."""
    if not sizes or min(sizes) <= 0:
        raise ValueError("row group sizes must be positive")
    yield from sizes
    while True:
        yield sizes[-1]


class _Held:
    """Batches of the open row group; beyond HELD bytes they go to a temporary file, which is mapped to be read."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.batches, self.bytes, self.file, self.out = schema, [], 0, None, None

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)
        self.bytes += batch.nbytes
        if self.bytes > HELD:
            if self.file is None:
                self.file = tempfile.NamedTemporaryFile(prefix="loamcast-group-")
                self.out = pa.ipc.new_file(self.file.name, self.schema)
            for b in self.batches:
                self.out.write_batch(b)
            self.batches, self.bytes = [], 0

    def write(self, writer: pq.ParquetWriter, rows: int) -> None:
        parts = []
        if self.file is not None:
            self.out.close()
            spilled = pa.ipc.open_file(pa.memory_map(self.file.name))
            parts = [spilled.get_batch(k) for k in range(spilled.num_record_batches)]
        writer.write_table(pa.Table.from_batches(parts + self.batches, self.schema), row_group_size=rows)
        if self.file is not None:
            self.file.close()


def write_groups(writer: pq.ParquetWriter, batches: Iterator[pa.RecordBatch], sizes: Sequence[int], schema: pa.Schema) -> int:
    """Write batches as row groups of given sizes, holding HELD bytes of one group at most; returns the rows."""
    held, rows, total, plan = _Held(schema), 0, 0, group_sizes(sizes)
    want = next(plan)
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, want - rows)
            held.add(part)
            rows += part.num_rows
            at += part.num_rows
            if rows == want:
                held.write(writer, rows)
                total, held, rows, want = total + rows, _Held(schema), 0, next(plan)
    if rows:
        held.write(writer, rows)
    return total + rows


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _ArrowWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.o, self.overwrite = dict(options), overwrite
        self.run = uuid.uuid4().hex

    def _arguments(self, schema: pa.Schema) -> dict:
        o = {k.lower(): v for k, v in self.o.items()}
        names = {n.lower(): n for n in schema.names}
        out: dict = {"compression": o.get("codec", "snappy"), "write_statistics": o.get("statistics", "true") == "true", "data_page_size": int(o.get("page_bytes", 1 << 20)), "write_page_index": o.get("page_index", "true") == "true"}
        per = {names[k.lower()]: v for k, v in json.loads(o.get("codecs", "{}")).items() if k.lower() in names}
        if per:
            out["compression"] = {n: per.get(n, o.get("codec", "snappy")) for n in schema.names}
        encodings = {names[k.lower()]: v for k, v in json.loads(o.get("encodings", "{}")).items() if k.lower() in names}
        plain = {n: e for n, e in encodings.items() if e != "RLE_DICTIONARY"}
        if plain:
            out |= {"column_encoding": plain, "use_dictionary": [n for n in schema.names if n not in plain]}
        order = [(names[c.lower()], down) for c, down in json.loads(o.get("sorting", "[]"))]
        if order:
            out["sorting_columns"] = [pq.SortingColumn(schema.names.index(n), descending=down, nulls_first=not down) for n, down in order]
        return out

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, top = pafs.FileSystem.from_uri(self.o["path"])
        first = next(iterator, None)
        if first is None:
            return _Written("", 0)
        fs.create_dir(top, recursive=True)
        # The name starts with an underscore, which readers pass over, until the job commits.
        to = f"{top}/_{self.run}-{uuid.uuid4().hex}.parquet"
        sizes = json.loads(self.o.get("row_groups", json.dumps(list(ROW_GROUPS))))
        notes = json.loads(self.o.get("metadata", "{}"))
        names = {n.lower(): n for n in first.schema.names}
        schema = annotated_schema(first.schema, {names[k.lower()]: v for k, v in json.loads(self.o.get("logical", "{}")).items() if k.lower() in names})
        batches = (annotated(b, schema) for b in _chain(first, iterator))
        with fs.open_output_stream(to) as f, pq.ParquetWriter(f, schema, **self._arguments(schema)) as w:
            rows = write_groups(w, batches, sizes, schema)
            if notes:
                w.add_key_value_metadata(notes)
        return _Written(to, rows)

    def commit(self, messages: list) -> None:
        fs, top = pafs.FileSystem.from_uri(self.o["path"])
        fs.create_dir(top, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(top)) if f.base_name.startswith("part-")] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m and m.path):
            fs.move(m.path, f"{top}/part-{k:05d}-{self.run}.parquet")
        for f in old:
            fs.delete_file(f)
        with fs.open_output_stream(f"{top}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.o["path"])
        for m in messages:
            if m and m.path:
                fs.delete_file(m.path)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class ArrowSink(DataSource):
    """df.write.format("loamcast"): row_groups, codec, codecs, encodings, logical, sorting, statistics, page_bytes, metadata."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise NotImplementedError("this source is written only; read the files as parquet")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ArrowWriter(dict(self.options), overwrite)


def write_arrow(df: DataFrame, path: str, specs: Sequence[ColumnSpec] = (), codec: str = "snappy", row_groups: Sequence[int] = ROW_GROUPS, page_bytes: int = 1 << 20, statistics: bool = True, metadata: dict[str, str] | None = None, sorting: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write with a row group list, per-column codecs, encodings and logical types, and footer key-values.

    sorting names columns, with a minus in front for descending ones: files are sorted by them, each for
    itself, and their footers say so. Every task writes one file in a folder that all executors share; files appear when the job commits.
    """
    df.sparkSession.dataSource.register(ArrowSink)
    next(group_sizes(row_groups))
    for s in specs:
        if s.type is not None:
            s.check()
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    o = {"path": uri, "codec": codec, "row_groups": json.dumps(list(row_groups)), "page_bytes": str(page_bytes), "statistics": str(statistics).lower(), "metadata": json.dumps(metadata or {})}
    o["codecs"] = json.dumps({s.name: s.codec for s in specs if s.codec})
    order = [(c.removeprefix("-"), c.startswith("-")) for c in sorting]
    if order:
        df = df.sortWithinPartitions(*(F.desc(c) if down else F.asc(c) for c, down in order))
    o["sorting"] = json.dumps(order)
    noted = {f.name: f.metadata["logical"] for f in df.schema if f.metadata.get("logical") in ARROW}
    o["logical"] = json.dumps(noted | {s.name: s.type for s in specs if isinstance(s.type, str) and s.type in ARROW})
    o["encodings"] = json.dumps({s.name: s.encoding for s in specs if s.encoding})
    df.write.format(FORMAT).mode(mode).options(**o).save()


def to_buffer(df: DataFrame, row_groups: Sequence[int] = ROW_GROUPS, codec: str = "snappy", statistics: bool = True, metadata: dict[str, str] | None = None) -> bytes:
    """The whole Parquet file in memory on the driver, for small results."""
    table, out = df.toArrow(), io.BytesIO()
    with pq.ParquetWriter(out, table.schema, compression=codec, write_statistics=statistics) as w:
        write_groups(w, iter(table.to_batches()), row_groups, table.schema)
        if metadata:
            w.add_key_value_metadata(metadata)
    return out.getvalue()


class IncrementalWriter:
    """Append frames one by one to a table; finish() ends it."""

    def __init__(self, path: str, **layout):
        self.path, self.layout, self.open, self.first = path, layout, True, True

    def write(self, df: DataFrame) -> None:
        if not self.open:
            raise ValueError("the writer is finished")
        write_native(df, self.path, mode="overwrite" if self.first else "append", **self.layout)
        self.first = False

    def finish(self, spark: SparkSession) -> DataFrame:
        self.open = False
        return spark.read.parquet(self.path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per column chunk of all files: where it is, its size and codec, and how it is typed and sorted.

    Spark lists the files, and the tasks read their footers alone. logical is NONE where a column has no
    logical type; sorting is the place of the column in its group's order (from 0), or null.
    """
    schema = "file string, row_group int, n_rows long, column string, codec string, encodings string, has_bounds boolean, null_count long, bytes long, physical string, logical string, sorting int"

    def chunks(path: str):
        uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        fs, at = pafs.FileSystem.from_uri(uri)
        m = pq.read_metadata(at, filesystem=fs)
        for g in range(m.num_row_groups):
            group = m.row_group(g)
            order = {x.column_index: k for k, x in enumerate(group.sorting_columns)}
            for c in range(m.num_columns):
                x, kind = group.column(c), m.schema.column(c)
                s = x.statistics
                typed = json.loads(kind.logical_type.to_json())["Type"].upper()
                yield (path.rpartition("/")[2], g, group.num_rows, x.path_in_schema, x.compression, ",".join(sorted(set(x.encodings))), bool(s and s.has_min_max), s.null_count if s and s.has_null_count else None, x.total_compressed_size, x.physical_type, typed, order.get(c))

    def run(batches):
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                cols = list(zip(*chunks(name), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").load(path).select("path")
    return files.mapInArrow(run, schema)
