"""Semi-structured values: encoding, keys, shape detection and splitting by shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loamcast.types import BASIC

DEPTH, LEAVES = 3, 256
_RESERVED = ("value", "typed_value")
_SHREDDED = {"bigint": "INT64", "double": "DOUBLE", "string": "STRING", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "int": "INT32"}


def encode(json: Column) -> Column:
    """Variant of a JSON text. SQL NULL is a missing row; a JSON null is a value of its own."""
    return F.parse_json(json)


def keys(df: DataFrame, column: str) -> DataFrame:
    """(key, n): top-level keys of a variant column's objects."""
    objects = df.where(F.schema_of_variant(column).startswith("OBJECT"))
    return objects.select(F.col(column).alias("__v")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer())).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def detect_shape(df: DataFrame, column: str, depth: int = DEPTH, leaves: int = LEAVES) -> str | None:
    """DDL of the fields that a variant column can be split by, or None.

    One aggregate over all rows finds the merged shape; fields of conflicting types, deeper than `depth`
    or with reserved names stay unsplit, and more than `leaves` leaves mean no shape at all.
    """
    text = df.agg(F.schema_of_variant_agg(column)).first()[0]
    if not text or not text.startswith("OBJECT"):
        return None
    shape = prune(T._parse_datatype_string(text.replace("OBJECT<", "STRUCT<")), depth)
    if shape is None or count_leaves(shape) > leaves:
        return None
    return shape.simpleString()


def prune(kind: T.DataType, depth: int) -> T.DataType | None:
    if isinstance(kind, T.StructType):
        if depth <= 0:
            return None
        inner = [(f.name, prune(f.dataType, depth - 1)) for f in kind.fields if f.name not in _RESERVED]
        inner = [(n, k) for n, k in inner if k is not None]
        return T.StructType([T.StructField(n, k) for n, k in inner]) if inner else None
    if isinstance(kind, T.ArrayType):
        k = prune(kind.elementType, depth - 1)
        return T.ArrayType(k) if k is not None and depth > 0 else None
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    return kind if kind.simpleString() in _SHREDDED else None


def shredding_shape(config) -> str | None:
    """DDL of the shape that a shredding setting means, or None if nothing of it is left.

    Dicts are objects, one-element lists are arrays, and strings name basic types or are DDL. Fields with
    reserved names and objects without fields are left out.
    """
    if isinstance(config, str) and config not in BASIC:
        config = T.DataType.fromDDL(config)
    kind = _shape_of(config)
    if isinstance(kind, T.StructType):
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    return kind.simpleString() if kind is not None else None


def _shape_of(config) -> T.DataType | None:
    if isinstance(config, T.StructType):
        config = {f.name: f.dataType for f in config.fields}
    elif isinstance(config, T.ArrayType):
        config = [config.elementType]
    if isinstance(config, dict):
        inner = [(n, _shape_of(c)) for n, c in config.items() if n not in _RESERVED]
        inner = [T.StructField(n, k) for n, k in inner if k is not None]
        return T.StructType(inner) if inner else None
    if isinstance(config, list | tuple):
        if len(config) != 1:
            raise ValueError("an array is shredded by one element shape")
        inside = _shape_of(config[0])
        return T.ArrayType(inside) if inside is not None else None
    if isinstance(config, str):
        return BASIC[config] if config in BASIC else T.DataType.fromDDL(config)
    if isinstance(config, T.DataType):
        return config
    raise ValueError(f"no shredding shape: {config!r}")


def all_keys(df: DataFrame, column: str, depth: int = 8) -> DataFrame:
    """Distinct object keys at any level of a variant column, in order of their bytes, with `id` from 0.

    Levels are opened one after the other in one pass, `depth` at most; deeper objects are an error.
    """
    tvf, name = df.sparkSession.tvf, F.col("key")
    level = df.select(F.col(column).alias("v"), F.array().cast("array<string>").alias("names"))
    for _ in range(depth):
        opened = level.lateralJoin(tvf.variant_explode_outer(F.col("v").outer()))
        level = opened.select(F.col("value").alias("v"), F.when(name.isNotNull(), F.array_append("names", name)).otherwise(F.col("names")).alias("names"))
    kind = F.schema_of_variant("v")
    deeper = kind.rlike("^(OBJECT<.|ARRAY<.)") & (kind != "ARRAY<VOID>") & (kind != "OBJECT<>")
    checked = F.when(deeper, F.raise_error(F.lit(f"objects are nested deeper than {depth}"))).otherwise(F.col("names"))
    names = level.select(F.explode(checked).alias("key")).distinct()
    return names.withColumn("id", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))  # a dictionary's keys


def count_leaves(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return sum(count_leaves(f.dataType) for f in kind.fields)
    return count_leaves(kind.elementType) if isinstance(kind, T.ArrayType) else 1


def split(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """df with a typed column per field; <field>_rest keeps, as JSON, a value that doesn't fit its type."""
    out = df
    for name, kind in fields.items():
        path = f"$.{name}"
        typed = F.try_variant_get(column, path, kind)
        raw = F.try_variant_get(column, path, "variant")
        fits = F.schema_of_variant(raw).isin({"bigint": ["BIGINT"], "double": ["BIGINT", "DOUBLE"], "string": ["STRING"], "boolean": ["BOOLEAN"]}.get(kind, [kind.upper()])) | F.schema_of_variant(raw).startswith("DECIMAL") & F.lit(kind == "double")
        out = out.withColumns({name: F.when(fits, typed), f"{name}_rest": F.when(~fits, F.to_json(raw))})
    return out
