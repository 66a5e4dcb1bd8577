"""Nested values as levels: repetition and definition per slot, map shapes, rows to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def list_levels(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, slot, rep, def, value) of a nullable list of nullable values.

    def: 0 null list, 1 empty list, 2 null element, 3 value. Null and empty lists have one slot.
    """
    x = df.select(*keys, F.col(column).isNull().alias("__null"), F.posexplode_outer(column).alias("slot", "value"))
    level = F.when(F.col("__null"), 0).when(F.col("slot").isNull(), 1).when(F.col("value").isNull(), 2).otherwise(3)
    return x.select(*keys, F.coalesce("slot", F.lit(0)).alias("slot"), F.when(F.coalesce("slot", F.lit(0)) == 0, 0).otherwise(1).alias("rep"), level.alias("def"), "value")


def leaf_slots(value: Column, kind: T.DataType, path: list[str], nullable: bool = True) -> Column:
    """Array of (rep, def, value) slots of one leaf of a nested value; path as in max_levels.

    Every nullable node that exists and every list or map entry adds a definition level; an entry other
    than its list's first repeats at that list's depth. Null and empty lists have one slot.
    """
    return _slots(value, kind, list(path), nullable, F.lit(0), F.lit(0), 0)


def _slots(value: Column, kind: T.DataType, path: list[str], nullable: bool, dfn: Column, rep: Column, depth: int) -> Column:
    here = dfn + value.isNotNull().cast("int") if nullable else dfn
    if isinstance(kind, T.StructType):
        if not path or path[0] not in kind.names:
            raise KeyError(".".join(path))
        f = kind[path[0]]
        return _slots(value.getField(f.name), f.dataType, path[1:], f.nullable, here, rep, depth)
    if isinstance(kind, T.ArrayType | T.MapType):
        if not path:
            raise KeyError("a list or map is no leaf")
        if isinstance(kind, T.ArrayType):
            inside, entries, optional = kind.elementType, value, kind.containsNull
        elif path[0] == "key":
            inside, entries, optional = kind.keyType, F.map_keys(value), False
        else:
            inside, entries, optional = kind.valueType, F.map_values(value), kind.valueContainsNull
        leaf = _leaf_type(inside, path[1:])
        each = F.transform(entries, lambda x, k: _slots(x, inside, path[1:], optional, here + 1, F.when(k == 0, rep).otherwise(depth + 1), depth + 1))
        return F.when(F.size(entries) > 0, F.flatten(each)).otherwise(F.array(_slot(rep, here, F.lit(None).cast(leaf))))
    if path:
        raise KeyError(".".join(path))
    return F.array(_slot(rep, here, value))


def _slot(rep: Column, dfn: Column, value: Column) -> Column:
    return F.struct(rep.cast("int").alias("rep"), dfn.cast("int").alias("def"), value.alias("value"))


def _leaf_type(kind: T.DataType, path: list[str]) -> T.DataType:
    for name in path:
        if isinstance(kind, T.StructType):
            kind = kind[name].dataType
        elif isinstance(kind, T.ArrayType):
            kind = kind.elementType
        elif isinstance(kind, T.MapType):
            kind = kind.keyType if name == "key" else kind.valueType
        else:
            raise KeyError(name)
    return kind


def nested_levels(df: DataFrame, column: str, path: list[str], keys: list[str]) -> DataFrame:
    """(keys, slot, rep, def, value) of a leaf below lists, structs and maps in any nesting; no shuffle."""
    f = df.schema[column]
    out = df.select(*keys, F.posexplode(leaf_slots(F.col(column), f.dataType, path, f.nullable)).alias("slot", "s"))
    return out.select(*keys, "slot", "s.rep", "s.def", "s.value")


def map_entries_of(value: Column, kind: T.DataType) -> Column:
    """Array of (key, value) entries of a map in any of its shapes, in order, repeated keys included.

    Shapes: a map; a struct, whose fields are entries; an array of structs with key and value (other
    structs of two fields go by place); an array of two-element arrays. A null map stays null; a null
    key, a null entry or an entry of another form is an error.
    """
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    refuse = lambda why: F.raise_error(F.lit(why))
    if isinstance(kind, T.MapType):
        return F.map_entries(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.array(*(pair(F.lit(n), value.getField(n)) for n in kind.names)))
    entry = kind.elementType if isinstance(kind, T.ArrayType) else None
    if isinstance(entry, T.StructType) and {"key", "value"} <= set(entry.names):
        k, v, fits = (lambda e: e.getField("key")), (lambda e: e.getField("value")), lambda e: e.isNotNull()
    elif isinstance(entry, T.StructType) and len(entry.names) == 2:
        a, b = entry.names
        k, v, fits = (lambda e: e.getField(a)), (lambda e: e.getField(b)), lambda e: e.isNotNull()
    elif isinstance(entry, T.ArrayType):
        k, v, fits = (lambda e: F.get(e, F.lit(0))), (lambda e: F.get(e, F.lit(1))), lambda e: F.coalesce(F.size(e) == 2, F.lit(False))
    else:
        raise TypeError(f"no map shape: {kind.simpleString()}")
    checked = F.when(F.exists(value, lambda e: ~fits(e)), refuse("a map entry must have a key and a value"))
    checked = checked.when(F.exists(value, lambda e: k(e).isNull()), refuse("a map key is null")).otherwise(value)
    return F.transform(checked, lambda e: pair(k(e), v(e)))


def struct_levels(value: Column, path: list[str]) -> Column:
    """Definition level of a leaf below nullable structs: each struct and the leaf that exist add one."""
    at, level = value, value.isNotNull().cast("int")
    for name in path:
        at = at.getField(name)
        level = level + at.isNotNull().cast("int")
    return level


def map_from_pairs(pairs: Column) -> Column:
    """A map of an array of (key, value) structs; null keys are an error, the last of equal keys wins."""
    keys = F.transform(pairs, lambda p: p[0] if isinstance(p, tuple) else p.getField("key"))
    checked = F.when(F.exists(keys, lambda k: k.isNull()), F.raise_error(F.lit("a map key is null"))).otherwise(pairs)
    distinct = F.aggregate(checked, F.map_from_entries(F.slice(checked, 1, 0)), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.map_from_entries(F.array(p))))
    return distinct


def max_levels(schema, path: str) -> tuple[int, int]:
    """(repetition, definition) levels of a leaf by dotted path; list, key and value name inner nodes."""
    kind, rep, dfn = schema, 0, 0
    for name in path.split("."):
        if isinstance(kind, T.StructType):
            f = kind[name]
            kind, dfn = f.dataType, dfn + int(f.nullable)
        elif isinstance(kind, T.ArrayType):
            rep, dfn, kind = rep + 1, dfn + 1 + int(kind.containsNull), kind.elementType
        elif isinstance(kind, T.MapType):
            rep, dfn = rep + 1, dfn + 1
            if name == "key":
                kind = kind.keyType
            else:
                kind, dfn = kind.valueType, dfn + int(kind.valueContainsNull)
        else:
            raise KeyError(path)
    return rep, dfn


def leaf_paths(schema, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves in schema order."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in leaf_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return leaf_paths(schema.elementType, f"{prefix}.element")
    if isinstance(schema, T.MapType):
        return leaf_paths(schema.keyType, f"{prefix}.key") + leaf_paths(schema.valueType, f"{prefix}.value")
    return [prefix]


def transposed(df: DataFrame, columns: list[str], by: list[str], order_by: list[str]) -> DataFrame:
    """One row per group with an array per column, all in one order; a group is a bounded row group."""
    rows = F.array_sort(F.collect_list(F.struct(*order_by, *(F.col(c).alias(f"__{c}") for c in columns))))
    out = df.groupBy(*by).agg(rows.alias("r"))
    return out.select(*by, *(F.col("r").getField(f"__{c}").alias(c) for c in columns))
