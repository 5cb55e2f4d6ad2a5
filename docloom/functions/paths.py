"""Dot paths into nested documents: text form, schema walk, and reading."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that never resolve, whatever holds them.
DENIED = frozenset(("__proto__", "prototype", "constructor"))


class PathError(ValueError):
    """A path that the schema cannot answer."""


def parse_path(path: str) -> list[str]:
    """Segments of a path: split at dots that no backslash escapes; ``\\.`` is a dot, nothing else is an escape."""
    return [s.replace("\\.", ".") for s in re.split(r"(?<!\\)\.", path)]


def escape_segment(segment: str) -> str:
    return segment.replace(".", "\\.")


def join_path(*segments: str) -> str:
    """Segments back to a path; empty ones are left out."""
    return ".".join(escape_segment(s) for s in segments if s != "")


def kind_of(dtype: T.DataType) -> str:
    """The kind that the filter language sees in a column type."""
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    if isinstance(dtype, T.VariantType):
        return "variant"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "other"


@dataclass(frozen=True)
class Resolved:
    """Where a path leads in a schema."""

    known: bool
    dtype: T.DataType | None = None
    #: Arrays crossed before the last value.
    arrays: int = 0
    #: Whether a map with free keys was crossed.
    record: bool = False


def resolve(path: str, schema: T.DataType) -> Resolved:
    """Walk a path through a schema. Below a map every key is known; a key ``"a.b"`` is only ``a\\.b``."""
    arrays, record, at = 0, False, schema
    for segment in parse_path(path):
        while isinstance(at, T.ArrayType):
            arrays, at = arrays + 1, at.elementType
        if segment in DENIED:
            return Resolved(False, None, arrays, record)
        if isinstance(at, T.MapType):
            record, at = True, at.valueType
        elif isinstance(at, T.VariantType):
            return Resolved(True, at, arrays, True)
        elif isinstance(at, T.StructType) and segment in at.names:
            at = at[segment].dataType
        else:
            return Resolved(False, None, arrays, record)
    return Resolved(True, at, arrays, record)


@dataclass
class PathNode:
    """A node of the schema tree."""

    path: str
    kind: str
    dtype: T.DataType
    optional: bool
    children: list[PathNode]


def schema_tree(schema: T.DataType, path: str = "", optional: bool = False) -> PathNode:
    """The tree of a schema; arrays have their element as a child of the same path, maps theirs under ``*``."""
    children: list[PathNode] = []
    if isinstance(schema, T.StructType):
        prefix = f"{path}." if path else ""
        children = [schema_tree(f.dataType, prefix + escape_segment(f.name), f.nullable) for f in schema.fields]
    elif isinstance(schema, T.ArrayType):
        children = [schema_tree(schema.elementType, path, schema.containsNull)]
    elif isinstance(schema, T.MapType):
        children = [schema_tree(schema.valueType, f"{path}.*" if path else "*", schema.valueContainsNull)]
    return PathNode(path, kind_of(schema), schema, optional, children)


def path_kinds(schema: T.DataType) -> dict[str, str]:
    """Kind of every path of a schema (an array's own kind, not its element's)."""
    out: dict[str, str] = {}

    def walk(node: PathNode) -> None:
        out.setdefault(node.path, node.kind)
        for c in node.children:
            walk(c)

    walk(schema_tree(schema))
    out.pop("", None)
    return out


def schema_at(path: str, schema: T.DataType, unwrap_array: bool = False) -> T.DataType | None:
    found = resolve(path, schema)
    dtype = found.dtype
    while unwrap_array and isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return dtype


def read(df: DataFrame, path: str) -> Column:
    """The value at a path that crosses no array; a missing one is null."""
    column: Column | None = None
    at: T.DataType = df.schema
    for s in parse_path(path):
        if isinstance(at, T.MapType):
            column, at = F.try_element_at(column, F.lit(s)), at.valueType
        elif isinstance(at, T.StructType) and s in at.names and s not in DENIED:
            column, at = (F.col(f"`{s}`") if column is None else column.getField(s)), at[s].dataType
        elif isinstance(at, T.VariantType):
            column = variant_key(column, s)
        else:
            return F.lit(None)
    return column


def read_or(df: DataFrame, path: str, default) -> Column:
    return F.coalesce(read(df, path), F.lit(default))


def variant_key(v: Column, key: str) -> Column:
    """The member of a variant object; null where there is none or ``v`` is no object."""
    if key in DENIED:
        return F.lit(None).cast("variant")
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key):
        return F.try_variant_get(v, f"$.{key}", "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


def leaves(column: Column, dtype: T.DataType, path: str) -> Column:
    """All values at a path that may cross arrays, as one array (missing ones left out)."""

    def walk(c: Column, t: T.DataType, rest: list[str]) -> tuple[Column, T.DataType]:
        if not rest:
            return F.array(c), t
        if isinstance(t, T.ArrayType):
            inner: list[T.DataType] = []

            def each(e: Column) -> Column:
                out, leaf = walk(e, t.elementType, rest)
                inner.append(leaf)
                return out

            nested = F.transform(c, each)
            return F.flatten(F.coalesce(nested, F.array().cast(T.ArrayType(T.ArrayType(inner[0]))))), inner[0]
        if isinstance(t, T.MapType):
            return walk(F.try_element_at(c, F.lit(rest[0])), t.valueType, rest[1:])
        if isinstance(t, T.StructType) and rest[0] in t.names and rest[0] not in DENIED:
            return walk(c.getField(rest[0]), t[rest[0]].dataType, rest[1:])
        raise PathError(f"no value at {path!r}")

    out, _ = walk(column, dtype, parse_path(path))
    return F.filter(out, lambda x: x.isNotNull())


def flatten_columns(df: DataFrame) -> DataFrame:
    """One column per leaf path (arrays and maps are leaves), named by its path with dots as they are."""
    out: list[Column] = []

    def walk(c: Column, t: T.DataType, name: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(c.getField(f.name), f.dataType, f"{name}.{f.name}")
        else:
            out.append(c.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*out)


def set_value(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Set the value at a path of structs; missing parents are built."""
    head, *rest = parse_path(path)
    if not rest:
        return df.withColumn(head, value)
    return df.withColumn(head, with_path(F.col(f"`{head}`"), df.schema[head].dataType, rest, value))


def with_path(c: Column, dtype: T.DataType, segments: list[str], value: Column) -> Column:
    """A struct with one nested field replaced, also where the struct itself is null."""
    if not segments:
        return value.cast(dtype)
    if not isinstance(dtype, T.StructType) or segments[0] not in dtype.names:
        raise PathError(f"no field {segments[0]!r} to set")
    fields = [
        (with_path(c.getField(f.name), f.dataType, segments[1:], value) if f.name == segments[0] else c.getField(f.name)).alias(f.name)
        for f in dtype.fields
    ]
    return F.struct(*fields)
