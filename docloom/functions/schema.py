"""Schema introspection and declared shapes that a column type cannot hold.

A field may declare in its metadata what its type does not say: ``union`` (a list of DDL types, for Variant fields),
``strict`` (an object without other keys), ``normalizes`` (values are changed on the way in), ``literals``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import types as T

from docloom.functions.paths import escape_segment, kind_of


def fields(schema: T.DataType, path: str = "") -> Iterator[tuple[str, T.StructField]]:
    """Every field with its path, through arrays and maps (a map's values are at ``*``)."""
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            at = f"{path}.{escape_segment(f.name)}" if path else escape_segment(f.name)
            yield at, f
            yield from fields(f.dataType, at)
    elif isinstance(schema, T.ArrayType):
        yield from fields(schema.elementType, path)
    elif isinstance(schema, T.MapType):
        yield from fields(schema.valueType, f"{path}.*" if path else "*")


def declared_union(f: T.StructField) -> list[T.DataType]:
    return [T.DataType.fromDDL(t) for t in f.metadata.get("union", [])]


def shape_ambiguous_paths(schema: T.StructType) -> list[str]:
    """Paths whose declared arms are both an array and something else: a filter reads the two differently."""
    out = []
    for path, f in fields(schema):
        kinds = {kind_of(t) for t in declared_union(f)}
        if "array" in kinds and len(kinds) > 1:
            out.append(path)
    return out


def multi_scalar_paths(schema: T.StructType) -> list[str]:
    """Paths that hold scalars of several kinds; they need a Variant column."""
    return [p for p, f in fields(schema) if len({kind_of(t) for t in declared_union(f)} & {"string", "number", "bool", "time"}) > 1]


def normalizing_paths(schema: T.StructType) -> list[str]:
    return [p for p, f in fields(schema) if f.metadata.get("normalizes")]


def unwrapped(t: T.DataType) -> T.DataType:
    """The type below all arrays."""
    while isinstance(t, T.ArrayType):
        t = t.elementType
    return t


def shape(t: T.DataType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in t.fields} if isinstance(t, T.StructType) else {}


def is_object(t: T.DataType) -> bool:
    return isinstance(t, T.StructType)


def is_record(t: T.DataType) -> bool:
    return isinstance(t, T.MapType)


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def element_type(t: T.DataType) -> T.DataType | None:
    return t.elementType if isinstance(t, T.ArrayType) else None


def value_type(t: T.DataType) -> T.DataType | None:
    return t.valueType if isinstance(t, T.MapType) else None


def is_optional(f: T.StructField) -> bool:
    return f.nullable


def is_strict(f: T.StructField) -> bool:
    return bool(f.metadata.get("strict"))


def literals(f: T.StructField) -> list:
    return list(f.metadata.get("literals", []))


def unsafe_fields(schema: T.StructType) -> list[tuple[str, str]]:
    """Fields whose values JSON cannot carry there and back; a write engine refuses them."""
    bad = (T.BinaryType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)
    return [(p, f.dataType.simpleString()) for p, f in fields(schema) if isinstance(unwrapped(f.dataType), bad)]
