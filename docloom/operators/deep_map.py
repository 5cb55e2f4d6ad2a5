"""Ordered replace, rename and remove rules over whole documents.

For typed columns the matching of keys and paths happens when the plan is made, for the keys of maps in the plan itself,
and the rules become a projection. Documents of unknown shape (JSON text, Variant columns) go through an Arrow-batched
Python function.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import DENIED, join_path, kind_of, parse_path
from docloom.plans.predicate import translate_regex
from docloom.plans.values import of


@dataclass(frozen=True)
class Target:
    """Where a rule applies: everywhere, at a key, at keys that hold a text or match a pattern, or at one path."""

    key: str | None = None
    search_key: str | re.Pattern | None = None
    path: str | None = None

    def hits(self, key: str, path: str) -> bool:
        if self.key is not None:
            return key == self.key
        if self.search_key is not None:
            return bool(self.search_key.search(key)) if isinstance(self.search_key, re.Pattern) else self.search_key in key
        return path == self.path if self.path is not None else True


@dataclass(frozen=True)
class ReplaceValue:
    current: Any
    replacement: Any
    target: Target = Target()


@dataclass(frozen=True)
class ReplaceInString:
    """``search`` as text replaces its first occurrence; as a pattern every match, or the first with ``first``."""

    search: str | re.Pattern
    replacement: str
    target: Target = Target()
    first: bool = False


@dataclass(frozen=True)
class RenameKey:
    target: Target
    name: str


@dataclass(frozen=True)
class RemoveKey:
    target: Target
    all: bool = False


def _is_leaf(t: T.DataType) -> bool:
    return not isinstance(t, (T.StructType, T.ArrayType, T.MapType))


def _leaf(c: Column, t: T.DataType, rule: ReplaceValue | ReplaceInString) -> Column:
    if isinstance(rule, ReplaceValue):
        if rule.current is None:
            return F.coalesce(c, F.lit(rule.replacement).cast(t))
        return F.when(of(c, t).equals(rule.current), F.lit(rule.replacement).cast(t)).otherwise(c)
    if kind_of(t) != "string":
        return c
    if isinstance(rule.search, re.Pattern):
        pattern, new = rule.search.pattern, re.sub(r"\\(\d)", r"$\1", rule.replacement)
        if rule.first:
            return _first_match(c, pattern, new)
        return F.regexp_replace(c, pattern, new)
    at = F.instr(c, rule.search)
    return F.when(at > 0, F.overlay(c, F.lit(rule.replacement), at, F.lit(len(rule.search)))).otherwise(c)


def _first_match(c: Column, pattern: str, new: str) -> Column:
    found = F.regexp_substr(c, F.lit(pattern))
    at = F.instr(c, found)
    return F.when(found.isNotNull() & (at > 0), F.overlay(c, F.regexp_replace(found, pattern, new), at, F.length(found))).otherwise(c)


Path = str | Column


def _below(path: Path | None, key: Path) -> Path:
    """The path of a member; below a map it is known only from the row."""
    if isinstance(key, str) and (path is None or isinstance(path, str)):
        return join_path(*([] if path is None else parse_path(path)), key)
    escaped = F.lit(join_path(key)) if isinstance(key, str) else F.replace(key, F.lit("."), F.lit("\\."))
    return escaped if path is None else F.concat(F.lit(path) if isinstance(path, str) else path, F.lit("."), escaped)


def _hits(target: Target, key: Path, path: Path) -> bool | Column:
    """``Target.hits`` where key or path may be columns."""
    if target.key is not None:
        return key == target.key
    if target.search_key is not None:
        if isinstance(key, str):
            return target.hits(key, "")
        return key.rlike(translate_regex(target.search_key.pattern, "i" if target.search_key.flags & re.I else "")) if isinstance(target.search_key, re.Pattern) else key.contains(target.search_key)
    return path == target.path if target.path is not None else True


def _mapped(c: Column, t: T.DataType, key: Path, path: Path, rule, inside: bool = False) -> Column:
    """The value with the rule applied to its leaves (their key and path decide)."""
    if isinstance(t, T.StructType):
        fields = [_mapped(c.getField(f.name), f.dataType, f.name, _below(path, f.name), rule, inside).alias(f.name) for f in t.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda e: _mapped(e, t.elementType, key, path, rule, True))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda k, v: _mapped(v, t.valueType, k, _below(path, k), rule, True))
    if isinstance(t, T.VariantType):
        return _variant(c, key, path, rule, inside)
    hit = _hits(rule.target, key, path)
    return F.when(hit, _leaf(c, t, rule)).otherwise(c) if isinstance(hit, Column) else _leaf(c, t, rule) if hit else c


def _variant(c: Column, key: Path, path: Path, rule, inside: bool) -> Column:
    if inside or not isinstance(path, str):
        raise ValueError(f"a Variant inside a list or map cannot be mapped: {path if isinstance(path, str) else '*'}")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else json.dumps(map_value(json.loads(x), [rule], key, tuple(parse_path(path))), ensure_ascii=False))

    return F.parse_json(run(F.to_json(c)))


def _shaped(names: list[str], path: tuple[str, ...], rule) -> list[tuple[str, str]]:
    """Old and new name of what stays of an object's keys."""
    out, done = [], False
    for n in names:
        hit = rule.target.hits(n, join_path(*path, n)) and n not in DENIED and not (done and not getattr(rule, "all", False))
        if hit and isinstance(rule, RemoveKey):
            done = True
        elif hit and rule.name not in DENIED and (rule.name == n or rule.name not in names):
            out.append((n, rule.name))
            done = True
        else:
            out.append((n, n))
    return out


def _reshaped_map(c: Column, t: T.MapType, path: Path, rule) -> Column:
    """A map with the rule on its keys: of several that are hit the first one, unless the rule takes all."""
    inner = F.transform_values(c, lambda k, v: _reshaped(v, t.valueType, _below(path, k), rule, True))
    keys = F.map_keys(c)

    def usable(k: Column) -> Column:
        hit = _hits(rule.target, k, _below(path, k))
        open_ = (F.lit(hit) if isinstance(hit, bool) else hit) & ~k.isin(*sorted(DENIED))
        return open_ if isinstance(rule, RemoveKey) else open_ & ((k == rule.name) | ~F.array_contains(keys, rule.name))

    if isinstance(rule, RemoveKey):
        first = F.get(F.filter(keys, usable), F.lit(0))
        return F.map_filter(inner, lambda k, v: ~(usable(k) if rule.all else k.eqNullSafe(first)))
    if rule.name in DENIED:
        return inner
    first = F.get(F.filter(keys, usable), F.lit(0))
    return F.transform_keys(inner, lambda k, v: F.when(k.eqNullSafe(first), F.lit(rule.name)).otherwise(k))


def _reshaped(c: Column, t: T.DataType, path: Path, rule, inside: bool = False) -> Column:
    if isinstance(t, T.StructType):
        if isinstance(path, str) or rule.target.path is None:
            steps = tuple(parse_path(path)) if isinstance(path, str) else ("*",)
            fields = [_reshaped(c.getField(old), t[old].dataType, _below(path, old), rule, inside).alias(new) for old, new in _shaped(t.names, steps, rule)]
            return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
        if isinstance(rule, RenameKey):
            raise ValueError("a field of structs in a map has one name in all of them: it cannot be renamed at one path")
        gone = lambda n: _below(path, n) == rule.target.path
        fields = [F.when(~gone(f.name) | F.lit(f.name in DENIED), _reshaped(c.getField(f.name), f.dataType, _below(path, f.name), rule, True)).alias(f.name) for f in t.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda e: _reshaped(e, t.elementType, path, rule, True))
    if isinstance(t, T.MapType):
        return _reshaped_map(c, t, path, rule)
    if isinstance(t, T.VariantType):
        return _variant(c, parse_path(path)[-1] if isinstance(path, str) else "*", path, rule, inside)
    return c


def map_deep(df: DataFrame, rules: list) -> DataFrame:
    """Apply the rules in their order to every row; each sees what those before it left.

    Keys of maps are matched row by row. A field of structs in a map that is removed at one path only becomes null there.
    Variant columns are mapped as documents; a Variant inside a list or map is refused.
    """
    for rule in rules:
        if isinstance(rule, (ReplaceValue, ReplaceInString)):
            df = df.select(*[_mapped(F.col(f"`{f.name}`"), f.dataType, f.name, join_path(f.name), rule).alias(f.name) for f in df.schema.fields])
        else:
            df = df.select(*[_reshaped(F.col(f"`{old}`"), df.schema[old].dataType, join_path(old), rule).alias(new) for old, new in _shaped(df.columns, (), rule)])
    return df


def map_value(doc: Any, rules: list, key: str = "", path: tuple[str, ...] = ()) -> Any:
    """The rules on a plain document (which is found at ``key`` and ``path``); parts that no rule touches are kept as they are."""

    def same(a: Any, b: Any) -> bool:
        return type(a) is type(b) and a == b or a is b

    def leaf(v: Any, rule) -> Any:
        if isinstance(rule, ReplaceValue):
            number = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (v, rule.current))
            return rule.replacement if same(v, rule.current) or number and v == rule.current else v
        if not isinstance(v, str):
            return v
        if isinstance(rule.search, str):
            return v.replace(rule.search, rule.replacement, 1)
        return rule.search.sub(rule.replacement, v, count=1 if rule.first else 0)

    def walk(v: Any, key: str, path: tuple[str, ...], rule) -> Any:
        values = isinstance(rule, (ReplaceValue, ReplaceInString))
        if isinstance(v, dict):
            names = [(k, k) for k in v] if values else _shaped(list(v), path, rule)
            out = {new: walk(v[old], old, (*path, old), rule) for old, new in names}
            return v if list(out) == list(v) and all(out[k] is v[k] for k in v) else out
        if isinstance(v, list):
            items = [walk(x, key, path, rule) for x in v]
            return v if all(a is b for a, b in zip(items, v, strict=True)) else items
        return leaf(v, rule) if values and rule.target.hits(key, join_path(*path)) else v

    for rule in rules:
        doc = walk(doc, key, path, rule)
    return doc


def map_deep_json(df: DataFrame, column: str, rules: list) -> DataFrame:
    """The rules on a column of JSON text whose shape is not known."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else json.dumps(map_value(json.loads(x), rules), ensure_ascii=False))

    return df.withColumn(column, run(F.col(f"`{column}`")))
