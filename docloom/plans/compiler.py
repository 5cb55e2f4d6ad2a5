"""A filter as one Catalyst column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from docloom.functions.paths import parse_path, resolve
from docloom.functions.schema import normalizing_paths, shape_ambiguous_paths
from docloom.plans.evaluate import matches_missing
from docloom.plans.predicate import LOGIC, FilterError, Pred, check_filter, element_scalar, negated, parse_condition, split_negations, translate_regex
from docloom.plans.values import Missing, Root, Typed, Value, Variant, false, true


def balanced(parts: Sequence[Column], join: Callable[[Column, Column], Column], empty: Column) -> Column:
    """Join many columns as a tree of logarithmic depth."""
    parts = list(parts)
    if not parts:
        return empty
    while len(parts) > 1:
        parts = [reduce(join, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def all_of(parts: Sequence[Column]) -> Column:
    return balanced(parts, lambda a, b: a & b, true())


def any_of(parts: Sequence[Column]) -> Column:
    return balanced(parts, lambda a, b: a | b, false())


def compile_filter(f: dict, schema: T.StructType, doc: str | None = None, nulls_are: str = "missing") -> Column:
    """The filter over rows of ``schema``; with ``doc``, over the documents in that column."""
    check_filter(f)
    return _filter(f, Root(schema, doc, nulls_are))


@dataclass(frozen=True)
class CompileError:
    """Why a filter was not compiled: ``kind`` is filter, schema_ambiguous, schema_normalizes or path_conversion."""

    kind: str
    message: str
    path: str = ""


def try_compile(f: dict, schema: T.StructType, doc: str | None = None, nulls_are: str = "missing", conform: bool = False) -> tuple[Column | None, list[CompileError]]:
    """The column, or all reasons against it. With ``conform``, filters on paths whose declared shape is ambiguous or
    normalised, or that lead to a list under a map, are refused, as engines that only know the schema refuse them."""
    try:
        check_filter(f)
    except FilterError as e:
        return None, [CompileError("filter", str(e))]
    if conform:
        used = set(paths_of(f))
        bad = [CompileError("schema_ambiguous", "array and other shapes", p) for p in shape_ambiguous_paths(schema) if p in used]
        bad += [CompileError("schema_normalizes", "values change on the way in", p) for p in normalizing_paths(schema) if p in used]
        bad += [CompileError("path_conversion", "a list under free keys", p) for p in used if (at := resolve(p, schema)).record and (at.arrays or isinstance(at.dtype, T.ArrayType))]
        if bad:
            return None, bad
    return compile_filter(f, schema, doc, nulls_are), []


def paths_of(f: dict) -> list[str]:
    """Every path that a filter names at its own level."""
    out: list[str] = []
    for key, c in f.items():
        out += [p for sub in c for p in paths_of(sub)] if key in LOGIC else [key]
    return out


def _filter(f: dict, v: Value) -> Column:
    parts = []
    for key, c in f.items():
        if key == "$and":
            parts.append(all_of([_filter(x, v) for x in c]))
        elif key == "$or":
            parts.append(any_of([_filter(x, v) for x in c]))
        elif key == "$nor":
            parts.append(~any_of([_filter(x, v) for x in c]))
        else:
            parts.append(_field(parse_path(key), parse_condition(c), v))
    return all_of(parts)


def _field(segments: list[str], p: Pred, v: Value) -> Column:
    direct, crossed = v, False
    for i, s in enumerate(segments):
        if i and isinstance(direct, Typed) and direct.may_be_array():
            crossed = True
            break
        direct = direct.key(s)
    if crossed:
        return _spread(segments, p, v)
    if _holds_variant(segments, v):
        # The value decides: what can be read directly is, otherwise arrays on the way are crossed.
        found = direct.present()
        return (found & _holds(direct, p)) | (~found & _spread(segments, p, v))
    return _holds(direct, p)


def _holds_variant(segments: list[str], v: Value) -> bool:
    """Whether a Variant stands before the last segment, so that arrays may be crossed inside it."""
    at = v
    for s in segments[:-1]:
        at = at.key(s)
        if isinstance(at, Variant):
            return True
    return isinstance(v, Variant) and len(segments) > 1 or isinstance(v, Root) and v.doc is not None and isinstance(v.key(segments[0]), Variant) and len(segments) > 1


def _leaf(segments: list[str], v: Value, test: Callable[[Value], Column]) -> Column:
    """Whether some value that the path reaches through arrays passes."""
    if not segments:
        return v.present() & test(v)
    if isinstance(v, Missing):
        return false()
    if isinstance(v, Typed):
        if v.may_be_array():
            return v.any_element(lambda e: _leaf(segments, _present(e), test))
        return _leaf(segments[1:], v.key(segments[0]), test)
    if isinstance(v, Variant):
        return v.any_innermost(lambda e: _leaf(segments[1:], e.key(segments[0]), test))
    return _leaf(segments[1:], v.key(segments[0]), test)


def _present(e: Value) -> Value:
    """Below an array that is crossed, a typed null is a member that is not there."""
    return Typed(e.c, e.t, "missing") if isinstance(e, Typed) else e


def _spread(segments: list[str], p: Pred, v: Value) -> Column:
    reached = _leaf(segments, v, lambda x: true())
    verdict = _over(segments, p, v)
    return (reached & verdict) | ~reached if matches_missing(p) else reached & verdict


def _over(segments: list[str], p: Pred, v: Value) -> Column:
    core = negated(p)
    if core is not None:
        return ~_over(segments, core, v)
    yes, no = split_negations(p)
    parts = [] if yes is None else [_leaf(segments, v, lambda x: _holds(x, yes))]
    return all_of(parts + [_over(segments, q, v) for q in no])


def _some(v: Value, test: Callable[[Value], Column]) -> Column:
    """The value, or one element of it where it is an array, passes."""
    if v.must_be_array():
        return v.any_element(test)
    return test(v) | v.any_element(test) if v.may_be_array() else test(v)


def _holds(v: Value, p: Pred) -> Column:
    op, x = p.op, p.arg
    if op == "and":
        return all_of([_holds(v, q) for q in x])
    if op == "not":
        return ~_holds(v, x)
    if op == "never":
        return false()
    if op == "eq":
        if x is None:
            own = v.null_like()
            return own | v.any_element(lambda e: e.null_like()) if v.may_be_array() else own
        return _some(v, lambda e: e.equals(x))
    if op == "ne":
        return ~_holds(v, Pred("eq", x))
    if op == "in":
        return _some(v, lambda e: _member(e, x))
    if op == "nin":
        return ~_some(v, lambda e: _member(e, x))
    if op == "range":
        return all_of([_some(v, lambda e, o=o, b=b: e.compare(o, b)) for o, b in x])
    if op == "regex":
        pattern = translate_regex(*x)
        return _some(v, lambda e: e.search(pattern))
    if op == "exists":
        return v.present() if x else ~v.present()
    if op == "type":
        return v.is_type(x)
    if op == "document":
        within = v.any_element(lambda e: _object(e) & _filter(x, e)) if v.may_be_array() else false()
        return within if v.must_be_array() else within | v.deep_equals(x)
    if op == "list":
        return v.deep_equals(x) if v.may_be_array() else false()
    if op == "size":
        return v.size_is(x)
    if op == "all":
        parts = [v.any_element(lambda e, y=y: e.deep_equals(y)) for y in x]
        return all_of(parts) if parts else v.is_type("array")
    if op == "element":
        return v.any_element(lambda e: _element(e, x))
    raise AssertionError(op)


def _member(v: Value, operands: list) -> Column:
    if isinstance(v, Typed):
        usable = [y for y in map(v._operand, operands) if y is not None]
        return v._guard(v.c.isin(*usable)) if usable else false()
    return any_of([v.equals(y) for y in operands])


def _object(v: Value) -> Column:
    return v.is_type("object")


def _element(v: Value, body: Any) -> Column:
    """One element under an ``$elemMatch`` body: an object under its filter, anything else under its scalar reading."""
    scalar = element_scalar(body)
    sub_filter = isinstance(body, dict) and not any(k.startswith("$") and k not in LOGIC for k in body)
    as_object = _object(v) & _filter(body, v) if sub_filter else false()
    if isinstance(v, Typed):
        if v.kind == "object":
            return as_object if sub_filter else (false() if isinstance(body, dict) and {"$exists", "$type"} & set(body) else _holds(v, scalar))
        return _holds(v, scalar)
    return as_object | (~_object(v) & _holds(v, scalar)) if sub_filter else _holds(v, scalar)
