"""Sorting and paging: multi-key sorts with nulls last, limit and offset, and two keyset forms."""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import kind_of, parse_path, read, resolve
from docloom.plans.compiler import all_of, any_of, compile_filter
from docloom.plans.predicate import is_number
from docloom.plans.values import Variant

SAFE_INTEGER = 2**53 - 1


class PageError(ValueError):
    """A sort or slice that cannot be answered; ``errors`` lists everything wrong."""

    def __init__(self, errors: list[str]) -> None:
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class SortKey:
    key: str
    direction: int = 1


@dataclass(frozen=True)
class Boundary:
    """The encoded sort values and the primary key of a row; JSON-safe."""

    values: tuple
    pk: Any

    def cursor(self) -> str:
        return base64.urlsafe_b64encode(json.dumps([list(self.values), self.pk], ensure_ascii=False).encode()).decode()

    @staticmethod
    def parse(cursor: str) -> Boundary:
        values, pk = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return Boundary(tuple(values), pk)


@dataclass(frozen=True)
class Slice:
    sort: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int | None = None
    after_pk: Any = None
    after_boundary: Boundary | None = None
    errors: tuple[str, ...] = field(default=(), compare=False)


def check_slice(s: Slice) -> list[str]:
    out = []
    for name in ("limit", "offset"):
        n = getattr(s, name)
        if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0):
            out.append(f"{name} must be a whole number of at least 0")
    ways = [n for n in ("offset", "after_pk", "after_boundary") if getattr(s, n) is not None]
    if len(ways) > 1:
        out.append(f"{' and '.join(ways)} exclude each other")
    if (s.after_pk is not None or s.after_boundary is not None) and not s.sort:
        out.append("a keyset page needs a sort")
    if s.after_boundary is not None and len(s.after_boundary.values) != len(s.sort):
        out.append("the boundary must hold one value for each sort key")
    if any(k.direction not in (1, -1) for k in s.sort):
        out.append("a direction is 1 or -1")
    return out


def resolved_sort(sort: tuple[SortKey, ...], pk: str) -> tuple[SortKey, ...]:
    """The sort with the primary key, ascending, as the last tiebreak."""
    return sort if not sort or sort[-1].key == pk else (*sort, SortKey(pk))


def encode_value(v: Any) -> Any:
    """A sort value as JSON: null, a finite number, ``{"$bigint": text}`` or text. Encoding twice changes nothing."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return v if abs(v) <= SAFE_INTEGER else {"$bigint": str(v)}
    if isinstance(v, float):
        return v if math.isfinite(v) else "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    if isinstance(v, dict) and set(v) == {"$bigint"}:
        return v
    if isinstance(v, (dict, list)):
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return str(v)


def _decoded(v: Any) -> Any:
    return int(v["$bigint"]) if isinstance(v, dict) and set(v) == {"$bigint"} else v


def check_boundary_value(v: Any, dtype: T.DataType) -> str | None:
    """Why an encoded value cannot be compared with a column, or None."""
    kind, x = kind_of(dtype), _decoded(v)
    if x is None or kind == "variant":
        return None
    if kind == "string" and not isinstance(x, str):
        return "a text key takes text"
    if kind == "bool" and x not in ("true", "false") and not isinstance(x, bool):
        return "a Boolean key takes 'true' or 'false'"
    if kind == "number":
        if isinstance(x, str) and isinstance(dtype, (T.DoubleType, T.FloatType)) and x in ("NaN", "Infinity", "-Infinity"):
            return None
        if not is_number(x):
            return "a number key takes a number"
        if isinstance(dtype, T.IntegralType):
            if isinstance(x, float) and not x.is_integer():
                return None
            if not -(2**63) <= x < 2**63:
                return "the number is outside the range of the column"
    return None


def _parts(df: DataFrame, key: str, doc: str | None) -> tuple[list[Column], Any]:
    """The columns that order a key one after the other, and how a literal becomes their literals.

    A typed key is one column. Doubles that may not be finite take three: numbers come before what is ordered as text
    (Booleans, structs, infinities), then by number, then by text. Variants take a fourth, the whole number behind a
    double, which tells integers beyond 2 ** 53 apart.
    """
    segments = parse_path(key)
    if doc is not None:
        value = Variant(F.col(f"`{doc}`"))
        for s in segments:
            value = value.key(s)
        c = value.c
        is_null = c.isNull() | F.is_variant_null(c)
        number = F.when(value.is_type("number"), F.try_variant_get(c, "$", "double"))
        text = F.when(value.is_type("string"), F.try_variant_get(c, "$", "string")).when(~is_null & number.isNull(), F.to_json(c))
        bracket = F.when(~is_null, F.when(number.isNotNull(), 0).otherwise(1))
        exact = F.when(value.is_type("number"), F.try_variant_get(c, "$", "decimal(38,0)"))
        whole = F.when(F.abs(number) >= float(2**53), F.coalesce(exact, number.try_cast("decimal(38,0)")))
        return [bracket, number, F.when(number.isNotNull(), F.coalesce(whole, F.lit(0).cast("decimal(38,0)"))), text], _four
    found = resolve(key, df.schema)
    if not found.known:
        raise PageError([f"invalid_column: {key}"])
    if found.arrays or kind_of(found.dtype) in ("array", "object", "other"):
        raise PageError([f"invalid_column: {key} holds no value that can be sorted"])
    c = read(df, key)
    if isinstance(found.dtype, (T.DoubleType, T.FloatType)):
        finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        text = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity")
        return [F.when(c.isNotNull(), F.when(finite, 0).otherwise(1)), F.when(finite, c), text], _three
    cast = found.dtype
    return [c], lambda x: [None if x is None else F.lit(x if not isinstance(cast, T.BooleanType) or isinstance(x, bool) else x == "true").cast(cast if not (isinstance(x, float) and isinstance(cast, T.IntegralType)) else "double")]


def _three(x: Any) -> list:
    if x is None:
        return [None, None, None]
    if is_number(x):
        return [F.lit(0), F.lit(float(x)), None]
    return [F.lit(1), None, F.lit(encode_value(x))]


def _four(x: Any) -> list:
    bracket, number, text = _three(x)
    if number is None:
        return [bracket, None, None, text]
    return [bracket, number, F.lit(str(int(x)) if abs(x) >= 2**53 and abs(x) < 10**38 else "0").cast("decimal(38,0)"), None]


def order_columns(df: DataFrame, sort: tuple[SortKey, ...], doc: str | None = None) -> list[Column]:
    """``ORDER BY`` columns; nulls and missing values are last in both directions."""
    out = []
    for k in sort:
        parts, _ = _parts(df, k.key, doc)
        out += [c.asc_nulls_last() if k.direction == 1 else c.desc_nulls_last() for c in parts]
    return out


def after(df: DataFrame, sort: tuple[SortKey, ...], values: list, doc: str | None = None) -> Column:
    """Rows strictly after a row with these values: some key is beyond, all before it are equal."""
    same: list[Column] = []
    arms: list[Column] = []
    for k, v in zip(sort, values, strict=True):
        parts, literals = _parts(df, k.key, doc)
        for c, x in zip(parts, literals(_decoded(v)), strict=True):
            if x is None:
                same = [*same, c.isNull()]  # nothing comes after null
            else:
                beyond = (c > x) if k.direction == 1 else (c < x)
                arms.append(all_of([*same, (c.isNotNull() & beyond) | c.isNull()]))
                same = [*same, c.isNotNull() & (c == x)]
    return any_of(arms)


def boundary_of(df: DataFrame, row: Any, sort: tuple[SortKey, ...], pk: str) -> Boundary:
    """The boundary of a collected row (sort keys are read from it by path)."""

    def at(path: str) -> Any:
        v = row
        for s in parse_path(path):
            v = None if v is None else v[s]
        return v

    return Boundary(tuple(encode_value(at(k.key)) for k in sort), at(pk))


def sort_and_slice(df: DataFrame, s: Slice, pk: str, doc: str | None = None, sortable: dict[str, int | None] | None = None) -> DataFrame:
    """Sort, then the keyset, then offset, then limit. Rows of an unknown ``after_pk`` are an empty page.

    ``sortable``: the keys that may be sorted by, each with its only direction or None for both.
    """
    errors = check_slice(s)
    if sortable is not None:
        errors += [f"not sortable: {k.key}" for k in s.sort if k.key != pk and (k.key not in sortable or sortable[k.key] not in (None, k.direction))]
    if errors:
        raise PageError(errors)
    sort = resolved_sort(s.sort, pk)
    out = df
    if s.after_boundary is not None:
        values = [*s.after_boundary.values, *([s.after_boundary.pk] if len(sort) > len(s.sort) else [])]
        if doc is None:
            bad = [f"{k.key}: {why}" for k, v in zip(sort, values, strict=True) if (why := check_boundary_value(v, resolve(k.key, df.schema).dtype or T.StringType()))]
            if bad:
                raise PageError(bad)
        out = out.where(after(df, sort, values, doc))
    elif s.after_pk is not None:
        parts, columns = [], []
        for k in sort:
            p, _ = _parts(df, k.key, doc)
            parts.append(len(p))
            columns += p
        anchor_filter = {pk: s.after_pk}
        anchor = df.where(compile_filter(anchor_filter, df.schema, doc)).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).limit(1).collect()
        if not anchor:
            return df.limit(0)
        out = out.where(_after_parts(columns, [k.direction for k, n in zip(sort, parts, strict=True) for _ in range(n)], list(anchor[0])))
    if sort:
        out = out.orderBy(*order_columns(df, sort, doc))
    if s.offset:
        out = out.offset(s.offset)
    return out if s.limit is None else out.limit(s.limit)


def _after_parts(columns: list[Column], directions: list[int], values: list) -> Column:
    same: list[Column] = []
    arms: list[Column] = []
    for c, d, v in zip(columns, directions, values, strict=True):
        if v is None:
            same = [*same, c.isNull()]
        else:
            x = F.lit(v)
            arms.append(all_of([*same, (c.isNotNull() & ((c > x) if d == 1 else (c < x))) | c.isNull()]))
            same = [*same, c.isNotNull() & (c == x)]
    return any_of(arms)


def query(df: DataFrame, f: dict | None, s: Slice, pk: str, doc: str | None = None, sortable: dict[str, int | None] | None = None, where: Column | None = None) -> DataFrame:
    """Filter, sort and page a frame of typed columns, or of documents in the column ``doc``."""
    out = df if f is None else df.where(compile_filter(f, df.schema, doc))
    if where is not None:
        out = out.where(where)
    return sort_and_slice(out, s, pk, doc, sortable)
