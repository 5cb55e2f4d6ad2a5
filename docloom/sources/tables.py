"""Described tables to query, and query clauses as SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import kind_of, parse_path
from docloom.operators.page import Slice, SortKey, query, resolved_sort
from docloom.plans.predicate import FilterError, Pred, check_filter, is_number, parse_condition, translate_regex


@dataclass(frozen=True)
class ObjectTable:
    """A table whose rows are documents: in a Variant column, or in JSON text that is parsed on reading.

    Text that is no JSON (or repeats a key) is a document that is missing; ``broken`` counts them.
    """

    df: DataFrame
    column: str
    primary_key: str
    sortable: dict[str, int | None] | None = None

    def documents(self) -> DataFrame:
        if isinstance(self.df.schema[self.column].dataType, T.VariantType):
            return self.df
        return self.df.withColumn(self.column, F.try_parse_json(F.col(f"`{self.column}`")))

    def broken(self) -> int:
        raw = self.df.where(F.col(f"`{self.column}`").isNotNull())
        return raw.where(F.try_parse_json(F.col(f"`{self.column}`")).isNull()).count()

    def query(self, f: dict | None = None, s: Slice = Slice(), where: Column | None = None) -> DataFrame:
        return query(self.documents(), f, s, self.primary_key, self.column, self.sortable, where)


@dataclass(frozen=True)
class ColumnTable:
    """A relational table: only the listed columns can be filtered and sorted by, and of those only the ``sortable`` ones
    can be sorted by, where they are given."""

    df: DataFrame
    primary_key: str
    columns: tuple[str, ...] = ()
    sortable: dict[str, int | None] | None = None

    def kinds(self) -> dict[str, str]:
        return {f.name: kind_of(f.dataType) for f in self.visible().schema.fields}

    def visible(self) -> DataFrame:
        return self.df.select(*self.columns) if self.columns else self.df

    def query(self, f: dict | None = None, s: Slice = Slice(), where: Column | None = None) -> DataFrame:
        return query(self.visible(), f, s, self.primary_key, sortable=self.sortable, where=where)


@dataclass
class Clauses:
    """Parts of a query as SQL text with numbered parameters ($1, $2, … in each part)."""

    where: str | None = None
    where_args: list = field(default_factory=list)
    order_by: str | None = None
    limit: int | None = None
    offset: int | None = None


def rebase(sql: str, by: int) -> str:
    """Parameters ``$n`` renumbered to ``$(n + by)``; text in quotes is left alone."""
    parts = re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")", sql)
    return "".join(p if i % 2 else re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + by}", p) for i, p in enumerate(parts))


def concat(*fragments: tuple[str, list]) -> tuple[str, list]:
    """Conditions joined by AND, each in parentheses, with one row of parameters."""
    out, args = [], []
    for sql, own in fragments:
        if sql:
            out.append(f"({rebase(sql, len(args))})")
            args += own
    return " AND ".join(out), args


def flatten(c: Clauses, dialect: str = "spark") -> tuple[str, list[Any] | dict[str, Any]]:
    """The tail of a statement: ``WHERE … ORDER BY … LIMIT … OFFSET …`` and its parameters.

    Spark and SQLite take ``?``; PostgreSQL keeps numbers; ``named`` is Spark's other form, ``:p1`` with a dictionary, which
    Spark 4.1 needs from five parameters on (it mixes up the order of more ``?``). SQLite has no OFFSET without a LIMIT.
    """
    out, args = [], list(c.where_args)
    if c.where:
        out.append(f"WHERE {c.where}")
    if c.order_by:
        out.append(f"ORDER BY {c.order_by}")
    limit = -1 if dialect == "sqlite" and c.limit is None and c.offset is not None else c.limit
    for word, n in (("LIMIT", limit), ("OFFSET", c.offset)):
        if n is not None:
            args.append(n)
            out.append(f"{word} ${len(args)}")
    text = " ".join(out)
    if dialect == "postgres":
        return text, args
    if dialect == "named":
        return re.sub(r"\$(\d+)", r":p\1", text), {f"p{i}": x for i, x in enumerate(args, 1)}
    order = [int(m) for m in re.findall(r"\$(\d+)", text)]
    return re.sub(r"\$\d+", "?", text), [args[n - 1] for n in order]


_QUOTES = {"spark": "`", "postgres": '"', "sqlite": '"'}
#: Not the words: Spark reads ``FROM t WHERE (FALSE)`` as a table alias with a list of columns.
_TRUE, _FALSE = "1 = 1", "1 = 0"


def filter_sql(f: dict, schema: T.StructType, dialect: str = "spark") -> tuple[str, list[Any]]:
    """A filter over scalar columns (and fields of structs) as a condition with numbered parameters.

    Every part is two-valued, as in the compiled filter. A path that crosses a list, a map or a Variant, and a pattern
    where the dialect has none, raise ``FilterError``: those need the compiled filter.
    """
    if dialect not in _QUOTES:
        raise FilterError(f"dialect_mismatch: {dialect!r}")
    check_filter(f)
    args: list[Any] = []
    quote = _QUOTES[dialect]

    def param(x: Any, dtype: T.DataType) -> str:
        args.append(x)
        return f"CAST(${len(args)} AS {dtype.simpleString()})" if kind_of(dtype) == "time" else f"${len(args)}"

    def fits(x: Any, kind: str) -> bool:
        return {"string": isinstance(x, str), "time": isinstance(x, str), "bool": isinstance(x, bool), "number": is_number(x) and x == x}.get(kind, False)

    def one(p: Pred, c: str, dtype: T.DataType) -> str:
        kind, op, x = kind_of(dtype), p.op, p.arg
        if op == "and":
            return " AND ".join(f"({one(q, c, dtype)})" for q in x) or _TRUE
        if op == "not":
            return f"NOT ({one(x, c, dtype)})"
        if op == "never":
            return _FALSE
        if op in ("ne", "nin"):
            return f"NOT ({one(Pred('eq' if op == 'ne' else 'in', x), c, dtype)})"
        if op == "eq":
            return f"{c} IS NULL" if x is None else f"{c} IS NOT NULL AND {c} = {param(x, dtype)}" if fits(x, kind) else _FALSE
        if op == "in":
            usable = [param(y, dtype) for y in x if fits(y, kind)]
            return f"{c} IS NOT NULL AND {c} IN ({', '.join(usable)})" if usable else _FALSE
        if op == "range":
            signs = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}
            return " AND ".join(f"{c} IS NOT NULL AND {c} {signs[o]} {param(b, dtype)}" if fits(b, kind) and kind != "bool" else _FALSE for o, b in x) or _TRUE
        if op == "exists":
            return f"{c} IS NOT NULL" if x else f"{c} IS NULL"
        if op == "type":
            return f"{c} IS NOT NULL" if x == kind else _FALSE
        if op == "regex" and dialect != "sqlite":
            if kind != "string":
                return _FALSE
            return f"{c} IS NOT NULL AND {c} {'RLIKE' if dialect == 'spark' else '~'} {param(translate_regex(*x), dtype)}"
        raise FilterError(f"dialect_mismatch: {op} has no text in {dialect}")

    def field_(key: str, c: Any) -> str:
        at: T.DataType = schema
        names = parse_path(key)
        for i, name in enumerate(names):
            if not isinstance(at, T.StructType) or i and isinstance(at, T.VariantType):
                raise FilterError(f"path_conversion: {key}")
            if name not in at.names:
                return one(parse_condition(c), "NULL", T.NullType())
            at = at[name].dataType
        if kind_of(at) not in ("string", "number", "bool", "time"):
            raise FilterError(f"path_conversion: {key}")
        return one(parse_condition(c), ".".join(f"{quote}{n.replace(quote, quote * 2)}{quote}" for n in names), at)

    def all_(g: dict) -> str:
        parts = []
        for key, c in g.items():
            if key == "$and":
                parts.append(" AND ".join(f"({all_(x)})" for x in c) or _TRUE)
            elif key in ("$or", "$nor"):
                some = " OR ".join(f"({all_(x)})" for x in c) or _FALSE
                parts.append(some if key == "$or" else f"NOT ({some})")
            else:
                parts.append(field_(key, c))
        return " AND ".join(f"({x})" for x in parts) or _TRUE

    return all_(f), args


def order_sql(sort: tuple[SortKey, ...], pk: str, dialect: str = "spark") -> str:
    """``ORDER BY`` text of a sort over columns, nulls last, with the primary key as tiebreak."""
    quote = _QUOTES[dialect]
    name = lambda k: ".".join(f"{quote}{n.replace(quote, quote * 2)}{quote}" for n in parse_path(k))
    return ", ".join(f"{name(k.key)} {'ASC' if k.direction == 1 else 'DESC'} NULLS LAST" for k in resolved_sort(sort, pk))
