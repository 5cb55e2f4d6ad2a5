"""Values a predicate is compiled against: typed columns, and Variant columns that carry their type.

Every method that returns a Boolean column returns a two-valued one (never null), so a negation above it is
exact. The guard is ``IS NOT NULL AND …``, which Spark still pushes into a Parquet scan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import DENIED, kind_of, variant_key
from docloom.plans.predicate import UNDEFINED, is_number


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]


def number_literal(x: Any) -> Column:
    """A number as a literal that compares exactly with integers: whole floats become integers."""
    if isinstance(x, int) and not -(2**63) <= x < 2**63:
        return F.lit(str(x)).cast("decimal(38,0)") if abs(x) < 10**38 else F.lit(float(x))
    if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
        return F.lit(int(x))
    return F.lit(x)


class Value:
    """What the compiler asks of a value."""

    def present(self) -> Column:
        raise NotImplementedError

    def key(self, name: str) -> Value:
        raise NotImplementedError

    def is_type(self, name: str) -> Column:
        raise NotImplementedError

    def null_like(self) -> Column:
        """Missing or null (the value itself, not an element)."""
        raise NotImplementedError

    def equals(self, x: Any) -> Column:
        """A scalar equal to ``x``, without coercion; false for arrays and structs."""
        raise NotImplementedError

    def compare(self, op: str, x: Any) -> Column:
        raise NotImplementedError

    def search(self, pattern: str) -> Column:
        raise NotImplementedError

    def any_element(self, test: Callable[[Value], Column]) -> Column:
        """Whether the value is an array with an element that passes."""
        raise NotImplementedError

    def size_is(self, n: int) -> Column:
        raise NotImplementedError

    def deep_equals(self, x: Any) -> Column:
        raise NotImplementedError

    def may_be_array(self) -> bool:
        raise NotImplementedError

    def must_be_array(self) -> bool:
        raise NotImplementedError


class Missing(Value):
    """A path that the schema does not hold."""

    def present(self):
        return false()

    def key(self, name):
        return self

    def is_type(self, name):
        return false()

    def null_like(self):
        return true()

    def equals(self, x):
        return false()

    def compare(self, op, x):
        return false()

    def search(self, pattern):
        return false()

    def any_element(self, test):
        return false()

    def size_is(self, n):
        return false()

    def deep_equals(self, x):
        return false()

    def may_be_array(self):
        return False

    def must_be_array(self):
        return False


_LITERAL = re.compile(r"(\^?)([^\\^$.|?*+()\[\]{}]+)")


def searched(text: Column, pattern: str) -> Column:
    """Whether the pattern is found. One that is plain text becomes a prefix or substring test, which the Parquet reader
    can use too."""
    plain = _LITERAL.fullmatch(pattern)
    if plain:
        return text.startswith(plain[2]) if plain[1] else text.contains(plain[2])
    return text.rlike(pattern)


class Typed(Value):
    """A column of a known type. SQL null is a missing value, or JSON null with ``nulls_are="null"``."""

    def __init__(self, column: Column, dtype: T.DataType, nulls_are: str = "missing") -> None:
        self.c, self.t, self.nulls_are = column, dtype, nulls_are
        self.kind = kind_of(dtype)

    def _guard(self, condition: Column) -> Column:
        return self.c.isNotNull() & condition

    def present(self):
        return true() if self.nulls_are == "null" else self.c.isNotNull()

    def key(self, name):
        if isinstance(self.t, T.MapType):
            return of(F.try_element_at(self.c, F.lit(name)), self.t.valueType, self.nulls_are)
        if isinstance(self.t, T.StructType) and name in self.t.names and name not in DENIED:
            return of(self.c.getField(name), self.t[name].dataType, self.nulls_are)
        return Missing()

    def is_type(self, name):
        if name == "null":
            return self.c.isNull() if self.nulls_are == "null" else false()
        return self.c.isNotNull() if name == self.kind else false()

    def null_like(self):
        return self.c.isNull()

    def _operand(self, x: Any) -> Column | None:
        """``x`` as a literal of the column's kind; None if it is of another kind."""
        if x is None or x is UNDEFINED or isinstance(x, (dict, list)):
            return None
        if self.kind == "bool" and isinstance(x, bool):
            return F.lit(x)
        if self.kind == "number" and is_number(x) and not (isinstance(x, float) and math.isnan(x)):
            return number_literal(x)
        if self.kind == "string" and isinstance(x, str):
            return F.lit(x)
        if self.kind == "time" and isinstance(x, str):
            return F.lit(x).cast(self.t)  # an extension: ISO text against a time column
        return None

    def equals(self, x):
        y = self._operand(x)
        return false() if y is None else self._guard(self.c == y)

    def compare(self, op, x):
        if isinstance(x, bool):
            return false()
        y = self._operand(x)
        if y is None:
            return false()
        out = self._guard(_ordered(op, self.c, y))
        if isinstance(self.t, (T.DoubleType, T.FloatType)) and op in ("$gt", "$gte"):
            out = out & ~F.isnan(self.c)  # Spark puts NaN above everything; here it is beyond no bound
        return out

    def search(self, pattern):
        return self._guard(searched(self.c, pattern)) if self.kind == "string" else false()

    def any_element(self, test):
        if not isinstance(self.t, T.ArrayType):
            return false()
        return self._guard(F.exists(self.c, lambda e: test(of(e, self.t.elementType, "null"))))

    def size_is(self, n):
        return self._guard(F.size(self.c) == int(n)) if self.kind == "array" else false()

    def deep_equals(self, x):
        if x is None:
            return self.c.isNull() if self.nulls_are == "null" else false()
        if isinstance(x, list):
            if not isinstance(self.t, T.ArrayType):
                return false()
            out = self._guard(F.size(self.c) == len(x))
            for i, y in enumerate(x):
                out = out & of(F.get(self.c, i), self.t.elementType, "null").deep_equals(y)
            return out
        if isinstance(x, dict):
            if isinstance(self.t, T.MapType):
                out = self._guard(F.size(self.c) == len(x))
            elif isinstance(self.t, T.StructType):
                if not set(x) <= set(self.t.names):
                    return false()
                out = self.c.isNotNull()
                for name in self.t.names:
                    if name not in x:
                        out = out & self.c.getField(name).isNull()
            else:
                return false()
            for k, y in x.items():
                inner = self.key(k)
                out = out & (inner.c.isNull() if y is None and isinstance(inner, Typed) else inner.deep_equals(y))
            return out
        if isinstance(x, float) and math.isnan(x):
            return self._guard(F.isnan(self.c)) if isinstance(self.t, (T.DoubleType, T.FloatType)) else false()
        return self.equals(x)

    def may_be_array(self):
        return self.kind == "array"

    must_be_array = may_be_array


class Variant(Value):
    """A Variant column: SQL null is missing, a Variant null is null, and kinds are read from the value."""

    def __init__(self, column: Column) -> None:
        self.c = column

    def present(self):
        return self.c.isNotNull()

    def key(self, name):
        return Variant(variant_key(self.c, name))

    def _schema(self) -> Column:
        return F.schema_of_variant(self.c)

    def is_type(self, name):
        s = self._schema()
        test = {
            "null": lambda: F.is_variant_null(self.c),
            "string": lambda: s == "STRING",
            "bool": lambda: s == "BOOLEAN",
            "array": lambda: s.startswith("ARRAY"),
            "object": lambda: s.startswith("OBJECT"),
            "number": lambda: s.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | s.startswith("DECIMAL"),
        }[name]()
        return self.c.isNotNull() & test

    def null_like(self):
        return self.c.isNull() | F.is_variant_null(self.c)

    def _as(self, x: Any) -> tuple[str, Column, Column] | None:
        """Kind, the value read as that kind, and the operand."""
        if isinstance(x, bool):
            return "bool", F.try_variant_get(self.c, "$", "boolean"), F.lit(x)
        if is_number(x) and not (isinstance(x, float) and math.isnan(x)):
            if isinstance(x, int) and abs(x) >= 2**53:
                return "number", F.try_variant_get(self.c, "$", "decimal(38,0)"), number_literal(x)
            return "number", F.try_variant_get(self.c, "$", "double"), F.lit(float(x))
        if isinstance(x, str):
            return "string", F.try_variant_get(self.c, "$", "string"), F.lit(x)
        return None

    def equals(self, x):
        found = self._as(x)
        if found is None:
            return false()
        kind, value, operand = found
        return self.is_type(kind) & value.isNotNull() & (value == operand)

    def compare(self, op, x):
        found = None if isinstance(x, bool) else self._as(x)
        if found is None:
            return false()
        kind, value, operand = found
        return self.is_type(kind) & value.isNotNull() & _ordered(op, value, operand)

    def search(self, pattern):
        value = F.try_variant_get(self.c, "$", "string")
        return self.is_type("string") & value.isNotNull() & searched(value, pattern)

    def _elements(self) -> Column:
        return F.try_variant_get(self.c, "$", "array<variant>")

    def any_element(self, test):
        elements = self._elements()
        return self.is_type("array") & elements.isNotNull() & F.exists(elements, lambda e: test(Variant(e)))

    def any_innermost(self, test):
        """Whether the value passes, or some element that is no array of the arrays in arrays that it is."""
        is_array = lambda e: Variant(e).is_type("array")
        spread = lambda e: F.when(is_array(e), F.coalesce(Variant(e)._elements(), F.array().cast("array<variant>"))).otherwise(F.array(e))
        # One step for every array in the text is enough; without an array left, the steps do nothing.
        steps = F.sequence(F.lit(1), F.regexp_count(F.to_json(self.c), F.lit(r"\[")))
        flat = lambda acc, _: F.when(F.exists(acc, is_array), F.flatten(F.transform(acc, spread))).otherwise(acc)
        inner = F.aggregate(steps, F.array(self.c), flat)
        return test(self) | (self.is_type("array") & F.exists(inner, lambda e: test(Variant(e))))

    def size_is(self, n):
        elements = self._elements()
        return self.is_type("array") & elements.isNotNull() & (F.size(elements) == int(n))

    def deep_equals(self, x):
        if x is None:
            return self.is_type("null")
        if isinstance(x, list):
            elements = self._elements()
            out = self.size_is(len(x))
            for i, y in enumerate(x):
                out = out & Variant(F.get(elements, i)).deep_equals(y)
            return out
        if isinstance(x, dict):
            members = F.try_variant_get(self.c, "$", "map<string,variant>")
            out = self.is_type("object") & members.isNotNull() & (F.size(members) == len(x))
            for k, y in x.items():
                out = out & Variant(F.try_element_at(members, F.lit(k))).deep_equals(y)
            return out
        return self.equals(x)

    def may_be_array(self):
        return True

    def must_be_array(self):
        return False


def of(column: Column, dtype: T.DataType, nulls_are: str = "missing") -> Value:
    return Variant(column) if isinstance(dtype, T.VariantType) else Typed(column, dtype, nulls_are)


class Root(Value):
    """A row: its keys are columns. With ``doc``, its keys are the members of that Variant or struct column."""

    def __init__(self, schema: T.StructType, doc: str | None = None, nulls_are: str = "missing") -> None:
        self.schema, self.doc, self.nulls_are = schema, doc, nulls_are

    def key(self, name):
        if self.doc is not None:
            return of(F.col(f"`{self.doc}`"), self.schema[self.doc].dataType, self.nulls_are).key(name)
        if name in self.schema.names and name not in DENIED:
            return of(F.col(f"`{name}`"), self.schema[name].dataType, self.nulls_are)
        return Missing()
