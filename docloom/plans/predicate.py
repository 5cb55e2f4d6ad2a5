"""The filter language: what is well formed, and the parsed form of a field's condition.

A filter is one object. Keys are ``$and``, ``$or``, ``$nor`` (lists of filters) or paths; several keys are all
required. A path's condition is a scalar, a list, a sub-document, or an object of operators.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

LOGIC = ("$and", "$or", "$nor")
RANGES = ("$gt", "$gte", "$lt", "$lte")
TYPES = ("string", "number", "bool", "object", "array", "null")
#: Operators by the payloads that may hold them.
VALUE_ONLY = frozenset(("$eq", "$ne", "$regex", "$options", *RANGES))
ARRAY_ONLY = frozenset(("$elemMatch", "$all", "$size"))
EITHER = frozenset(("$in", "$nin", "$not", "$exists", "$type"))
#: Operators that can match more rows as they widen; a type mismatch in them is never an error.
BROADENING = frozenset(("$ne", "$nin", "$not", "$exists", "$type"))


class FilterError(ValueError):
    """A filter that is not well formed."""


class _Undefined:
    """A condition that holds no value: it matches nothing."""

    def __repr__(self) -> str:
        return "UNDEFINED"


UNDEFINED = _Undefined()


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def is_scalar(x: Any) -> bool:
    return x is None or isinstance(x, (str, bool)) or is_number(x)


def bad_values(x: Any, path: str = "", _above: tuple = ()) -> Iterator[tuple[str, str]]:
    """Everything in ``x`` that JSON cannot hold: (path, what). Cycles are reported once."""
    if x is UNDEFINED:
        yield path, "undefined"
    elif isinstance(x, (dict, list)):
        if any(x is y for y in _above):
            yield path, "cycle"
            return
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            if isinstance(x, dict) and not isinstance(k, str):
                yield path, "key"
            else:
                yield from bad_values(v, f"{path}.{k}" if path else str(k), (*_above, x))
    elif is_number(x) and not math.isfinite(x):
        yield path, "non_finite"
    elif not is_scalar(x):
        yield path, "not_json"


def _data(x: Any) -> bool:
    return all(what == "non_finite" for _, what in bad_values(x))


def check_filter(f: Any, where: str = "filter") -> None:
    """Raise :class:`FilterError` unless ``f`` is well formed."""
    if not isinstance(f, dict):
        raise FilterError(f"{where} must be an object, got {type(f).__name__}")
    for key, value in f.items():
        if not isinstance(key, str):
            raise FilterError(f"{where}: keys must be text, got {key!r}")
        if key in LOGIC:
            if not isinstance(value, list):
                raise FilterError(f"{where}: {key} takes a list of filters")
            for i, sub in enumerate(value):
                check_filter(sub, f"{where}.{key}[{i}]")
        elif key.startswith("$"):
            raise FilterError(f"{where}: unknown operator {key}")
        else:
            check_condition(value, f"{where}.{key}")


def check_condition(c: Any, where: str) -> None:
    if c is UNDEFINED or is_scalar(c):
        return
    if isinstance(c, list):
        if not _data(c):
            raise FilterError(f"{where}: a list operand must be JSON")
        return
    if not isinstance(c, dict):
        raise FilterError(f"{where}: {type(c).__name__} is no condition")
    ops = [k for k in c if isinstance(k, str) and k.startswith("$")]
    if not ops or set(ops) <= set(LOGIC):
        check_filter(c, where)
    else:
        _check_payload(c, where)


def _check_payload(c: dict, where: str, negated: bool = False) -> None:
    for op, x in c.items():
        if op not in VALUE_ONLY | ARRAY_ONLY | EITHER:
            raise FilterError(f"{where}: unknown operator {op!r}")
        if x is UNDEFINED:
            raise FilterError(f"{where}: {op} has no operand")
        ok = {
            "$eq": lambda x: is_scalar(x),
            "$ne": lambda x: isinstance(x, str) or is_number(x),
            "$in": lambda x: isinstance(x, list) and all(v is not None and is_scalar(v) for v in x),
            "$nin": lambda x: isinstance(x, list) and all(v is not None and is_scalar(v) for v in x),
            "$exists": lambda x: isinstance(x, bool),
            "$type": lambda x: isinstance(x, str) and x in TYPES,
            "$regex": lambda x: isinstance(x, str),
            "$options": lambda x: isinstance(x, str),
            "$size": lambda x: is_number(x) and float(x).is_integer() and x >= 0,
            "$all": lambda x: isinstance(x, list) and _data(x),
        }.get(op)
        if op in RANGES and not (isinstance(x, str) or is_number(x)) or ok and not ok(x):
            raise FilterError(f"{where}: {op} cannot take {x!r}")
        if op == "$not":
            if not isinstance(x, dict) or not x or not all(isinstance(k, str) and k.startswith("$") for k in x):
                raise FilterError(f"{where}: $not takes operators")
            if set(x) != {"$size"} and set(x) & ARRAY_ONLY:
                raise FilterError(f"{where}: $not takes value operators or $size alone")
            _check_payload(x, f"{where}.$not", True)
        if op == "$elemMatch":
            if isinstance(x, dict):
                if any(k.startswith("$") and k not in LOGIC for k in x):
                    if set(x) & ARRAY_ONLY:
                        raise FilterError(f"{where}: $elemMatch cannot hold {sorted(set(x) & ARRAY_ONLY)}")
                    _check_payload(x, f"{where}.$elemMatch")
                else:
                    check_filter(x, f"{where}.$elemMatch")
            elif not is_scalar(x):
                raise FilterError(f"{where}: $elemMatch cannot take {x!r}")
    if not c:
        raise FilterError(f"{where}: no operator")
    if set(c) & VALUE_ONLY and set(c) & ARRAY_ONLY:
        raise FilterError(f"{where}: value operators and array operators cannot be mixed")
    if "$options" in c and "$regex" not in c:
        raise FilterError(f"{where}: $options needs $regex")
    if "$regex" in c:
        translate_regex(c["$regex"], c.get("$options", ""))


def is_filter(f: Any) -> bool:
    try:
        check_filter(f)
    except FilterError:
        return False
    return True


def is_logic_filter(f: Any) -> bool:
    """A filter with ``$and``, ``$or`` or ``$nor`` at its top."""
    return isinstance(f, dict) and any(isinstance(f.get(k), list) for k in LOGIC)


def is_partial_filter(f: Any) -> bool:
    """A filter of paths only."""
    return is_filter(f) and not is_logic_filter(f)


def is_filter_list(x: Any) -> bool:
    return isinstance(x, list) and all(map(is_filter, x))


def check_strict(f: Any) -> None:
    """A filter of paths only, all the way down: no logic in the filters on elements and sub-documents either."""
    check_filter(f)

    def logic(x: Any) -> bool:
        if isinstance(x, dict):
            return is_logic_filter(x) or any(logic(v) for v in x.values())
        return False

    if logic(f):
        raise FilterError("logic operators are not allowed here")


def translate_regex(pattern: str, options: str = "") -> str:
    """A pattern of the language as a Java one. ``$`` without ``m`` is the very end; ``i`` knows all letters."""
    if not set(options) <= set("imsguyvd") or len(set(options)) != len(options):
        raise FilterError(f"unknown regex options {options!r}")
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "d":
                out.append("0-9" if in_class else "[0-9]")
            elif n == "/":
                out.append("/")
            elif n == "u" and re.match(r"\{[0-9a-fA-F]+\}", pattern[i + 2 :]):
                m = re.match(r"\{([0-9a-fA-F]+)\}", pattern[i + 2 :])
                out.append(f"\\x{{{m[1]}}}")
                i += len(m[0])
            else:
                out.append(c + n)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c in "[&":
                c = "\\" + c
        elif c == "[":
            in_class = True
            if pattern.startswith("[^]", i):
                out.append("[\\s\\S]")
                i, in_class = i + 3, False
                continue
            if pattern.startswith("[]", i):
                out.append("(?!)")
                i, in_class = i + 2, False
                continue
        elif c == "$" and "m" not in options:
            c = "\\z"
        elif c == "(" and pattern.startswith("(?<", i) and pattern[i + 3 : i + 4] not in ("=", "!"):
            name = re.match(r"\(\?<([^>]*)>", pattern[i:])
            if not name:
                raise FilterError(f"bad pattern {pattern!r}")
        out.append(c)
        i += 1
    body = "".join(out)
    flags = ("iu" if "i" in options else "") + ("m" if "m" in options else "") + ("s" if "s" in options else "")
    body = f"(?{flags}){body}" if flags else body
    if "y" in options:
        body = f"\\A(?:{body})"
    try:
        re.compile(re.sub(r"\\z", r"\\Z", pattern.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!")))
    except re.error as e:
        if "unknown extension" not in str(e) and "bad escape" not in str(e) and "look-behind" not in str(e):
            raise FilterError(f"bad pattern {pattern!r}: {e}") from e
    return body


# The parsed form. One class for all: ``op`` names it, ``arg`` is its operand.


@dataclass(frozen=True)
class Pred:
    op: str
    arg: Any = None


def parse_condition(c: Any) -> Pred:
    """A well-formed condition as predicates; several operators are an ``and`` with the range bounds first."""
    if c is UNDEFINED:
        return Pred("never")
    if is_scalar(c):
        return Pred("eq", c)
    if isinstance(c, list):
        return Pred("list", c)
    if not any(k.startswith("$") for k in c):
        return Pred("document", c)
    if set(c) & set(LOGIC):
        return Pred("document", c)
    parts = []
    bounds = [(k, c[k]) for k in c if k in RANGES]
    if bounds:
        parts.append(Pred("range", tuple(bounds)))
    for k, x in c.items():
        if k == "$regex":
            parts.append(Pred("regex", (x, c.get("$options", ""))))
        elif k == "$not":
            parts.append(Pred("not", parse_condition(x)))
        elif k == "$elemMatch":
            parts.append(Pred("element", x))
        elif k not in RANGES and k != "$options":
            parts.append(Pred(k[1:], x))
    return parts[0] if len(parts) == 1 else Pred("and", tuple(parts))


def element_scalar(body: Any) -> Pred:
    """How an ``$elemMatch`` body reads an element that is no object; ``$exists`` and ``$type`` describe none."""
    if isinstance(body, dict) and ({"$exists", "$type"} & set(body) or not any(k.startswith("$") for k in body) or set(body) & set(LOGIC)):
        return Pred("never")
    return parse_condition(body)


def rebuild_condition(p: Pred) -> Any:
    """The condition that parses to ``p``."""
    if p.op == "never":
        return UNDEFINED
    if p.op in ("eq", "list", "document"):
        return p.arg if p.op != "eq" else {"$eq": p.arg}
    if p.op == "and":
        out: dict = {}
        for q in p.arg:
            out |= rebuild_condition(q)
        return out
    if p.op == "range":
        return dict(p.arg)
    if p.op == "regex":
        return {"$regex": p.arg[0]} | ({"$options": p.arg[1]} if p.arg[1] else {})
    if p.op == "not":
        inner = rebuild_condition(p.arg)
        return {"$not": inner}
    return {"$elemMatch" if p.op == "element" else f"${p.op}": p.arg}


def negated(p: Pred) -> Pred | None:
    """What a negation denies; None for a positive predicate."""
    return {"not": lambda: p.arg, "ne": lambda: Pred("eq", p.arg), "nin": lambda: Pred("in", p.arg)}.get(p.op, lambda: None)()


def split_negations(p: Pred) -> tuple[Pred | None, list[Pred]]:
    """The positive part, which one leaf must satisfy, and the negations, which speak of the whole path."""
    parts = list(p.arg) if p.op == "and" else [p]
    yes = [q for q in parts if negated(q) is None]
    no = [q for q in parts if negated(q) is not None]
    return (None if not yes else yes[0] if len(yes) == 1 else Pred("and", tuple(yes))), no
