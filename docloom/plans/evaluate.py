"""The language on plain Python values: verdicts at compile time, and the oracle of the tests."""

from __future__ import annotations

import math
import re
from typing import Any

from docloom.functions.paths import DENIED, parse_path
from docloom.plans.predicate import LOGIC, UNDEFINED, Pred, check_filter, element_scalar, is_number, negated, parse_condition, split_negations


def same_scalar(a: Any, b: Any) -> bool:
    """Equality without coercion: 1 is not True, NaN equals nothing."""
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if is_number(a) and is_number(b):
        return a == b
    return type(a) is type(b) and not isinstance(a, (dict, list)) and a is not UNDEFINED and a == b


def deep_equal(a: Any, b: Any) -> bool:
    """Equal documents: the order of keys is free, that of lists is not; NaN equals itself here."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(deep_equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    if is_number(a) and is_number(b) and math.isnan(a) and math.isnan(b):
        return True
    return same_scalar(a, b)


def type_name(v: Any) -> str | None:
    if v is UNDEFINED:
        return None
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if is_number(v):
        return "number"
    return {str: "string", list: "array", dict: "object"}.get(type(v))


def _compare(op: str, v: Any, bound: Any) -> bool:
    if not (is_number(v) and is_number(bound) or isinstance(v, str) and isinstance(bound, str)):
        return False
    return {"$gt": v > bound, "$gte": v >= bound, "$lt": v < bound, "$lte": v <= bound}[op]


_CLASSES = {"d": "0-9", "w": "A-Za-z0-9_", "s": " \\t\\n\\x0b\\f\\r"}


def _plain_classes(pattern: str) -> str:
    """``\\d``, ``\\w`` and ``\\s`` spelled out, since Python's take letters, digits and spaces of all scripts."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n in _CLASSES:
                out.append(_CLASSES[n] if in_class else f"[{_CLASSES[n]}]")
            elif n.lower() in _CLASSES and not in_class:
                out.append(f"[^{_CLASSES[n.lower()]}]")
            else:
                out.append(c + n)
            i += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


def _search(pattern: str, options: str, text: str) -> bool:
    pattern = _plain_classes(pattern)
    flags = (re.I if "i" in options else 0) | (re.M if "m" in options else 0) | (re.S if "s" in options else 0)
    if "m" not in options:
        pattern = re.sub(r"(?<!\\)\$(?![^\[]*\])", r"\\Z", pattern)
    found = re.compile(pattern, flags)
    return bool((found.match if "y" in options else found.search)(text))


def holds(v: Any, p: Pred) -> bool:
    """Whether the value satisfies the predicate; UNDEFINED is a missing field."""
    some = lambda test: any(map(test, v)) if isinstance(v, list) else test(v)
    if p.op == "and":
        return all(holds(v, q) for q in p.arg)
    if p.op == "not":
        return not holds(v, p.arg)
    if p.op == "never":
        return False
    if p.op == "eq":
        return some(lambda x: x is None or x is UNDEFINED) if p.arg is None else some(lambda x: same_scalar(x, p.arg))
    if p.op == "ne":
        return not holds(v, Pred("eq", p.arg))
    if p.op == "in":
        return some(lambda x: any(same_scalar(x, y) for y in p.arg))
    if p.op == "nin":
        return not holds(v, Pred("in", p.arg))
    if p.op == "range":
        return all(some(lambda x, op=op, b=b: _compare(op, x, b)) for op, b in p.arg)
    if p.op == "regex":
        return some(lambda x: isinstance(x, str) and _search(*p.arg, x))
    if p.op == "exists":
        return (v is not UNDEFINED) == p.arg
    if p.op == "type":
        return type_name(v) == p.arg
    if p.op == "document":
        return any(isinstance(x, dict) and match(x, p.arg) for x in v) if isinstance(v, list) else deep_equal(v, p.arg)
    if not isinstance(v, list):
        return False
    if p.op == "list":
        return deep_equal(v, p.arg)
    if p.op == "size":
        return len(v) == p.arg
    if p.op == "all":
        return all(any(deep_equal(x, y) for x in v) for y in p.arg)
    if p.op == "element":
        scalar = element_scalar(p.arg)
        return any(match(x, p.arg) if isinstance(x, dict) and isinstance(p.arg, dict) and not _payload(p.arg) else holds(x, scalar) for x in v)
    raise AssertionError(p.op)


def _payload(body: dict) -> bool:
    return any(k.startswith("$") and k not in LOGIC for k in body)


def matches_missing(p: Pred) -> bool:
    """The predicate's verdict on a field that is not there."""
    return holds(UNDEFINED, p)


def _direct(doc: Any, segments: list[str]) -> Any:
    for s in segments:
        if not isinstance(doc, dict) or s in DENIED or s not in doc:
            return UNDEFINED
        doc = doc[s]
    return doc


def _spread(doc: Any, segments: list[str]) -> list:
    if not segments:
        return [] if doc is UNDEFINED else [doc]
    if isinstance(doc, list):
        return [x for e in doc for x in _spread(e, segments)]
    if not isinstance(doc, dict) or segments[0] in DENIED or segments[0] not in doc:
        return []
    return _spread(doc[segments[0]], segments[1:])


def _over(found: list, p: Pred) -> bool:
    core = negated(p)
    if core is not None:
        return not _over(found, core)
    yes, no = split_negations(p)
    return (yes is None or any(holds(x, yes) for x in found)) and all(_over(found, q) for q in no)


def match(doc: dict, f: dict) -> bool:
    """Whether a document matches a filter that is well formed."""
    for key, c in f.items():
        if key in LOGIC and isinstance(c, list):
            hits = (match(doc, sub) for sub in c)
            ok = {"$and": all, "$or": any, "$nor": lambda x: not any(x)}[key](hits)
        else:
            p, segments = parse_condition(c), parse_path(key)
            v = _direct(doc, segments)
            found = _spread(doc, segments) if v is UNDEFINED else []
            ok = _over(found, p) if found else holds(v, p)
        if not ok:
            return False
    return True


def matches(doc: dict, f: dict) -> bool:
    check_filter(f)
    if not isinstance(doc, dict):
        raise TypeError("only plain documents can be matched")
    return match(doc, f)
