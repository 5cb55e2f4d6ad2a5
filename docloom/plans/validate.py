"""What is wrong with a filter in the light of a schema: a conservative check that never refuses a filter that could match."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from docloom.functions.paths import kind_of, resolve
from docloom.plans.predicate import BROADENING, LOGIC, RANGES, FilterError, check_filter, is_number


@dataclass(frozen=True)
class Issue:
    path: str
    reason: str  # unknown_field, type_mismatch, non_finite, malformed
    message: str = ""


def zero_match_infinity(op: str, x: Any) -> bool:
    """Bounds that no finite number satisfies, and NaN."""
    if not isinstance(x, float) or math.isfinite(x):
        return False
    return math.isnan(x) or op in ("$eq", "$gt", "$gte") and x > 0 or op in ("$eq", "$lt", "$lte") and x < 0


def _kind_of_value(x: Any) -> str:
    return "bool" if isinstance(x, bool) else "number" if is_number(x) else "string" if isinstance(x, str) else "other"


def _non_finite(x: Any) -> bool:
    if isinstance(x, (list, tuple)):
        return any(map(_non_finite, x))
    if isinstance(x, dict):
        return any(map(_non_finite, x.values()))
    return isinstance(x, float) and not math.isfinite(x)


def validate_filter(f: Any, schema: T.StructType, strict: bool = True, json_only: bool = False) -> list[Issue]:
    """Issues of a filter; none under ``$or`` and ``$nor``, where a part that matches nothing is no fault."""
    try:
        check_filter(f)
    except FilterError as e:
        return [Issue("", "malformed", str(e))]
    out: list[Issue] = []

    def leaf(dtype: T.DataType) -> T.DataType:
        while isinstance(dtype, T.ArrayType):
            dtype = dtype.elementType
        return dtype

    def walk(g: dict, root: T.DataType, prefix: str, judged: bool) -> None:
        for key, c in g.items():
            if key in LOGIC:
                for sub in c:
                    walk(sub, root, prefix, judged and key == "$and")
                continue
            path = f"{prefix}.{key}" if prefix else key
            if json_only and _non_finite(c):
                out.append(Issue(path, "non_finite"))
            found = resolve(key, root)
            if not found.known:
                if judged and strict:
                    out.append(Issue(path, "unknown_field"))
                continue
            kind = kind_of(leaf(found.dtype))
            if not judged or kind in ("variant", "other", "time"):
                continue
            if isinstance(c, dict) and not any(k.startswith("$") for k in c):
                if isinstance(leaf(found.dtype), T.StructType):
                    walk(c, leaf(found.dtype), path, judged)
                continue
            payload = c if isinstance(c, dict) else {"$eq": c}
            for op, x in payload.items():
                if op in BROADENING:
                    continue
                if op in RANGES or op == "$eq":
                    if zero_match_infinity(op, x):
                        out.append(Issue(path, "non_finite"))
                    elif x is not None and not isinstance(x, (list, dict)) and _kind_of_value(x) != kind:
                        out.append(Issue(path, "type_mismatch", f"{op} {x!r} against {kind}"))
                elif op == "$in" and x and all(_kind_of_value(y) != kind for y in x):
                    out.append(Issue(path, "type_mismatch", f"$in against {kind}"))
                elif op == "$regex" and kind != "string":
                    out.append(Issue(path, "type_mismatch", f"$regex against {kind}"))
                elif op in ("$size", "$all", "$elemMatch") and not isinstance(found.dtype, T.ArrayType) and not found.arrays:
                    out.append(Issue(path, "type_mismatch", f"{op} against {kind}"))
                elif op == "$elemMatch" and isinstance(x, dict) and isinstance(leaf(found.dtype), T.StructType) and not any(k.startswith("$") and k not in LOGIC for k in x):
                    walk(x, leaf(found.dtype), path, judged)

    walk(f, schema, "", True)
    return list(dict.fromkeys(out))
