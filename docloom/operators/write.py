"""Ordered batches of write actions over a keyed frame.

A batch becomes one chain of projections: every action contributes a match and a new value of the row, deletions and
creations are flags, and one aggregation tells which action, if any, fails. Nothing is looped over row by row.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import join_path, kind_of, parse_path, resolve
from docloom.functions.schema import unsafe_fields
from docloom.plans.compiler import _filter, any_of
from docloom.plans.evaluate import deep_equal
from docloom.plans.predicate import bad_values, is_filter, is_number
from docloom.plans.validate import validate_filter
from docloom.plans.values import Root, Typed, false, of, true

VERBS = ("create", "update", "delete", "array_scope", "add_to_set", "push", "pull", "inc", "set_property_undefined", "delete_property")
#: Failures that a retry could heal.
RECOVERABLE = frozenset(("custom", "blocked"))


@dataclass(frozen=True)
class ListRules:
    primary_key: str
    default_ordering_key: str | None = None
    sortable_keys: dict[str, int | None] | None = None


@dataclass(frozen=True)
class Ddl:
    """Rules of the root list ``"."`` and of every nested list of structs, by its path."""

    lists: dict[str, ListRules]
    version: int = 1

    def rules(self, scope: str = "") -> ListRules | None:
        return self.lists.get(scope or ".")


@dataclass(frozen=True)
class WriteAction:
    payload: dict
    uuid: str
    ts: int = 0
    type: str = "write"


@dataclass(frozen=True)
class Outcome:
    action: WriteAction
    ok: bool
    error: dict | None = None
    affected: int = 0

    @property
    def unrecoverable(self) -> bool:
        return not self.ok and self.error["type"] not in RECOVERABLE


@dataclass
class Changes:
    insert: DataFrame
    update: DataFrame
    remove_keys: DataFrame
    final_items: DataFrame
    changed: bool


@dataclass
class WriteResult:
    ok: bool
    actions: list[Outcome]
    changes: Changes
    error: str | None = None


@dataclass(frozen=True)
class Options:
    #: Any failure leaves everything as it was.
    atomic: bool = False
    #: For a create whose key exists: never, if-convergent or always-update.
    duplicate_create: str = "never"
    strict: bool = True


def failures(r: WriteResult) -> list[Outcome]:
    return [o for o in r.actions if not o.ok]


def successes(r: WriteResult) -> list[Outcome]:
    return [o for o in r.actions if o.ok]


def errors(r: WriteResult) -> list[dict]:
    return [o.error for o in failures(r)]


# Literals and static checks.


def fits(x: Any, dtype: T.DataType) -> bool:
    """Whether a JSON value can be stored in a column of the type."""
    if x is None:
        return True
    if isinstance(dtype, T.VariantType):
        return True
    if isinstance(dtype, T.ArrayType):
        return isinstance(x, list) and all(fits(y, dtype.elementType) for y in x)
    if isinstance(dtype, T.MapType):
        return isinstance(x, dict) and all(fits(y, dtype.valueType) for y in x.values())
    if isinstance(dtype, T.StructType):
        return isinstance(x, dict) and set(x) <= set(dtype.names) and all(fits(y, dtype[k].dataType) for k, y in x.items())
    if isinstance(dtype, T.IntegralType):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(dtype), 63)
        return is_number(x) and float(x).is_integer() and -(2**bits) <= x < 2**bits
    return {"string": isinstance(x, str), "number": is_number(x), "bool": isinstance(x, bool), "time": isinstance(x, str)}.get(kind_of(dtype), False)


def literal(x: Any, dtype: T.DataType) -> Column:
    if x is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.VariantType):
        return F.parse_json(F.lit(json.dumps(x)))
    if isinstance(dtype, T.ArrayType):
        return (F.array(*[literal(y, dtype.elementType) for y in x]) if x else F.array()).cast(dtype)
    if isinstance(dtype, T.MapType):
        return (F.create_map(*[c for k, y in x.items() for c in (F.lit(k), literal(y, dtype.valueType))]) if x else F.create_map()).cast(dtype)
    if isinstance(dtype, T.StructType):
        return F.struct(*[literal(x.get(f.name), f.dataType).alias(f.name) for f in dtype.fields])
    return F.lit(x).cast(dtype)


def _merged(c: Column, dtype: T.DataType, data: dict) -> Column:
    """Deep merge of ``data`` into a struct or map: lists are replaced whole, null is stored, missing parents are built."""
    if isinstance(dtype, T.MapType):
        keep = F.map_filter(F.coalesce(c, F.create_map().cast(dtype)), lambda k, v: ~k.isin(list(data)))
        new = {k: _merged(F.try_element_at(c, F.lit(k)), dtype.valueType, v) if isinstance(v, dict) and isinstance(dtype.valueType, (T.StructType, T.MapType)) else literal(v, dtype.valueType) for k, v in data.items()}
        return F.map_concat(keep, F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]).cast(dtype)) if new else keep
    fields = []
    for f in dtype.fields:
        old = c.getField(f.name)
        if f.name not in data:
            fields.append(old.alias(f.name))
        elif isinstance(data[f.name], dict) and isinstance(f.dataType, (T.StructType, T.MapType)):
            fields.append(_merged(old, f.dataType, data[f.name]).alias(f.name))
        else:
            fields.append(literal(data[f.name], f.dataType).alias(f.name))
    return F.struct(*fields)


def _replaced(c: Column, dtype: T.StructType, name: str, value: Column) -> Column:
    return F.struct(*[(value.cast(f.dataType) if f.name == name else c.getField(f.name)).alias(f.name) for f in dtype.fields])


def _cleared(c: Column, dtype: T.DataType, segments: list[str]) -> Column:
    """The member at a path taken away; what is not there stays as it is."""
    if isinstance(dtype, T.MapType):
        if len(segments) == 1:
            return F.map_filter(c, lambda k, v: k != segments[0])
        return F.transform_values(c, lambda k, v: F.when(k == segments[0], _cleared(v, dtype.valueType, segments[1:])).otherwise(v))
    inner = dtype[segments[0]].dataType
    value = F.lit(None) if len(segments) == 1 else _cleared(c.getField(segments[0]), inner, segments[1:])
    return F.when(c.isNull(), c).otherwise(_replaced(c, dtype, segments[0], value))


def _there(c: Column, dtype: T.DataType, segments: list[str]) -> Column:
    """Whether there is a value at a path."""
    for i, name in enumerate(segments):
        if isinstance(dtype, T.MapType):
            if i == len(segments) - 1:
                return F.coalesce(F.map_contains_key(c, name), F.lit(False))
            c, dtype = F.try_element_at(c, F.lit(name)), dtype.valueType
        else:
            c, dtype = c.getField(name), dtype[name].dataType
    return c.isNotNull()


def _key_ok(x: Any) -> bool:
    """A usable primary key: text or number, and neither empty nor zero."""
    return not isinstance(x, bool) and isinstance(x, (str, int, float)) and bool(x)


def resolve_scope(schema: T.StructType, scope: str) -> tuple[T.StructType | None, str | None]:
    """The object that a nested list holds, or why the scope cannot be written through."""
    if any(s in ("__proto__", "prototype", "constructor") for s in parse_path(scope)):
        return None, "disallowed_segment"
    found = resolve(scope, schema)
    if not found.known:
        return None, "unknown_path"
    if not isinstance(found.dtype, T.ArrayType) or not isinstance(found.dtype.elementType, T.StructType):
        return None, "not_an_object_array"
    return found.dtype.elementType, None


def property_problem(schema: T.StructType, path: str, pk: str) -> str | None:
    """Why a property cannot be taken away, or None."""
    segments = parse_path(path)
    if any(s in ("__proto__", "prototype", "constructor", "") for s in segments):
        return "disallowed_segment"
    if segments[0] == pk:
        return "primary_key"
    at: T.DataType = schema
    for i, s in enumerate(segments):
        if isinstance(at, T.ArrayType):
            return "crosses_array"
        if isinstance(at, T.MapType):
            at = at.valueType
        elif isinstance(at, T.StructType) and s in at.names:
            if i == len(segments) - 1 and not at[s].nullable:
                return "required"
            at = at[s].dataType
        else:
            return "unknown_path"
    return None


def static_errors(payload: dict, schema: T.StructType, ddl: Ddl, scope: str = "", strict: bool = True) -> list[dict]:
    """Everything wrong with a payload that needs no data to see."""
    verb = payload.get("type")
    if verb not in VERBS:
        return [{"type": "custom", "message": f"unknown verb {verb!r}"}]
    rules = ddl.rules(scope)
    if rules is None:
        return [{"type": "custom", "message": f"no rules for the list {scope!r}"}]
    out: list[dict] = [] if scope else [{"type": "custom", "message": f"JSON cannot carry {path} ({what})"} for path, what in unsafe_fields(schema)]
    data = {"create": payload.get("data"), "update": payload.get("data"), "push": payload.get("items"), "add_to_set": payload.get("items"), "inc": payload.get("amount")}.get(verb)
    for path, what in bad_values(data):
        out.append({"type": "invalid_data_value", "data_path": path, "reason": "non_finite" if what == "non_finite" else "malformed"})
    if verb != "create":
        for i in validate_filter(payload.get("where"), schema, strict, json_only=True):
            out.append({"type": "invalid_filter", "where_path": i.path, "reason": i.reason})
    if verb in ("create", "update"):
        if not isinstance(data, dict):
            out.append({"type": "invalid_data_value", "data_path": "", "reason": "malformed"})
        elif verb == "create" and not _key_ok(data.get(rules.primary_key)):
            out.append({"type": "missing_key", "primary_key": rules.primary_key})
        elif not out and not fits(data, schema):
            out.append({"type": "schema", "issues": [k for k, v in data.items() if k not in schema.names or not fits(v, schema[k].dataType)]})
    elif verb in ("add_to_set", "push", "pull", "inc"):
        path = payload.get("path")
        dtype = schema[path].dataType if isinstance(path, str) and path in schema.names else None
        if verb == "inc":
            if path == rules.primary_key:
                out.append({"type": "invalid_property_path", "path": path, "reason": "primary_key"})
            elif not isinstance(dtype, T.NumericType) or not is_number(payload.get("amount")):
                out.append({"type": "custom", "message": f"{path} is no number"})
            elif not fits(payload["amount"], dtype):
                out.append({"type": "schema", "issues": [path]})
        elif not isinstance(dtype, T.ArrayType):
            out.append({"type": "custom", "message": f"{path} is no list"})
        elif verb == "pull":
            w = payload.get("items_where")
            if isinstance(w, dict):
                if not is_filter(w):
                    out.append({"type": "invalid_filter", "where_path": path, "reason": "malformed"})
            elif not isinstance(w, list):
                out.append({"type": "invalid_filter", "where_path": path, "reason": "malformed"})
        elif not isinstance(payload.get("items"), list) or not all(fits(x, dtype.elementType) for x in payload["items"]):
            out.append({"type": "schema", "issues": [path]})
        elif verb == "add_to_set" and payload.get("unique_by", "deep_equals") == "pk":
            nested = ddl.rules(join_scope(scope, path))
            if nested is None or not isinstance(dtype.elementType, T.StructType) or not all(isinstance(x, dict) and _key_ok(x.get(nested.primary_key)) for x in payload["items"]):
                out.append({"type": "custom", "message": f"the elements of {path} have no primary key"})
    elif verb in ("set_property_undefined", "delete_property"):
        why = property_problem(schema, payload.get("path", ""), rules.primary_key)
        if why:
            out.append({"type": "invalid_property_path", "path": payload.get("path", ""), "reason": why})
    elif verb == "array_scope":
        inner, why = resolve_scope(schema, payload.get("scope", ""))
        if why:
            out.append({"type": "invalid_scope", "scope": payload.get("scope", ""), "reason": why})
        else:
            out += static_errors(payload.get("action") or {}, inner, ddl, join_scope(scope, payload["scope"]), strict)
    return out


def join_scope(scope: str, path: str) -> str:
    return f"{scope}.{path}" if scope else path


def validate_action(action: WriteAction, schema: T.StructType, ddl: Ddl) -> list[dict]:
    return static_errors(action.payload, schema, ddl)


# One payload on one struct: its new value, whether the write breaks a rule there, and whether it changes anything.


def _applied(c: Column, dtype: T.StructType, payload: dict, ddl: Ddl, scope: str) -> tuple[Column, Column | None, Column]:
    verb, rules = payload["type"], ddl.rules(scope)
    if verb == "update":
        data = payload["data"]
        bad = ~of(c.getField(rules.primary_key), dtype[rules.primary_key].dataType).equals(data[rules.primary_key]) if rules.primary_key in data else None
        if payload.get("method", "merge") == "assign":
            new = F.struct(*[(literal(data[f.name], f.dataType) if f.name in data else c.getField(f.name)).alias(f.name) for f in dtype.fields])
        else:
            new = _merged(c, dtype, data)
        return new, bad, true()
    if verb in ("add_to_set", "push", "pull", "inc"):
        path = payload["path"]
        t, old = dtype[path].dataType, c.getField(path)
        if verb == "inc":
            amount = payload["amount"]
            new = old if amount == 0 else F.coalesce(old, F.lit(0).cast(t)) + F.lit(amount).cast(t)
            return _replaced(c, dtype, path, new), None, F.lit(amount != 0)
        if verb == "push":
            items = payload["items"]
            return _replaced(c, dtype, path, F.concat(F.coalesce(old, F.array().cast(t)), literal(items, t)) if items else old), None, F.lit(bool(items))
        if verb == "pull":
            w = payload["items_where"]
            kept = F.filter(old, lambda e: ~_pulled(Typed(e, t.elementType), w))
            return _replaced(c, dtype, path, kept), None, old.isNotNull() & (F.size(kept) != F.size(old))
        by_key = payload.get("unique_by", "deep_equals") == "pk"
        key = ddl.rules(join_scope(scope, path)).primary_key if by_key else None
        items: list = []
        for x in payload["items"]:
            if not any((x[key] == y[key]) if by_key else deep_equal(x, y) for y in items):
                items.append(x)
        base = F.coalesce(old, F.array().cast(t))

        def known(x: Any) -> Column:
            def same(e: Column) -> Column:
                v = of(e, t.elementType, "null")
                return v.key(key).equals(x[key]) if by_key else v.deep_equals(x)

            return F.exists(base, same)

        fresh = [F.when(~known(x), literal([x], t)).otherwise(F.array().cast(t)) for x in items]
        new = F.concat(base, *fresh) if fresh else old
        return _replaced(c, dtype, path, new), None, F.size(new) != F.size(base) if fresh else false()
    if verb in ("set_property_undefined", "delete_property"):
        segments = parse_path(payload["path"])
        return _cleared(c, dtype, segments), None, _there(c, dtype, segments)
    if verb == "array_scope":
        new, bad = _scoped(c, dtype, parse_path(payload["scope"]), payload["action"], ddl, join_scope(scope, payload["scope"]))
        return new, bad, true()
    raise AssertionError(verb)


def _pulled(e: Typed, w: dict | list) -> Column:
    if isinstance(w, list):
        return any_of([e.deep_equals(x) if x is not None else e.c.isNull() for x in w])
    return e.is_type("object") & _filter(w, e) if e.kind == "object" else false()


def _can_break(action: dict, ddl: Ddl, scope: str) -> bool:
    """Whether an action can break a rule of its list on some row; most cannot, and then nothing is tested."""
    if action["type"] == "array_scope":
        inner = join_scope(scope, action["scope"])
        return action["action"]["type"] == "create" or _can_break(action["action"], ddl, inner)
    return action["type"] == "update" and ddl.rules(scope).primary_key in action["data"]


def _scoped(c: Column, dtype: T.DataType, segments: list[str], action: dict, ddl: Ddl, scope: str) -> tuple[Column, Column | None]:
    """An action on the nested list at a path, which may cross lists."""
    if isinstance(dtype, T.ArrayType):
        if segments:
            inner = lambda e: _scoped(e, dtype.elementType, segments, action, ddl, scope)
            breaks = action["type"] == "create" or _can_break(action, ddl, scope)
            return F.transform(c, lambda e: inner(e)[0]), c.isNotNull() & F.exists(c, lambda e: inner(e)[1]) if breaks else None
        return _on_list(c, dtype, action, ddl, scope)
    new, bad = _scoped(c.getField(segments[0]), dtype[segments[0]].dataType, segments[1:], action, ddl, scope)
    return F.when(c.isNull(), c).otherwise(_replaced(c, dtype, segments[0], new)), bad


def _on_list(c: Column, dtype: T.ArrayType, action: dict, ddl: Ddl, scope: str) -> tuple[Column, Column | None]:
    t, rules = dtype.elementType, ddl.rules(scope)
    if action["type"] == "create":
        same = lambda e: Typed(e, t).key(rules.primary_key).equals(action["data"][rules.primary_key])
        return F.when(c.isNull(), c).otherwise(F.concat(c, literal([action["data"]], dtype))), c.isNotNull() & F.exists(c, same)
    hit = lambda e: _filter(action["where"], Typed(e, t))
    if action["type"] == "delete":
        return F.filter(c, lambda e: ~hit(e)), None
    new = F.transform(c, lambda e: F.when(hit(e), _applied(e, t, action, ddl, scope)[0]).otherwise(e))
    if not _can_break(action, ddl, scope):
        return new, None
    return new, c.isNotNull() & F.exists(c, lambda e: hit(e) & _applied(e, t, action, ddl, scope)[1])


# Batches.


def _failure_type(payload: dict) -> str:
    while payload["type"] == "array_scope":
        payload = payload["action"]
    return {"create": "create_duplicated_key", "update": "update_altered_key"}.get(payload["type"], "schema")


@dataclass
class _Plan:
    frame: DataFrame
    actions: list[WriteAction]
    schema: T.StructType
    pk: str
    #: What is counted: matches ``m``, broken rules ``f``, failed checks ``s``, each with the action's number.
    flags: list[str]


def _chain(items: DataFrame, actions: list[WriteAction], ddl: Ddl, check) -> _Plan:
    schema, pk = items.schema, ddl.rules().primary_key
    row = F.struct(*[F.col(f"`{c}`") for c in items.columns])
    frame = items.select(row.alias("row"), F.lit(-1).alias("born"), F.lit(False).alias("gone"), F.lit(False).alias("touched"))
    for i, a in enumerate(actions):
        if a.payload["type"] == "create":
            new = items.sparkSession.range(1).select(literal(a.payload["data"], schema).alias("row"), F.lit(i).alias("born"), F.lit(False).alias("gone"), F.lit(False).alias("touched"))
            frame = frame.unionByName(new)
    flags: list[str] = []

    def flagged(frame: DataFrame, name: str, value: Column | None) -> DataFrame:
        if value is None:  # cannot happen: nothing to count
            return frame
        flags.append(name)
        return frame.withColumn(name, value)

    for i, a in enumerate(actions):
        p, verb = a.payload, a.payload["type"]
        alive = (F.col("born") < i) & ~F.col("gone")
        value = Typed(F.col("row"), schema)
        if verb == "create":
            own = F.col("born") == i
            frame = flagged(frame, f"m{i}", own)
            frame = flagged(frame, f"f{i}", alive & value.key(pk).equals(p["data"][pk]))
            frame = flagged(frame, f"s{i}", own & ~check(F.col("row")) if check else None)
            continue
        frame = flagged(frame, f"m{i}", alive & _filter(p["where"], value))
        m = F.col(f"m{i}")
        if verb == "delete":
            frame = frame.withColumn("gone", F.col("gone") | m)
            continue
        new, bad, changed = _applied(F.col("row"), schema, p, ddl, "")
        frame = frame.withColumn("next", F.when(m, new).otherwise(F.col("row"))).withColumn("changes", m & changed)
        frame = flagged(frame, f"f{i}", None if bad is None else m & bad)
        frame = flagged(frame, f"s{i}", m & ~check(F.col("next")) if check else None)
        frame = frame.withColumn("touched", F.col("touched") | F.col("changes")).withColumn("row", F.col("next")).drop("next", "changes")
    return _Plan(frame, actions, schema, pk, flags)


def write(actions: list[WriteAction], items: DataFrame, ddl: Ddl, options: Options = Options(), check=None) -> WriteResult:
    """Apply a batch. The first action that fails halts it; later ones are blocked by it.

    Failing actions change nothing. Without ``atomic`` the actions before the failure count; with it none do.
    ``check`` maps the row (a struct column) to whether it is valid. An action that matches nothing succeeds without
    an outcome. Actions repeated under one uuid count once; a uuid with two payloads refuses the batch.
    """
    schema, pk = items.schema, ddl.rules().primary_key
    unique: dict[str, WriteAction] = {}
    for a in actions:
        if a.uuid in unique and unique[a.uuid].payload != a.payload:
            error = {"type": "uuid_conflict", "uuid": a.uuid}
            others = {b.uuid: b for b in reversed(actions) if b.uuid != a.uuid}
            return _result(items, pk, None, [], [Outcome(a, False, error)] + [Outcome(b, False, {"type": "blocked", "blocked_by_action_uuid": a.uuid}) for b in reversed(others.values())])
        unique.setdefault(a.uuid, a)
    batch = list(unique.values())
    if not batch:
        return _result(items, pk, None, [], [])
    static = {i: e[0] for i, a in enumerate(batch) if (e := static_errors(a.payload, schema, ddl, strict=options.strict))}
    ready = batch[: min(static, default=len(batch))]
    while True:
        plan = _chain(items, ready, ddl, check)
        key = Typed(F.col("row"), schema).key(pk)
        blank = any_of([key.null_like(), key.equals(""), key.equals(0)])
        counts = [F.coalesce(F.count_if(F.col(c)), F.lit(0)).alias(c) for c in plan.flags]
        seen = defaultdict(int, plan.frame.agg(F.count_if((F.col("born") < 0) & blank).alias("blank"), *counts).first().asDict())
        if seen["blank"]:
            return _failed(items, pk, None, batch, 0, {"type": "missing_key", "primary_key": pk}, {}, options)
        taken = [i for i, a in enumerate(ready) if a.payload["type"] == "create" and seen[f"f{i}"]]
        rewritten = False
        if taken and options.duplicate_create != "never":
            first_bad = next((i for i in range(len(ready)) if seen[f"s{i}"] or seen[f"f{i}"] and i not in taken), len(ready))
            for i in [i for i in taken if i <= first_bad]:
                a = ready[i]
                if options.duplicate_create == "always-update":
                    data = {k: v for k, v in a.payload["data"].items() if k != pk}
                    ready[i] = WriteAction({"type": "update", "data": data, "where": {pk: a.payload["data"][pk]}}, a.uuid, a.ts)
                    rewritten = True
                elif _converges(items, ready, i, ddl, pk):
                    ready[i] = WriteAction({"type": "update", "data": {}, "where": {"$or": []}}, a.uuid, a.ts)
                    rewritten = True
                else:
                    break
        if not rewritten:
            break
    matched = {i: seen[f"m{i}"] for i in range(len(ready))}
    for i, a in enumerate(ready):
        if seen[f"f{i}"]:
            return _failed(items, pk, (ready, ddl, check), batch, i, {"type": _failure_type(a.payload), "primary_key": pk}, matched, options)
        if seen[f"s{i}"]:
            return _failed(items, pk, (ready, ddl, check), batch, i, {"type": "schema", "issues": []}, matched, options)
    if static:
        i = min(static)
        return _failed(items, pk, (ready, ddl, check), batch, i, static[i], matched, options)
    return _result(items, pk, plan, [Outcome(batch[i], True, None, n) for i, n in matched.items() if n], [])


def _failed(items, pk, chain, batch, at, error, matched, options) -> WriteResult:
    bad = [Outcome(batch[at], False, error)] + [Outcome(a, False, {"type": "blocked", "blocked_by_action_uuid": batch[at].uuid}) for a in batch[at + 1 :]]
    if options.atomic or chain is None or at == 0:
        return _result(items, pk, None, [], bad)
    ready, ddl, check = chain
    good = [Outcome(batch[i], True, None, n) for i, n in matched.items() if n and i < at]
    return _result(items, pk, _chain(items, ready[:at], ddl, check), good, bad)


def _result(items: DataFrame, pk: str, plan: _Plan | None, good: list[Outcome], bad: list[Outcome]) -> WriteResult:
    message = "some write actions failed" if bad else None
    if plan is None:
        return WriteResult(not bad, good + bad, Changes(items.limit(0), items.limit(0), items.select(pk).limit(0), items, False), message)
    f = plan.frame
    key = F.col("row").getField(pk)
    made = [a.payload["data"][pk] for a in plan.actions if a.payload["type"] == "create"]
    old, kept = F.col("born") < 0, ~F.col("gone")
    # Keys that the batch deleted and created again: whole-row updates (at most one per create).
    again = [r[0] for r in f.where(old & ~kept & key.isin(made)).select(key).collect()] if made else []
    back = key.isin(again) if again else F.lit(False)
    rows = lambda c: f.where(c).select("row.*")
    return WriteResult(
        not bad,
        good + bad,
        Changes(
            rows(~old & kept & ~back),
            rows(old & kept & F.col("touched") | ~old & kept & back),
            f.where(old & ~kept & ~back).select(key.alias(pk)),
            rows(kept),
            bool(good),
        ),
        message,
    )


def _converges(items: DataFrame, actions: list[WriteAction], at: int, ddl: Ddl, pk: str) -> bool:
    """Whether the created row, with the later actions applied, at some point says nothing that the existing row does not."""
    spark, data = items.sparkSession, actions[at].payload["data"]
    found = items.where(_filter({pk: data[pk]}, Root(items.schema))).limit(1).collect()
    if not found:
        return False
    existing = _plain(found[0].asDict(recursive=True))
    current = spark.range(1).select(literal(data, items.schema).alias("r")).select("r.*")
    state = data
    for a in actions[at + 1 :]:
        if _subset(state, existing):
            return True
        result = write([a], current, ddl)
        if not result.ok:
            return False
        left = result.changes.final_items.collect()
        if not left:
            return False
        state = _plain(left[0].asDict(recursive=True))
        current = spark.createDataFrame(left, items.schema)
    return _subset(state, existing)


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items() if v is not None}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _subset(a: Any, b: Any) -> bool:
    """Everything that ``a`` says, ``b`` says too."""
    if isinstance(a, dict):
        return isinstance(b, dict) and all(v is None and k not in b or k in b and _subset(v, b[k]) for k, v in a.items())
    return deep_equal(a, b)


# Documents.

_REST = "__members_without_a_type"


def write_documents(actions: list[WriteAction], df: DataFrame, doc: str, schema: T.StructType, ddl: Ddl, options: Options = Options(), check=None) -> WriteResult:
    """Apply a batch to the documents in the Variant column ``doc``; the changes hold that column alone.

    ``schema`` declares their members; they are written through it, so the plan is the one of ``write``. Members of the
    document that it does not name stay as they are (inside lists and nested members they are not kept); a member that
    does not fit its type counts as missing, and a missing member stays missing.
    """
    members = F.try_variant_get(F.col(f"`{doc}`"), "$", "map<string,variant>")
    rest = F.to_json(F.map_filter(members, lambda k, v: ~k.isin(*schema.names)))
    typed = df.select(*[F.try_variant_get(F.try_element_at(members, F.lit(f.name)), "$", f.dataType.simpleString()).cast(f.dataType).alias(f.name) for f in schema.fields], rest.alias(_REST))
    result = write(actions, typed, ddl, options, check)

    def back(rows: DataFrame) -> DataFrame:
        own = F.try_variant_get(F.parse_json(F.to_json(F.struct(*[F.col(f"`{n}`") for n in schema.names]))), "$", "map<string,variant>")
        more = F.try_variant_get(F.parse_json(F.coalesce(F.col(_REST), F.lit("{}"))), "$", "map<string,variant>")
        return rows.select(F.to_variant_object(F.map_concat(own, more)).alias(doc))

    c = result.changes
    result.changes = Changes(back(c.insert), back(c.update), c.remove_keys, back(c.final_items), c.changed)
    return result


# What a batch touches, seen from outside.


def covering_filter(actions: list[WriteAction], ddl: Ddl, with_deletes: bool = True) -> dict | None:
    """A filter that every row matches that the batch can touch; None if that is all rows. Raises for creates without
    a key. Read-modify-write jobs prune their scan with it."""
    terms: list[dict] = []
    for a in actions:
        f = _cover(a.payload, ddl, "", with_deletes)
        if f == {}:
            return None
        if f is not None and f not in terms:
            terms.append(f)
    return None if not terms else terms[0] if len(terms) == 1 else {"$or": terms}


def _cover(p: dict, ddl: Ddl, scope: str, with_deletes: bool) -> dict | None:
    if p["type"] == "create":
        rules = ddl.rules(scope)
        if rules is None or not _key_ok(p["data"].get(rules.primary_key)):
            raise ValueError(f"a create without a key in the list {scope or '.'!r}")
        return {rules.primary_key: p["data"][rules.primary_key]}
    if p["type"] == "delete":
        return p["where"] if with_deletes else None
    if p["type"] != "array_scope":
        return p["where"]
    inner = _cover(p["action"], ddl, join_scope(scope, p["scope"]), True)
    if p["action"]["type"] == "create" or inner == {}:
        return p["where"]
    within = {p["scope"]: {"$elemMatch": inner}}
    return {"$and": [p["where"], within]} if p["where"] else within


def written_paths(action: WriteAction) -> list[str]:
    """Paths that an action writes, escaped; creations and deletions write whole rows."""

    def walk(p: dict, prefix: list[str]) -> list[str]:
        if p["type"] == "update":
            out: list[str] = []

            def leaves(x: dict, at: list[str]) -> None:
                for k, v in x.items():
                    if isinstance(v, dict) and v and p.get("method", "merge") == "merge":
                        leaves(v, [*at, k])
                    else:
                        out.append(join_path(*at, k))

            leaves(p["data"], prefix)
            return out
        if p["type"] == "array_scope":
            inner = [*prefix, *parse_path(p["scope"])]
            return [join_path(*inner)] if p["action"]["type"] in ("create", "delete") else walk(p["action"], inner)
        if p["type"] in ("add_to_set", "push", "pull", "inc"):
            return [join_path(*prefix, p["path"])]
        if p["type"] in ("set_property_undefined", "delete_property"):
            return [join_path(*prefix, *parse_path(p["path"]))]
        return []

    return walk(action.payload, [])


def to_wire(action: WriteAction) -> dict:
    return {"type": action.type, "ts": action.ts, "uuid": action.uuid, "payload": action.payload}


def from_wire(x: dict) -> WriteAction:
    if x.get("type") != "write" or not isinstance(x.get("uuid"), str) or not isinstance(x.get("payload"), dict) or x["payload"].get("type") not in VERBS:
        raise ValueError("no write action")
    return WriteAction(x["payload"], x["uuid"], x.get("ts", 0))


#: Types of errors that an outcome can carry.
ERRORS = frozenset("custom schema missing_key update_altered_key create_duplicated_key invalid_filter invalid_scope invalid_property_path invalid_data_value uuid_conflict blocked".split())


def outcome_to_wire(o: Outcome) -> dict:
    out = {"action": to_wire(o.action), "ok": o.ok, "affected": o.affected}
    return out if o.ok else out | {"error": o.error, "unrecoverable": o.unrecoverable}


def outcome_from_wire(x: dict) -> Outcome:
    error = x.get("error")
    if not isinstance(x.get("ok"), bool) or x["ok"] != (error is None) or error is not None and (not isinstance(error, dict) or error.get("type") not in ERRORS):
        raise ValueError("no outcome of a write action")
    return Outcome(from_wire(x.get("action") or {}), x["ok"], error, x.get("affected", 0))


def result_to_wire(r: WriteResult) -> dict:
    """A result without its rows."""
    return {"ok": r.ok, "changed": r.changes.changed, "actions": [outcome_to_wire(o) for o in r.actions], "error": r.error}


def result_from_wire(x: dict) -> tuple[bool, bool, list[Outcome], str | None]:
    actions = [outcome_from_wire(o) for o in x.get("actions", [])]
    if not isinstance(x.get("ok"), bool) or x["ok"] != all(o.ok for o in actions):
        raise ValueError("no result of a write")
    return x["ok"], bool(x.get("changed")), actions, x.get("error")
