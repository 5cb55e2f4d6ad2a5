import re

import pytest
from pyspark.sql import functions as F

from docloom.operators.deep_map import RemoveKey, RenameKey, ReplaceInString, ReplaceValue, Target, map_deep, map_deep_json, map_value
from docloom.operators.write import Ddl, ListRules, Options, WriteAction, covering_filter, errors, failures, from_wire, to_wire, validate_action, write, written_paths
from docloom.plans.validate import validate_filter

SCHEMA = "id string, text string, n double, tags array<string>, meta struct<a:string,b:struct<c:double>>, rec map<string,double>, kids array<struct<cid:string,label:string,items:array<struct<iid:string,v:double>>>>"
DDL = Ddl({".": ListRules("id"), "kids": ListRules("cid"), "kids.items": ListRules("iid")})


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items() if v is not None}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _items(spark, *docs):
    rows = spark.createDataFrame([(__import__("json").dumps(d),) for d in docs], "j string")
    return rows.select(F.from_json("j", SCHEMA).alias("x")).select("x.*")


def _final(r):
    return {d["id"]: d for d in (_plain(x.asDict(recursive=True)) for x in r.changes.final_items.collect())}


def _acts(*payloads):
    return [WriteAction(p, f"u{i}") for i, p in enumerate(payloads)]


A = {"id": "a", "text": "x", "n": 1, "tags": ["p", "q"], "meta": {"a": "m"}, "rec": {"k": 1}, "kids": [{"cid": "1", "label": "l", "items": [{"iid": "i", "v": 1}]}, {"cid": "2", "items": []}]}
B = {"id": "b"}


def _one(spark, payload, doc=None):
    r = write(_acts(payload), _items(spark, doc or A, B), DDL)
    assert r.ok, r.actions
    return _final(r)["a"]


CASES = [
    ({"type": "update", "data": {"text": "y", "meta": {"b": {"c": 2}}}, "where": {"id": "a"}}, {"text": "y", "meta": {"a": "m", "b": {"c": 2}}}),
    ({"type": "update", "data": {"meta": {"b": {"c": 2}}, "tags": ["z"]}, "method": "assign", "where": {"id": "a"}}, {"meta": {"b": {"c": 2}}, "tags": ["z"]}),
    ({"type": "update", "data": {"rec": {"j": 2}}, "where": {"id": "a"}}, {"rec": {"k": 1, "j": 2}}),
    ({"type": "push", "path": "tags", "items": ["p"], "where": {"id": "a"}}, {"tags": ["p", "q", "p"]}),
    ({"type": "pull", "path": "tags", "items_where": ["p", "zz"], "where": {}}, {"tags": ["q"]}),
    ({"type": "pull", "path": "kids", "items_where": {"cid": "1"}, "where": {}}, {"kids": [A["kids"][1]]}),
    ({"type": "add_to_set", "path": "tags", "items": ["q", "r", "r"], "where": {"id": "a"}}, {"tags": ["p", "q", "r"]}),
    ({"type": "add_to_set", "path": "kids", "items": [{"cid": "1", "label": "no"}, {"cid": "3"}], "unique_by": "pk", "where": {"id": "a"}}, {"kids": [*A["kids"], {"cid": "3"}]}),
    ({"type": "inc", "path": "n", "amount": 2.5, "where": {"id": "a"}}, {"n": 3.5}),
    ({"type": "delete_property", "path": "meta.a", "where": {"id": "a"}}, {"meta": {}}),
    ({"type": "set_property_undefined", "path": "text", "where": {"id": "a"}}, {"text": None}),
    ({"type": "delete_property", "path": "rec.k", "where": {"id": "a"}}, {"rec": {}}),
    ({"type": "array_scope", "scope": "kids", "where": {}, "action": {"type": "update", "data": {"label": "new"}, "where": {"cid": "2"}}}, {"kids": [A["kids"][0], {"cid": "2", "label": "new", "items": []}]}),
    ({"type": "array_scope", "scope": "kids", "where": {"id": "a"}, "action": {"type": "create", "data": {"cid": "9"}}}, {"kids": [*A["kids"], {"cid": "9"}]}),
    ({"type": "array_scope", "scope": "kids.items", "where": {}, "action": {"type": "delete", "where": {"v": {"$gt": 0}}}}, {"kids": [{"cid": "1", "label": "l", "items": []}, A["kids"][1]]}),
    (
        {"type": "array_scope", "scope": "kids", "where": {}, "action": {"type": "array_scope", "scope": "items", "where": {"cid": "1"}, "action": {"type": "inc", "path": "v", "amount": 1, "where": {}}}},
        {"kids": [{"cid": "1", "label": "l", "items": [{"iid": "i", "v": 2}]}, A["kids"][1]]},
    ),
]


@pytest.mark.parametrize("payload,want", CASES, ids=lambda p: str(p.get("type", "")) if isinstance(p, dict) else "")
def test_verbs(spark, payload, want):
    assert _one(spark, payload) == {k: v for k, v in (A | want).items() if v is not None}


def test_missing_values_start_empty(spark):
    r = write(_acts({"type": "inc", "path": "n", "amount": 2, "where": {"id": "b"}}, {"type": "push", "path": "tags", "items": ["t"], "where": {"id": "b"}}, {"type": "update", "data": {"meta": {"b": {"c": 1}}}, "where": {"id": "b"}}), _items(spark, A, B), DDL)
    assert _final(r)["b"] == {"id": "b", "n": 2, "tags": ["t"], "meta": {"b": {"c": 1}}}


def test_batches_net_out(spark):
    r = write(
        _acts({"type": "create", "data": {"id": "c", "text": "1"}}, {"type": "update", "data": {"text": "2"}, "where": {"id": "c"}}, {"type": "create", "data": {"id": "d"}}, {"type": "delete", "where": {"id": {"$in": ["d", "a"]}}}, {"type": "create", "data": {"id": "a", "text": "again"}}, {"type": "delete", "where": {"id": "none"}}),
        _items(spark, A, B), DDL,
    )
    ids = lambda df: sorted(x[0] for x in df.select("id").collect())
    assert r.ok and _final(r) == {"b": B, "c": {"id": "c", "text": "2"}, "a": {"id": "a", "text": "again"}}
    assert ids(r.changes.insert) == ["c"] and ids(r.changes.update) == ["a"] and ids(r.changes.remove_keys) == []
    assert [o.action.uuid for o in r.actions] == ["u0", "u1", "u2", "u3", "u4"]


def test_failures_halt_and_block(spark):
    items = _items(spark, A, B)
    acts = _acts({"type": "update", "data": {"text": "ok"}, "where": {"id": "a"}}, {"type": "create", "data": {"id": "b"}}, {"type": "delete", "where": {}})
    r = write(acts, items, DDL)
    assert [e["type"] for e in errors(r)] == ["create_duplicated_key", "blocked"] and errors(r)[1]["blocked_by_action_uuid"] == "u1"
    assert _final(r)["a"]["text"] == "ok" and len(_final(r)) == 2
    r = write(acts, items, DDL, Options(atomic=True))
    assert not r.changes.changed and _final(r)["a"] == A and len(r.actions) == 2
    r = write(acts, items, DDL, Options(duplicate_create="always-update"))
    assert r.ok and r.changes.final_items.count() == 0
    r = write(acts[:2], items, DDL, Options(duplicate_create="if-convergent"))
    assert r.ok
    r = write(_acts({"type": "create", "data": {"id": "a", "text": "other"}}), items, DDL, Options(duplicate_create="if-convergent"))
    assert not r.ok
    r = write(_acts({"type": "update", "data": {"id": "z"}, "where": {"id": "a"}}), items, DDL)
    assert errors(r)[0]["type"] == "update_altered_key"
    r = write(_acts({"type": "update", "data": {"n": 50}, "where": {}}), items, DDL, check=lambda row: F.coalesce(row["n"], F.lit(0)) <= 10)
    assert errors(r)[0]["type"] == "schema" and _final(r)["a"] == A and failures(r)[0].unrecoverable
    same, other = WriteAction({"type": "inc", "path": "n", "amount": 1, "where": {"id": "a"}}, "u"), WriteAction({"type": "delete", "where": {}}, "u")
    assert _final(write([same, same], items, DDL))["a"]["n"] == 2
    assert errors(write([same, other], items, DDL))[0]["type"] == "uuid_conflict"
    assert errors(write(_acts({"type": "delete", "where": {}}), _items(spark, {"text": "no key"}), DDL))[0]["type"] == "missing_key"


STATIC = [
    ({"type": "create", "data": {"text": "x"}}, "missing_key"),
    ({"type": "create", "data": {"id": "x", "n": float("nan")}}, "invalid_data_value"),
    ({"type": "create", "data": {"id": "x", "n": "text"}}, "schema"),
    ({"type": "update", "data": {"gone": 1}, "where": {}}, "schema"),
    ({"type": "update", "data": {}, "where": {"nope": 1}}, "invalid_filter"),
    ({"type": "update", "data": {}, "where": {"n": {"$foo": 1}}}, "invalid_filter"),
    ({"type": "array_scope", "scope": "tags", "where": {}, "action": {"type": "delete", "where": {}}}, "invalid_scope"),
    ({"type": "delete_property", "path": "id", "where": {}}, "invalid_property_path"),
    ({"type": "delete_property", "path": "kids.label", "where": {}}, "invalid_property_path"),
    ({"type": "inc", "path": "text", "amount": 1, "where": {}}, "custom"),
    ({"type": "push", "path": "n", "items": [1], "where": {}}, "custom"),
]


@pytest.mark.parametrize("payload,kind", STATIC, ids=str)
def test_static_validation(spark, payload, kind):
    items = _items(spark, A)
    assert validate_action(WriteAction(payload, "u"), items.schema, DDL)[0]["type"] == kind
    assert errors(write(_acts(payload), items, DDL))[0]["type"] == kind


def test_cover_paths_and_wire():
    scope = {"type": "array_scope", "scope": "kids", "where": {"id": "a"}, "action": {"type": "update", "data": {"label": "x"}, "where": {"cid": "1"}}}
    acts = _acts({"type": "create", "data": {"id": "n"}}, {"type": "delete", "where": {"n": 1}}, scope, {"type": "delete", "where": {"n": 1}})
    assert covering_filter(acts, DDL) == {"$or": [{"id": "n"}, {"n": 1}, {"$and": [{"id": "a"}, {"kids": {"$elemMatch": {"cid": "1"}}}]}]}
    assert covering_filter(_acts({"type": "delete", "where": {}}), DDL) is None
    assert written_paths(acts[2]) == ["kids.label"] and written_paths(WriteAction({"type": "update", "data": {"meta": {"b": {"c": 1}}, "a.b": 1}, "where": {}}, "u")) == ["meta.b.c", "a\\.b"]
    assert from_wire(to_wire(acts[0])) == acts[0]
    with pytest.raises(ValueError):
        from_wire({"type": "write"})


def test_filter_validation(spark):
    schema = _items(spark, A).schema
    reasons = lambda f, **k: [i.reason for i in validate_filter(f, schema, **k)]
    assert reasons({"nope": 1}) == ["unknown_field"] and reasons({"nope": 1}, strict=False) == []
    assert reasons({"n": "x"}) == ["type_mismatch"] and reasons({"n": {"$in": ["x", 1]}}) == [] and reasons({"n": {"$in": ["x"]}}) == ["type_mismatch"]
    assert reasons({"$or": [{"n": "x"}]}) == [] and reasons({"n": {"$ne": "x"}}) == [] and reasons({"n": {"$gt": float("inf")}}) == ["non_finite"]
    assert reasons({"kids": {"$elemMatch": {"nope": 1}}}) == ["unknown_field"] and reasons([]) == ["malformed"]


def test_deep_map(spark):
    doc = {"id": "a", "text": "x-x", "n": 1.0, "tags": ["x-x", "q"], "meta": {"a": "x-x", "b": {"c": 1.0}}}
    df = _items(spark, doc).select("id", "text", "n", "tags", "meta")
    rules = [
        ReplaceInString("x", "y"), ReplaceInString(re.compile("y-(x)"), r"\1y", Target(path="meta.a")), ReplaceValue(1, 7, Target(search_key="n")), ReplaceValue(1, 5, Target(key="c")),
        RenameKey(Target(key="a"), "z"), RemoveKey(Target(key="text")),
    ]
    want = {"id": "a", "n": 7.0, "tags": ["y-x", "q"], "meta": {"z": "xy", "b": {"c": 5.0}}}
    assert map_value(doc, rules) == want
    assert map_deep(df, rules).first().asDict(recursive=True) == want
    text = spark.createDataFrame([(__import__("json").dumps(doc),), (None,)], "j string")
    got = [r[0] for r in map_deep_json(text, "j", rules).collect()]
    assert __import__("json").loads(got[0]) == want and got[1] is None
    assert map_value(doc, [ReplaceValue("nothing", 1)]) is doc
