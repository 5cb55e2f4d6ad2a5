"""Rules that the queries with SQL do not reach."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import delta as D
from docloom.operators import write as W
from docloom.operators.deep_map import RemoveKey, RenameKey, ReplaceInString, ReplaceValue, Target, map_deep, map_value
from docloom.operators.page import Slice, SortKey, query
from docloom.plans.compiler import compile_filter
from docloom.plans.evaluate import matches
from docloom.plans.predicate import FilterError, check_strict
from docloom.sources.tables import filter_sql

RULES = [
    [ReplaceValue("x", "y")], [ReplaceValue("x", "y", Target(key="k"))], [ReplaceValue("x", "y", Target(path="m.a\\.b"))], [ReplaceValue("x", "y", Target(path="m.k"))],
    [ReplaceInString("x", "zz", Target(search_key=re.compile("^k")))], [RemoveKey(Target(key="k"))], [RemoveKey(Target(search_key="k"))], [RemoveKey(Target(search_key="k"), all=True)],
    [RemoveKey(Target(path="m.kk"))], [RenameKey(Target(key="k"), "new")], [RenameKey(Target(key="k"), "kk")], [RenameKey(Target(search_key="k"), "__proto__")],
    [RemoveKey(Target(key="k")), ReplaceValue("x", "y"), RenameKey(Target(path="m.kk"), "k")],
]


@pytest.mark.parametrize("rules", RULES, ids=repr)
def test_deep_map_on_maps_and_variants_is_that_of_documents(spark, rules):
    doc = {"m": {"k": "x", "kk": "x", "a.b": "x"}, "n": {"s": {"k": "x", "q": "w"}}}
    df = spark.range(1).select(
        F.create_map(*[F.lit(x) for e in doc["m"].items() for x in e]).alias("m"), F.create_map(F.lit("s"), F.create_map(*[F.lit(x) for e in doc["n"]["s"].items() for x in e])).alias("n")
    )
    want = map_value(doc, rules)
    assert map_deep(df, rules).first().asDict(recursive=True) == want
    variant = spark.range(1).select(*[F.parse_json(F.to_json(F.col(c))).alias(c) for c in ()] + [F.parse_json(F.lit('{"k":"x","kk":"x","a.b":"x"}')).alias("m")])
    assert map_deep(variant, rules).first().m.toPython() == map_value({"m": doc["m"]}, rules)["m"]


def test_deep_map_refuses_what_it_cannot_do(spark):
    inside = spark.sql("SELECT array(parse_json('1')) AS l")
    with pytest.raises(ValueError):
        map_deep(inside, [ReplaceValue(1, 2)])
    structs = spark.sql("SELECT map('u', named_struct('k', 'x')) AS m")
    assert map_deep(structs, [RemoveKey(Target(path="m.u.k"))]).first().m["u"].k is None
    with pytest.raises(ValueError):
        map_deep(structs, [RenameKey(Target(path="m.u.k"), "z")])


def test_patterns_are_those_of_the_engine(spark):
    texts = ["٣", "3", "é", "e", " ", " ", "_", "a1", "B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"\d", r"\D", r"\w", r"\W", r"\s", r"\S", r"[\d_]", r"^[^\s]$", "e", "^a", r"\\"):
        f = {"t": {"$regex": pattern}}
        assert {r.t for r in df.where(compile_filter(f, df.schema)).collect()} == {t for t in texts if matches({"t": t}, f)}, pattern


def test_literal_patterns_are_pushed_down(spark, tmp_path):
    spark.createDataFrame([("abc",), ("xabc",)], "t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(compile_filter({"t": {"$regex": "^ab"}}, df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(t,ab)" in plan


def test_strict_filters_are_strict_all_the_way():
    check_strict({"a": 1, "b": {"$elemMatch": {"c": {"$gt": 1}}}})
    for f in ({"$or": [{"a": 1}]}, {"a": {"$elemMatch": {"$or": [{"b": 1}]}}}, {"a": {"b": {"$and": [{"c": 1}]}}}):
        with pytest.raises(FilterError):
            check_strict(f)


def test_fractions_do_not_vanish_in_whole_numbers(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "id string, n long, x double")
    ddl = W.Ddl({".": W.ListRules("id")})
    inc = lambda path, by: W.write([W.WriteAction({"type": "inc", "path": path, "amount": by, "where": {}}, "u")], df, ddl)
    assert not inc("n", 0.5).ok and inc("n", 2.0).changes.final_items.first().n == 3 and inc("x", 0.5).changes.final_items.first().x == 1.5


def test_deltas_of_maps_and_variants(spark):
    at = lambda pairs, doc: spark.createDataFrame([(1, [dict(pairs)], doc)], "id int, l array<map<string,array<int>>>, j string").select("id", "l", F.struct(F.parse_json("j").alias("v")).alias("s"))
    a, b = at([("x", [1]), ("y", [2])], '{"a":1,"b":[1]}'), at([("y", [2]), ("x", [1])], '{"b":[1],"a":1}')
    assert D.diff(a, b, "id").update.count() == 0
    assert D.diff(a, at([("x", [1]), ("y", [3])], '{"a":1,"b":[1]}'), "id").update.count() == 1
    assert D.diff(a, at([("x", [1]), ("y", [2])], '{"a":1,"b":[2]}'), "id").update.count() == 1


def test_big_numbers_in_variants_are_in_order(spark):
    numbers = [2**53, 2**53 + 1, 2**53 + 2, 1, 1.5, -(2**53) - 1, -(2**53), 10**30, 2**53 + 0.0]
    rows = [(i, f'{{"id":{i},"n":{n}}}') for i, n in enumerate(numbers)]
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("d"))
    order = [r.i for r in query(df, None, Slice((SortKey("n"),)), "id", doc="d").collect()]
    assert order == sorted(range(len(numbers)), key=lambda i: (numbers[i], i))


def test_documents_keep_what_their_schema_does_not_name(spark):
    df = spark.createDataFrame([('{"id":"a","n":1,"free":{"x":[1,2]}}',), ('{"id":"b","n":"no number"}',)], "j string").select(F.parse_json("j").alias("doc"))
    schema = T._parse_datatype_string("id string, n long, tags array<string>")
    actions = [W.WriteAction({"type": "push", "path": "tags", "items": ["t"], "where": {"n": 1}}, "u"), W.WriteAction({"type": "create", "data": {"id": "c", "n": 5}}, "v")]
    r = W.write_documents(actions, df, "doc", schema, W.Ddl({".": W.ListRules("id")}))
    got = sorted((x.doc.toPython() for x in r.changes.final_items.collect()), key=lambda x: x["id"])
    assert r.ok and got == [{"id": "a", "n": 1, "free": {"x": [1, 2]}, "tags": ["t"]}, {"id": "b"}, {"id": "c", "n": 5}]
    assert [x.doc.toPython()["id"] for x in r.changes.update.collect()] == ["a"]


def test_sql_text_of_filters(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, None), (3, "b", 5.0)], "id int, t string, x double")
    filters = [{"t": None}, {"t": {"$ne": "a"}}, {"x": {"$gt": 1, "$lt": 3}}, {"x": {"$gt": "1"}}, {"$nor": [{"t": "a"}]}, {"t": {"$not": {"$in": ["a", 3]}}}, {"gone": {"$exists": False}}, {"t": {"$regex": "^[ab]$"}}, {"t": {"$type": "string"}}, {}, {"$or": []}]
    for f in filters:
        text, args = filter_sql(f, df.schema)
        named = re.sub(r"\$(\d+)", r":p\1", text)
        got = spark.sql(f"SELECT id FROM {{rows}} WHERE {named}", args={f"p{i}": a for i, a in enumerate(args, 1)}, rows=df)
        assert {r.id for r in got.collect()} == {r.id for r in df.where(compile_filter(f, df.schema)).collect()}, f
    for f, schema in (({"l": 1}, "l array<int>"), ({"m.k": 1}, "m map<string,int>")):
        with pytest.raises(FilterError):
            filter_sql(f, T._parse_datatype_string(schema))


def test_outcomes_there_and_back():
    o = W.Outcome(W.WriteAction({"type": "delete", "where": {}}, "u", 3), False, {"type": "schema", "issues": []})
    assert W.outcome_from_wire(W.outcome_to_wire(o)) == o
    for bad in ({}, {"action": W.to_wire(o.action), "ok": False}, {"action": W.to_wire(o.action), "ok": False, "error": {"type": "odd"}}):
        with pytest.raises(ValueError):
            W.outcome_from_wire(bad)
