"""More queries with their SQL: the rules of the language, of pages, change sets and writes, one operator at a time.

Where an operator works on the driver (paths, checks, outcomes) its answers are a small frame, and the SQL lists them.
"""

from __future__ import annotations

from functools import cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import schema as S
from docloom.functions.paths import flatten_columns, join_path, parse_path, resolve, schema_at, schema_tree, set_value
from docloom.operators import delta as D
from docloom.operators import write as W
from docloom.operators.deep_map import RemoveKey, RenameKey, ReplaceInString, ReplaceValue, Target, map_deep
from docloom.operators.filter import compiled_matcher, filter_documents, filter_rows
from docloom.operators.page import Boundary, Slice, SortKey, boundary_of, check_slice, query
from docloom.plans.catalogue import _DDL, _ITEM, _N, _TAGS, QUERIES, SQL, _lettered, _nullable, _on, _orders, cd, nullable, od, register, table
from docloom.plans.compiler import try_compile
from docloom.plans.validate import validate_filter
from docloom.sources.tables import Clauses, ColumnTable, concat, filter_sql, flatten, order_sql


@cache
def _type(ddl: str) -> T.StructType:
    """Parsed when it is needed: the parser asks for a session."""
    return T._parse_datatype_string(ddl)


def _sql_value(x: Any) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def _facts(name: str, columns: str, answers, expected: list[tuple]) -> None:
    """A frame of ``answers()`` against the rows that are expected."""
    types = ", ".join(f"{c} {'long' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for c, v in zip(columns.split(), next((r for r in expected if None not in r), expected[0]), strict=True))
    QUERIES[name] = lambda s, d: s.createDataFrame([tuple(r) for r in answers()], types)
    SQL[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql_value, r)) + ')' for r in expected)}) t({', '.join(columns.split())})"


DOCUMENT = "id long, name string, tags array<string>, items array<struct<line:int,qty:double>>, extra map<string,string>, lists map<string,array<int>>, at struct<x:double,y:double>, day timestamp, raw variant"

# Paths.
_facts("path_parse", "path segments", lambda: [(p, "|".join(parse_path(p))) for p in ("a.b.c", "a\\.b.c", "one", "x\\.y\\.z")], [("a.b.c", "a|b|c"), ("a\\.b.c", "a.b|c"), ("one", "one"), ("x\\.y\\.z", "x.y.z")])
_facts("path_join", "path", lambda: [(join_path(*x),) for x in (("a", "b"), ("a.b", "c"), ("", "x"), ("d",))], [("a.b",), ("a\\.b.c",), ("x",), ("d",)])
_facts("path_resolve", "path known kind arrays record", lambda: [(p, r.known, r.dtype.typeName() if r.dtype else None, r.arrays, r.record) for p in ("items.qty", "extra.k", "at.x", "gone", "raw.a.b", "lists.k") for r in [resolve(p, _type(DOCUMENT))]],
       [("items.qty", True, "double", 1, False), ("extra.k", True, "string", 0, True), ("at.x", True, "double", 0, False), ("gone", False, None, 0, False), ("raw.a.b", True, "variant", 0, True), ("lists.k", True, "array", 0, True)])


def _tree() -> list[tuple]:
    out: list[tuple] = []

    def walk(node) -> None:
        out.append((node.path, node.kind))
        for child in node.children:
            walk(child)

    walk(schema_tree(_type("id long, items array<struct<qty:double>>, extra map<string,string>")))
    return out


_facts("path_tree", "path kind", _tree, [("", "object"), ("id", "number"), ("items", "array"), ("items", "object"), ("items.qty", "number"), ("extra", "object"), ("extra.*", "string")])
_facts("path_schema_at", "path dtype", lambda: [(p, t.simpleString() if (t := schema_at(p, _type(DOCUMENT), True)) else None) for p in ("items", "tags", "at.y", "gone")], [("items", "struct<line:int,qty:double>"), ("tags", "string"), ("at.y", "double"), ("gone", None)])
_on("path_escaped", lambda s, d: table(s, d, "nation").withColumnRenamed("n_name", "n.name"), {"n\\.name": {"$gt": "G"}}, ["n_nationkey"], "SELECT n_nationkey FROM nation WHERE n_name > 'G'")


@register("path_set", "SELECT c_custkey, c_acctbal * 2 AS balance, c_name AS name FROM customer")
def path_set(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", F.struct(F.struct(F.col("c_acctbal").alias("balance")).alias("x"), F.col("c_name").alias("name")).alias("r"))
    return set_value(c, "r.x.balance", F.col("r.x.balance") * 2).select("c_custkey", "r.x.balance", "r.name")


# Declared shapes.
_DECLARED = T.StructType([
    T.StructField("a", T.VariantType(), True, {"union": ["string", "array<string>"]}),
    T.StructField("b", T.VariantType(), True, {"union": ["string", "double"]}),
    T.StructField("c", T.StringType(), True, {"normalizes": True}),
    T.StructField("d", T.StructType([T.StructField("e", T.BinaryType())]), False, {"strict": True}),
])
_facts("schema_findings", "finding path", lambda: [("ambiguous", p) for p in S.shape_ambiguous_paths(_DECLARED)] + [("scalars", p) for p in S.multi_scalar_paths(_DECLARED)] + [("normalizes", p) for p in S.normalizing_paths(_DECLARED)] + [("unsafe", p) for p, _ in S.unsafe_fields(_DECLARED)],
       [("ambiguous", "a"), ("scalars", "b"), ("normalizes", "c"), ("unsafe", "d.e")])
_facts("schema_fields", "path optional strict", lambda: [(p, S.is_optional(f), S.is_strict(f)) for p, f in S.fields(_DECLARED)], [("a", True, False), ("b", True, False), ("c", True, False), ("d", False, True), ("d.e", True, False)])
_facts("schema_accessors", "path type value", lambda: [(f.name, "array" if S.is_array(f.dataType) else "record" if S.is_record(f.dataType) else "object" if S.is_object(f.dataType) else "leaf", (S.element_type(f.dataType) or S.value_type(f.dataType) or S.unwrapped(f.dataType)).typeName()) for f in _type(DOCUMENT).fields[:7]],
       [("id", "leaf", "long"), ("name", "leaf", "string"), ("tags", "array", "string"), ("items", "array", "struct"), ("extra", "record", "string"), ("lists", "record", "array"), ("at", "object", "struct")])
_facts("schema_conform", "path kind", lambda: [(e.path, e.kind) for f in ({"a": "x"}, {"c": "x"}, {"b": 1}) for e in try_compile(f, _DECLARED, conform=True)[1]] + [(e.path, e.kind) for e in try_compile({"lists.k": 1}, _type(DOCUMENT), conform=True)[1]],
       [("a", "schema_ambiguous"), ("c", "schema_normalizes"), ("lists.k", "path_conversion")])

# The language.
_nullable("flt_wide_or", {"$or": [{"o_orderkey": i} for i in range(0, 3000, 3)]}, "o_orderkey < 3000 AND o_orderkey % 3 = 0")
_nullable("flt_deep_logic", {"$and": [{"$or": [{"$nor": [{"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 5000}}]}]}]}]}, "NOT (coalesce(o_orderstatus = 'F', false) AND coalesce(o_totalprice > 5000, false))")
_nullable("flt_literal_regex", {"o_orderpriority": {"$regex": "^2-HI"}}, "starts_with(o_orderpriority, '2-HI')")
_nullable("flt_literal_regex_inside", {"o_orderpriority": {"$regex": "GEN"}}, "contains(o_orderpriority, 'GEN')")
_nullable("flt_regex_digit", {"o_orderpriority": {"$regex": "^\\d-[A-M]"}}, "regexp_matches(o_orderpriority, '^[0-9]-[A-M]')")
_orders("flt_leaf_elemmatch", {"items.qty": {"$elemMatch": {"$gt": 1}}}, "false")
_orders("flt_exists_below_array", {"items.flag": {"$exists": True}}, "EXISTS " + _ITEM.format("true"))
_orders("flt_not_exists_below_array", {"items.flag": {"$exists": False}}, "NOT EXISTS " + _ITEM.format("true"))
_orders("flt_logic_in_document", {"items": {"$or": [{"flag": "R"}, {"qty": {"$lt": 2}}]}}, "EXISTS " + _ITEM.format("(l_returnflag = 'R' OR l_quantity < 2)"))
_orders("flt_elem_not", {"items": {"$elemMatch": {"qty": {"$not": {"$lte": 48}}}}}, "EXISTS " + _ITEM.format("l_quantity > 48"))
_orders("flt_scalar_elem_inert", {"tags": {"$elemMatch": {"$exists": True, "$in": ["R"]}}}, "false")

_NESTED = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"a\":{\"b\":1}}' WHEN 1 THEN '{\"a\":[{\"b\":1},2]}' WHEN 2 THEN '{\"a\":[[[[{\"b\":2},[{\"b\":1}]]]]]}' ELSE '{\"a\":[[[]]]}' END AS j FROM events"


def _nested_variants(s: SparkSession, d: str) -> DataFrame:
    number = F.col("event_id") % 4
    text = F.when(number == 0, '{"a":{"b":1}}').when(number == 1, '{"a":[{"b":1},2]}').when(number == 2, '{"a":[[[[{"b":2},[{"b":1}]]]]]}').otherwise('{"a":[[[]]]}')
    return table(s, d, "events").select("event_id", F.parse_json(text).alias("doc"))


_on("flt_variant_nested", _nested_variants, {"doc.a.b": 1}, ["event_id"], "SELECT event_id FROM events WHERE event_id % 4 <> 3")
_on("flt_variant_nested_ne", _nested_variants, {"doc.a.b": {"$ne": 2}}, ["event_id"], "SELECT event_id FROM events WHERE event_id % 4 <> 2")


def _records(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.map_from_arrays(F.array(F.col("o_orderstatus"), F.lit("price")), F.array(F.lit("x"), F.col("o_totalprice").cast("string"))).alias("rec"))


_on("flt_record_key", _records, {"rec.F": "x"}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
_on("flt_record_exists", _records, {"rec.O": {"$exists": False}}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'")


def _documents(s: SparkSession, d: str) -> list[dict]:
    return [{"key": r[0], "name": r[1], "region": {"id": r[2]}} for r in table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]


@register("flt_documents", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2 OR n_name < 'C'")
def flt_documents(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(x["key"],) for x in filter_documents(s, _documents(s, d), {"$or": [{"region.id": 2}, {"name": {"$lt": "C"}}]})], "k long")


@register("flt_matcher", "SELECT n_nationkey AS k, n_regionkey = 2 OR n_name < 'C' AS hit FROM nation")
def flt_matcher(s: SparkSession, d: str) -> DataFrame:
    hit = compiled_matcher({"$or": [{"region.id": 2}, {"name": {"$lt": "C"}}]})
    return s.createDataFrame([(x["key"], hit(x)) for x in _documents(s, d)], "k long, hit boolean")


def _issues() -> list[tuple]:
    filters = [{"gone": 1}, {"id": "x"}, {"name": {"$gt": 3}}, {"id": {"$gt": float("inf")}}, {"$or": [{"gone": 1}]}, {"items": {"$elemMatch": {"gone": 1}}}, {"name": {"$size": 2}}, {"id": {"$regex": "x"}}, {"id": {"$bad": 1}}, {"items.qty": {"$in": ["a"]}}]
    return [(n, i.path, i.reason) for n, f in enumerate(filters) for i in validate_filter(f, _type(DOCUMENT))]


_facts("val_issues", "n path reason", _issues, [(0, "gone", "unknown_field"), (1, "id", "type_mismatch"), (2, "name", "type_mismatch"), (3, "id", "non_finite"), (5, "items.gone", "unknown_field"), (6, "name", "type_mismatch"), (7, "id", "type_mismatch"), (8, "", "malformed"), (9, "items.qty", "type_mismatch")])


# Text of a query.
@register("sql_filter_text", f"SELECT o_orderkey, o_totalprice FROM {_N} n WHERE (o_orderstatus IN ('F', 'P') OR coalesce(o_totalprice < 9000, false)) AND NOT coalesce(o_orderpriority = '1-URGENT', false) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 60 OFFSET 5")
def sql_filter_text(s: SparkSession, d: str) -> DataFrame:
    df = nullable(s, d)
    first, second = ({"$or": [{"o_orderstatus": {"$in": ["F", "P"]}}, {"o_totalprice": {"$lt": 9000}}]}, {"o_orderpriority": {"$ne": "1-URGENT"}})
    where, args = concat(filter_sql(first, df.schema), filter_sql(second, df.schema))
    tail, values = flatten(Clauses(where, args, order_sql((SortKey("o_totalprice", -1),), "o_orderkey"), 60, 5), "named")
    return s.sql(f"SELECT o_orderkey, o_totalprice FROM {{rows}} {tail}", args=values, rows=df)


_facts("sql_dialects", "dialect text n_args", lambda: [(k, *(lambda t: (t[0], len(t[1])))(flatten(Clauses("a = $1", ["x"], "a", 5, 2), k))) for k in ("spark", "postgres", "sqlite")],
       [("spark", "WHERE a = ? ORDER BY a LIMIT ? OFFSET ?", 3), ("postgres", "WHERE a = $1 ORDER BY a LIMIT $2 OFFSET $3", 3), ("sqlite", "WHERE a = ? ORDER BY a LIMIT ? OFFSET ?", 3)])


# Pages.
@register("pg_cursor", "SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 60) ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 30")
def pg_cursor(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "orders").select("o_orderkey", "o_totalprice").where("o_totalprice IS NOT NULL")
    sort = (SortKey("o_totalprice", -1),)
    last = query(df, None, Slice(sort, limit=30), "o_orderkey").collect()[-1]
    after = Boundary.parse(boundary_of(df, last, sort, "o_orderkey").cursor())
    return query(df, None, Slice(sort, limit=30, after_boundary=after), "o_orderkey")


_facts("pg_slice_checks", "n errors", lambda: [(n, len(check_slice(x))) for n, x in enumerate((Slice(limit=-1), Slice(offset=1.5), Slice((SortKey("a"),), offset=1, after_pk=2), Slice(after_pk=2), Slice((SortKey("a"),), after_boundary=Boundary((1, 2), 3)), Slice((SortKey("a", 2),)), Slice((SortKey("a"),), limit=3)))],
       [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 0)])


@register("srt_big_variant", "SELECT event_id FROM events ORDER BY 9007199254740992 + event_id % 5 DESC, event_id LIMIT 50")
def srt_big_variant(s: SparkSession, d: str) -> DataFrame:
    big = F.lit(2**53) + F.col("event_id") % 5
    e = table(s, d, "events").select("event_id", F.parse_json(F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"n":'), big, F.lit("}"))).alias("doc"))
    return query(e, None, Slice((SortKey("n", -1),), limit=50), "id", doc="doc").select("event_id")


@register("pg_sortable", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def pg_sortable(s: SparkSession, d: str) -> DataFrame:
    return ColumnTable(table(s, d, "customer"), "c_custkey", ("c_custkey", "c_acctbal"), {"c_acctbal": -1}).query(None, Slice((SortKey("c_acctbal", -1),), limit=12))


# Change sets of maps and Variants.
_MAPPED = "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0"


def _mapped(s: SparkSession, d: str, changed: bool) -> DataFrame:
    price = F.when((F.col("o_orderkey") % 5 == 0) & F.lit(changed), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    keys = [F.lit("s"), F.lit("p")] if changed else [F.lit("p"), F.lit("s")]
    values = {"s": F.col("o_orderstatus"), "p": price.cast("string")}
    m = F.map_from_arrays(F.array(*keys), F.array(*[values[x] for x in (("s", "p") if changed else ("p", "s"))]))
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("s"), price.alias("p")) if changed else F.struct(price.alias("p"), F.col("o_orderstatus").alias("s")))
    return table(s, d, "orders").select("o_orderkey", F.struct(m.alias("m")).alias("r"), F.array(m).alias("l"), F.parse_json(text).alias("doc"))


@register("dlt_diff_map", _MAPPED)
def dlt_diff_map(s: SparkSession, d: str) -> DataFrame:
    return D.diff(_mapped(s, d, True).drop("doc"), _mapped(s, d, False).drop("doc"), "o_orderkey").update.select("o_orderkey")


@register("dlt_diff_variant", _MAPPED)
def dlt_diff_variant(s: SparkSession, d: str) -> DataFrame:
    return D.diff(_mapped(s, d, True).select("o_orderkey", "doc"), _mapped(s, d, False).select("o_orderkey", "doc"), "o_orderkey").update.select("o_orderkey")


@register("dlt_labelled", "SELECT o_orderkey AS k, 'insert' AS op FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 'remove' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0")
def dlt_labelled(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return D.labelled_diff(o.where("o_orderkey % 11 <> 0"), o.where("o_orderkey % 13 <> 0"), "o_orderkey").select("k", "op")


@register("dlt_constrain_variant", "SELECT o_orderkey, o_orderstatus = 'F' AS stays FROM orders")
def dlt_constrain_variant(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "orders").select("o_orderkey", F.parse_json(F.to_json(F.struct("o_orderstatus"))).alias("doc"))
    out = D.constrain(D.Delta(insert=docs), {"o_orderstatus": "F"}, "o_orderkey", doc="doc")
    return out.insert.select("o_orderkey", F.lit(True).alias("stays")).unionByName(out.remove_keys.select("o_orderkey", F.lit(False).alias("stays")))


@register("dlt_apply_only", "SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 5)")
def dlt_apply_only(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    return D.apply(o, D.Delta(update=o.withColumn("o_totalprice", F.col("o_totalprice") + 1)), "o_orderkey", only=[1, 2, 5])


_facts("dlt_guards", "n pure applicable", lambda: [(n, D.is_pure(x), D.is_applicable(x, "k")) for n, x in enumerate((None, D.Delta(), {"insert": 1}))], [(0, False, False), (1, False, True), (2, False, False)])


# Writes: what fails and why.
_ROW = "id string, n long, name string, tags array<string>, items array<struct<line:long,qty:double>>, extra map<string,string>"
_RULES = W.Ddl({".": W.ListRules("id"), "items": W.ListRules("line")})
_BAD = [
    {"type": "paint"}, {"type": "create", "data": {"n": 1}}, {"type": "create", "data": {"id": "", "n": 1}}, {"type": "create", "data": {"id": "a", "gone": 1}},
    {"type": "update", "data": {"n": "x"}, "where": {}}, {"type": "update", "data": {"n": float("inf")}, "where": {}}, {"type": "update", "data": {}, "where": {"gone": 1}},
    {"type": "inc", "path": "id", "amount": 1, "where": {}}, {"type": "inc", "path": "n", "amount": 0.5, "where": {}}, {"type": "inc", "path": "name", "amount": 1, "where": {}},
    {"type": "push", "path": "tags", "items": [1], "where": {}}, {"type": "pull", "path": "items", "items_where": 5, "where": {}},
    {"type": "delete_property", "path": "id", "where": {}}, {"type": "delete_property", "path": "gone", "where": {}}, {"type": "delete_property", "path": "items.qty", "where": {}},
    {"type": "delete_property", "path": "__proto__", "where": {}}, {"type": "array_scope", "scope": "tags", "where": {}, "action": {"type": "delete", "where": {}}},
    {"type": "array_scope", "scope": "gone", "where": {}, "action": {"type": "delete", "where": {}}}, {"type": "array_scope", "scope": "items", "where": {}, "action": {"type": "create", "data": {"qty": 1.0}}},
    {"type": "add_to_set", "path": "tags", "unique_by": "pk", "items": ["a"], "where": {}}, {"type": "delete", "where": {}},
]
_facts("wr_static_errors", "n type reason", lambda: [(n, e["type"], e.get("reason", "")) for n, p in enumerate(_BAD) for e in W.validate_action(W.WriteAction(p, str(n)), _type(_ROW), _RULES)], [
    (0, "custom", ""), (1, "missing_key", ""), (2, "missing_key", ""), (3, "schema", ""), (4, "schema", ""), (5, "invalid_data_value", "non_finite"), (6, "invalid_filter", "unknown_field"),
    (7, "invalid_property_path", "primary_key"), (8, "schema", ""), (9, "custom", ""), (10, "schema", ""), (11, "invalid_filter", "malformed"), (12, "invalid_property_path", "primary_key"),
    (13, "invalid_property_path", "unknown_path"), (14, "invalid_property_path", "crosses_array"), (15, "invalid_property_path", "disallowed_segment"), (16, "invalid_scope", "not_an_object_array"),
    (17, "invalid_scope", "unknown_path"), (18, "missing_key", ""), (19, "custom", ""),
])
_facts("wr_unsafe_schema", "type", lambda: [(e["type"],) for e in W.validate_action(W.WriteAction({"type": "delete", "where": {}}, "u"), _type("id string, raw binary"), _RULES)], [("custom",)])
_facts("wr_written_paths", "n path", lambda: [(n, x) for n, p in enumerate(({"type": "update", "data": {"a": {"b": 1}, "c.d": 2}, "where": {}}, {"type": "inc", "path": "n", "amount": 1, "where": {}}, {"type": "array_scope", "scope": "items", "where": {}, "action": {"type": "update", "data": {"qty": 1}, "where": {}}}, {"type": "delete", "where": {}})) for x in W.written_paths(W.WriteAction(p, "u"))],
       [(0, "a.b"), (0, "c\\.d"), (1, "n"), (2, "items.qty")])

_PLAIN = ("o_orderkey", "o_orderstatus", "o_totalprice")
_O = "(SELECT 'O' || o_orderkey AS o_orderkey, o_orderstatus, o_totalprice FROM orders)"


def _plain(s: SparkSession, d: str) -> DataFrame:
    return _lettered(table(s, d, "orders").select(*_PLAIN))


def _batch(s: SparkSession, d: str, payloads: list[dict], options: W.Options = W.Options(), check=None, uuids: list[str] | None = None) -> W.WriteResult:
    actions = [W.WriteAction(p, uuids[i] if uuids else f"u{i}") for i, p in enumerate(payloads)]
    return W.write(actions, _plain(s, d), _DDL, options, check)


def _outcomes(s: SparkSession, r: W.WriteResult) -> DataFrame:
    return s.createDataFrame([(o.action.uuid, o.ok, o.affected, o.error["type"] if o.error else "", o.unrecoverable) for o in r.actions], "uuid string, ok boolean, affected long, error string, final boolean")


_INC = {"type": "inc", "path": "o_totalprice", "amount": 1, "where": {"o_orderstatus": "F"}}
_TAKEN = {"type": "create", "data": {"o_orderkey": "O1", "o_orderstatus": "N", "o_totalprice": 1.0}}
_HALTS = [_INC, _TAKEN, {"type": "delete", "where": {}}]
_OUTCOMES = "SELECT 'u0' AS uuid, true AS ok, count(*) FILTER (o_orderstatus = 'F') AS affected, '' AS error, false AS final FROM orders UNION ALL VALUES ('u1', false, 0, 'create_duplicated_key', true), ('u2', false, 0, 'blocked', false)"
QUERIES["wr_halt"], SQL["wr_halt"] = (lambda s, d: _outcomes(s, _batch(s, d, _HALTS))), _OUTCOMES
QUERIES["wr_halt_rows"], SQL["wr_halt_rows"] = (lambda s, d: _batch(s, d, _HALTS).changes.final_items), f"SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM {_O} o"
QUERIES["wr_atomic_rows"], SQL["wr_atomic_rows"] = (lambda s, d: _batch(s, d, _HALTS, W.Options(atomic=True)).changes.final_items), f"SELECT * FROM {_O} o"
QUERIES["wr_atomic"], SQL["wr_atomic"] = (lambda s, d: _outcomes(s, _batch(s, d, _HALTS, W.Options(atomic=True)))), "SELECT * FROM (VALUES ('u1', false, 0, 'create_duplicated_key', true), ('u2', false, 0, 'blocked', false)) t(uuid, ok, affected, error, final)"
QUERIES["wr_create_always_update"] = lambda s, d: _batch(s, d, [_TAKEN], W.Options(duplicate_create="always-update")).changes.final_items
SQL["wr_create_always_update"] = f"SELECT o_orderkey, CASE WHEN o_orderkey = 'O1' THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = 'O1' THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM {_O} o"


@register("wr_create_convergent", f"SELECT * FROM {_O} o")
def wr_create_convergent(s: SparkSession, d: str) -> DataFrame:
    row = _plain(s, d).where("o_orderkey = 'O2'").first()
    same = {"type": "create", "data": {"o_orderkey": row[0], "o_totalprice": row[2]}}
    again = {"type": "update", "data": {"o_orderstatus": row[1]}, "where": {"o_orderkey": "O2"}}
    return _batch(s, d, [same, again], W.Options(duplicate_create="if-convergent")).changes.final_items


QUERIES["wr_uuid_conflict"] = lambda s, d: _outcomes(s, _batch(s, d, [_INC, {"type": "delete", "where": {}}, _TAKEN], uuids=["a", "a", "b"]))
SQL["wr_uuid_conflict"] = "SELECT * FROM (VALUES ('a', false, 0, 'uuid_conflict', true), ('b', false, 0, 'blocked', false)) t(uuid, ok, affected, error, final)"
QUERIES["wr_uuid_repeated"] = lambda s, d: _batch(s, d, [_INC, _INC], uuids=["a", "a"]).changes.final_items
SQL["wr_uuid_repeated"] = SQL["wr_halt_rows"]
QUERIES["wr_altered_key"] = lambda s, d: _outcomes(s, _batch(s, d, [{"type": "update", "data": {"o_orderkey": "X"}, "where": {"o_orderstatus": "F"}}]))
SQL["wr_altered_key"] = "SELECT 'u0' AS uuid, false AS ok, 0 AS affected, 'update_altered_key' AS error, true AS final"
QUERIES["wr_check"] = lambda s, d: _outcomes(s, _batch(s, d, [_INC, {"type": "update", "data": {"o_totalprice": -1}, "where": {"o_orderstatus": "P"}}], check=lambda r: r["o_totalprice"] >= 0))
SQL["wr_check"] = "SELECT 'u0' AS uuid, true AS ok, count(*) FILTER (o_orderstatus = 'F') AS affected, '' AS error, false AS final FROM orders UNION ALL VALUES ('u1', false, 0, 'schema', true)"
QUERIES["wr_no_match"] = lambda s, d: s.createDataFrame([(len(r.actions), r.ok, r.changes.changed) for r in [_batch(s, d, [{"type": "delete", "where": {"o_orderstatus": "none"}}])]], "n long, ok boolean, changed boolean")
SQL["wr_no_match"] = "SELECT 0 AS n, true AS ok, false AS changed"


@register("wr_changes", f"SELECT o_orderkey, 'update' AS op FROM {_O} o WHERE o_orderstatus = 'F' AND o_orderkey NOT LIKE '%7' UNION ALL SELECT o_orderkey, 'remove' FROM {_O} o WHERE o_orderkey LIKE '%7' UNION ALL SELECT 'new', 'insert'")
def wr_changes(s: SparkSession, d: str) -> DataFrame:
    c = _batch(s, d, [_INC, {"type": "delete", "where": {"o_orderkey": {"$regex": "7$"}}}, {"type": "create", "data": {"o_orderkey": "new"}}]).changes
    parts = [(c.insert, "insert"), (c.update, "update"), (c.remove_keys, "remove")]
    out = [p.select("o_orderkey", F.lit(op).alias("op")) for p, op in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("wr_wire", "SELECT 'u0' AS uuid, true AS ok, count(*) FILTER (o_orderstatus = 'F') AS affected FROM orders UNION ALL VALUES ('u1', false, 0), ('u2', false, 0)")
def wr_wire(s: SparkSession, d: str) -> DataFrame:
    _, _, outcomes, _ = W.result_from_wire(W.result_to_wire(_batch(s, d, _HALTS)))
    return s.createDataFrame([(o.action.uuid, o.ok, o.affected) for o in outcomes], "uuid string, ok boolean, affected long")


def _items(name: str, payload: dict, sql: str) -> None:
    """Orders with items and tags after a write, as the number of items, their quantities and the tags."""

    def run(s: SparkSession, d: str) -> DataFrame:
        out = W.write([W.WriteAction(payload, name)], _lettered(od(s, d).select("o_orderkey", "tags", "items")), _DDL).changes.final_items
        total = F.aggregate("items", F.lit(0.0), lambda a, x: a + F.coalesce(x["qty"], F.lit(0.0)))
        return out.select("o_orderkey", F.when(F.col("items").isNotNull(), F.size("items")).cast("long").alias("n"), total.alias("total"), F.array_join("tags", ",").alias("tags"))

    QUERIES[name], SQL[name] = run, f"SELECT 'O' || o_orderkey AS o_orderkey, n, total, tags FROM ({sql}) w"


_LINES = "(SELECT {} FROM lineitem l WHERE l.l_orderkey = o.o_orderkey{})"
_AGG = (
    f"SELECT o_orderkey, {{n}} AS n, {{total}} AS total, array_to_string({{tags}}, ',') AS tags FROM (SELECT o_orderkey, {_TAGS} AS t, {_LINES.format('count(*)', '')} AS c, "
    f"{_LINES.format('count(*)', ' AND l_linenumber = 1')} AS c1, {_LINES.format('CAST(sum(l_quantity) AS DOUBLE)', '')} AS q FROM orders o)"
)
_KEPT = {"n": "CASE WHEN c > 0 THEN c END", "total": "q", "tags": "t"}
_items("wr_set_by_key", {"type": "add_to_set", "path": "items", "unique_by": "pk", "items": [{"line": 1, "qty": 5}, {"line": 100, "qty": 7}], "where": {"items": {"$size": 3}}}, _AGG.format(**_KEPT | {"n": "CASE WHEN c = 3 THEN CASE WHEN c1 > 0 THEN 4 ELSE 5 END WHEN c > 0 THEN c END", "total": "CASE WHEN c = 3 THEN q + 7 + CASE WHEN c1 > 0 THEN 0 ELSE 5 END ELSE q END"}))
_items("wr_clear_property", {"type": "set_property_undefined", "path": "tags", "where": {"items": {"$size": 2}}}, _AGG.format(**_KEPT | {"tags": "CASE WHEN c = 2 THEN NULL ELSE t END"}))
_items("wr_scope_create", {"type": "array_scope", "scope": "items", "where": {"tags": "R"}, "action": {"type": "create", "data": {"line": 99, "qty": 3}}}, _AGG.format(**_KEPT | {"n": "CASE WHEN list_contains(t, 'R') THEN c + 1 WHEN c > 0 THEN c END", "total": "CASE WHEN list_contains(t, 'R') THEN q + 3 ELSE q END"}))
_items("wr_scope_inc", {"type": "array_scope", "scope": "items", "where": {}, "action": {"type": "inc", "path": "qty", "amount": 0.5, "where": {}}}, _AGG.format(**_KEPT | {"total": "q + 0.5 * c"}))


@register("wr_scope_two_levels", "SELECT c_custkey, count(l_orderkey) AS n FROM customer c LEFT JOIN orders o ON o_custkey = c_custkey LEFT JOIN lineitem l ON l_orderkey = o_orderkey AND l_quantity <= 25 GROUP BY c_custkey")
def wr_scope_two_levels(s: SparkSession, d: str) -> DataFrame:
    ddl = W.Ddl({".": W.ListRules("c_name"), "orders": W.ListRules("o_orderkey"), "orders.items": W.ListRules("line")})
    action = {"type": "array_scope", "scope": "orders.items", "where": {}, "action": {"type": "delete", "where": {"qty": {"$gt": 25}}}}
    out = W.write([W.WriteAction(action, "u")], cd(s, d).select("c_custkey", "c_name", "orders"), ddl).changes.final_items
    n = F.aggregate("orders", F.lit(0), lambda a, o: a + F.coalesce(F.size(o["items"]), F.lit(0)))
    return out.select("c_custkey", F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("long").alias("n"))


# Writes on documents.
_DOC = "o_orderkey string, o_orderstatus string, tags array<string>, items array<struct<line:int,qty:double>>"


def _docs(name: str, payload: dict, read, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))).alias("items"))
        o = _lettered(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(lines, "o_orderkey", "left"))
        docs = o.select(F.parse_json(F.to_json(F.struct("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("untyped"), F.array(F.col("o_orderstatus")).alias("tags"), "items"))).alias("doc"))
        out = W.write_documents([W.WriteAction(payload, name)], docs, "doc", _type(_DOC), _DDL).changes.final_items
        return out.select(F.try_variant_get("doc", "$.o_orderkey", "string").alias("o_orderkey"), F.try_variant_get("doc", "$.untyped", "double").alias("untyped"), read(F.col("doc")).alias("value"))

    QUERIES[name], SQL[name] = run, f"SELECT 'O' || o_orderkey AS o_orderkey, o_totalprice AS untyped, value FROM ({sql}) w"


_docs("wr_doc_update", {"type": "update", "data": {"o_orderstatus": "Z"}, "where": {"o_orderstatus": "F"}}, lambda c: F.try_variant_get(c, "$.o_orderstatus", "string"), "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'Z' ELSE o_orderstatus END AS value FROM orders")
_docs("wr_doc_push", {"type": "push", "path": "tags", "items": ["x", "y"], "where": {"o_orderstatus": {"$ne": "O"}}}, lambda c: F.array_join(F.try_variant_get(c, "$.tags", "array<string>"), ","), "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus || ',x,y' ELSE o_orderstatus END AS value FROM orders")
_docs("wr_doc_scope", {"type": "array_scope", "scope": "items", "where": {}, "action": {"type": "update", "data": {"qty": 0}, "where": {"line": 1}}}, lambda c: F.aggregate(F.try_variant_get(c, "$.items", "array<struct<qty:double>>"), F.lit(0.0), lambda a, x: a + x["qty"]),
      "SELECT o_orderkey, o_totalprice, CAST(sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END) AS DOUBLE) AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice")


# Deep maps on maps and Variants.
def _shelf(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("other"), F.col("c_mktsegment"))
    return c.select("c_custkey", m.alias("m"), F.parse_json(F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.array(F.struct(F.col("c_mktsegment").alias("segment"))).alias("l")))).alias("doc"))


@register("map_replace_map", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS segment, c_mktsegment AS other FROM customer")
def map_replace_map(s: SparkSession, d: str) -> DataFrame:
    out = map_deep(_shelf(s, d).drop("doc"), [ReplaceValue("BUILDING", "HOUSES", Target(key="segment"))])
    return out.select("c_custkey", F.col("m")["segment"].alias("segment"), F.col("m")["other"].alias("other"))


@register("map_keys_of_maps", "SELECT c_custkey, 'kind' AS keys FROM customer")
def map_keys_of_maps(s: SparkSession, d: str) -> DataFrame:
    out = map_deep(_shelf(s, d).drop("doc"), [RemoveKey(Target(search_key="oth")), RenameKey(Target(path="m.segment"), "kind")])
    return out.select("c_custkey", F.array_join(F.map_keys("m"), ",").alias("keys"))


@register("map_variant", "SELECT c_custkey, 'X' || substr(c_mktsegment, 2) AS a, 'X' || substr(c_mktsegment, 2) AS b FROM customer WHERE starts_with(c_mktsegment, 'B')")
def map_variant(s: SparkSession, d: str) -> DataFrame:
    out = map_deep(_shelf(s, d).drop("m"), [ReplaceInString("B", "X", Target(key="segment"))])
    out = out.select("c_custkey", F.try_variant_get("doc", "$.segment", "string").alias("a"), F.try_variant_get("doc", "$.l[0].segment", "string").alias("b"))
    return filter_rows(out, {"a": {"$regex": "^XU"}})


@register("path_flatten_deep", "SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation")
def path_flatten_deep(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.struct(F.col("n_nationkey").alias("a"), F.struct(F.struct(F.col("n_name").alias("b")).alias("y"), F.col("n_regionkey").alias("c")).alias("x")).alias("r"))
    flat = flatten_columns(n)
    return flat.select(*[F.col(f"`{x}`").alias(x.split(".")[-1]) for x in flat.columns])
