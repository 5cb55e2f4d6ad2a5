"""The engine's own queries over the test tables, each with equivalent SQL.

Document frames: ``OD`` is orders with their line items nested, ``CD`` customers with nested orders with nested items
(two levels of arrays), ``EV`` events with their properties as a Variant.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.paths import flatten_columns, leaves
from docloom.operators import delta as D
from docloom.operators.deep_map import RemoveKey, RenameKey, ReplaceInString, ReplaceValue, Target, map_deep
from docloom.operators.filter import filter_rows
from docloom.operators.page import Boundary, Slice, SortKey, query
from docloom.operators.write import Ddl, ListRules, WriteAction, covering_filter, write
from docloom.sources.tables import ColumnTable, ObjectTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def od(s: SparkSession, d: str) -> DataFrame:
    """Orders with ``items`` and ``tags``; orders without a line have neither. One shuffle by the order's key."""
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("disc"))
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(item).alias("items"), F.array_sort(F.collect_set("l_returnflag")).alias("tags"))
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return orders.join(lines, "o_orderkey", "left")


def cd(s: SparkSession, d: str) -> DataFrame:
    order = F.struct("o_orderkey", "o_totalprice", "o_orderstatus", "items")
    own = od(s, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(order).alias("orders"))
    return table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").join(own, "c_custkey", "left")


def ev(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "event_type", F.parse_json("props").alias("props"))


def nullable(s: SparkSession, d: str) -> DataFrame:
    """Orders with values missing in a seventh of the rows."""
    o = table(s, d, "orders")
    gap = lambda c, m: F.when(F.col("o_orderkey") % 7 != m, F.col(c)).alias(c)
    return o.select("o_orderkey", gap("o_orderstatus", 0), gap("o_totalprice", 1), gap("o_orderpriority", 2))


_N = (
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 <> 1 THEN o_totalprice END AS o_totalprice, "
    "CASE WHEN o_orderkey % 7 <> 2 THEN o_orderpriority END AS o_orderpriority FROM orders)"
)
_ITEM = "(SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND {})"
_TAGS = "(SELECT list(DISTINCT l_returnflag ORDER BY l_returnflag) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"


def _on(name: str, frame, f: dict, keep: list[str], sql: str) -> None:
    QUERIES[name] = lambda s, d: filter_rows(frame(s, d), f).select(*keep)
    SQL[name] = sql


def _nullable(name: str, f: dict, where: str) -> None:
    keep = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    _on(name, nullable, f, keep, f"SELECT {', '.join(keep)} FROM {_N} n WHERE {where}")


def _orders(name: str, f: dict, where: str) -> None:
    _on(name, od, f, ["o_orderkey", "o_totalprice"], f"SELECT o_orderkey, o_totalprice FROM orders o WHERE {where}")


@register(
    "flagship",
    f"SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice >= 1000 AND EXISTS {_ITEM.format(chr(39).join(['l_quantity > 45 AND l_returnflag = ', 'R', '']))} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def flagship(s: SparkSession, d: str) -> DataFrame:
    f = {"o_totalprice": {"$gte": 1000}, "items": {"$elemMatch": {"qty": {"$gt": 45}, "flag": "R"}}}
    return query(od(s, d), f, Slice((SortKey("o_totalprice", -1),), limit=20), "o_orderkey").select("o_orderkey", "o_totalprice")


# Filters on scalars, with values missing.
_nullable("flt_scalar", {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
_nullable("flt_bool_logic", {"o_orderstatus": "F", "$or": [{"o_totalprice": {"$gt": 200000}}, {"o_orderpriority": "1-URGENT"}], "$nor": [{"o_totalprice": {"$lt": 1000}}]},
          "o_orderstatus = 'F' AND (coalesce(o_totalprice > 200000, false) OR coalesce(o_orderpriority = '1-URGENT', false)) AND NOT coalesce(o_totalprice < 1000, false)")
_nullable("flt_empty_and", {"$and": []}, "true")
_nullable("flt_empty_or", {"$or": []}, "false")
_nullable("flt_empty_nor", {"$nor": []}, "true")
_nullable("flt_empty_filter", {}, "true")
_nullable("flt_eq", {"o_orderstatus": {"$eq": "O"}}, "o_orderstatus = 'O'")
_nullable("flt_ne", {"o_orderstatus": {"$ne": "O"}}, "o_orderstatus IS DISTINCT FROM 'O'")
_nullable("flt_in", {"o_orderstatus": {"$in": ["O", "P", 5]}}, "o_orderstatus IN ('O', 'P')")
_nullable("flt_nin", {"o_orderstatus": {"$nin": ["O", "P"]}}, "NOT coalesce(o_orderstatus IN ('O', 'P'), false)")
_nullable("flt_empty_in", {"o_orderstatus": {"$in": []}}, "false")
_nullable("flt_empty_nin", {"o_orderstatus": {"$nin": []}}, "true")
_nullable("flt_range_num", {"o_totalprice": {"$gte": 1000, "$lt": 50000}}, "o_totalprice >= 1000 AND o_totalprice < 50000")
_nullable("flt_range_str", {"o_orderpriority": {"$gt": "2", "$lte": "4-NOT SPECIFIED"}}, "o_orderpriority > '2' AND o_orderpriority <= '4-NOT SPECIFIED'")
_nullable("flt_type_bracket", {"o_totalprice": {"$gt": "1000"}}, "false")
_nullable("flt_null", {"o_orderstatus": None}, "o_orderstatus IS NULL")
_nullable("flt_exists", {"o_orderstatus": {"$exists": True}}, "o_orderstatus IS NOT NULL")
_nullable("flt_not_exists", {"o_orderstatus": {"$exists": False}}, "o_orderstatus IS NULL")
_nullable("flt_type", {"o_totalprice": {"$type": "number"}, "o_orderstatus": {"$type": "string"}}, "o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL")
_nullable("flt_not", {"o_totalprice": {"$not": {"$gt": 100000}}}, "NOT coalesce(o_totalprice > 100000, false)")
_nullable("flt_not_not", {"o_orderstatus": {"$not": {"$ne": "F"}}}, "o_orderstatus = 'F'")
_nullable("flt_not_missing", {"gone": {"$not": {"$gt": 1}}}, "true")
_nullable("flt_regex_anchor", {"o_orderpriority": {"$regex": "^[12]-"}}, "regexp_matches(o_orderpriority, '^[12]-')")
_nullable("flt_regex_i", {"o_orderpriority": {"$regex": "urgent|LOW$", "$options": "i"}}, "regexp_matches(o_orderpriority, 'urgent|LOW$', 'i')")
_on("flt_regex", lambda s, d: table(s, d, "documents"), {"text": {"$regex": "[Ll]icensed under"}}, ["doc_id"], "SELECT doc_id FROM documents WHERE regexp_matches(text, '[Ll]icensed under')")

# Filters on arrays.
_orders("flt_size", {"tags": {"$size": 2}}, f"coalesce(len({_TAGS}) = 2, false)")
_orders("flt_all", {"tags": {"$all": ["R", "N"]}}, f"coalesce(list_has_all({_TAGS}, ['R', 'N']), false)")
_orders("flt_all_empty", {"tags": {"$all": []}}, "EXISTS " + _ITEM.format("true"))
_orders("flt_contains", {"tags": "A"}, "EXISTS " + _ITEM.format("l_returnflag = 'A'"))
_orders("flt_exact_array", {"tags": ["A", "N"]}, f"coalesce({_TAGS} = ['A', 'N'], false)")
_orders("flt_elem_eq", {"items.qty": 50}, "EXISTS " + _ITEM.format("l_quantity = 50"))
_orders("flt_elem_ne", {"items.qty": {"$ne": 50}}, "NOT EXISTS " + _ITEM.format("l_quantity = 50"))
_orders("flt_elem_range", {"tags": {"$gt": "M", "$lt": "B"}}, "EXISTS " + _ITEM.format("l_returnflag > 'M'") + " AND EXISTS " + _ITEM.format("l_returnflag < 'B'"))
_orders("flt_elemmatch_obj", {"items": {"$elemMatch": {"qty": {"$gt": 45}, "$or": [{"flag": "R"}, {"disc": 0.1}]}}}, "EXISTS " + _ITEM.format("l_quantity > 45 AND (l_returnflag = 'R' OR l_discount = 0.1)"))
_orders("flt_elemmatch_scalar", {"tags": {"$elemMatch": {"$gt": "A", "$lt": "R"}}}, "EXISTS " + _ITEM.format("l_returnflag > 'A' AND l_returnflag < 'R'"))
_orders("flt_compound_obj", {"items": {"flag": "R", "line": 1}}, "EXISTS " + _ITEM.format("l_returnflag = 'R' AND l_linenumber = 1"))
_orders("flt_not_size", {"tags": {"$not": {"$size": 1}}}, f"NOT coalesce(len({_TAGS}) = 1, false)")
_orders("flt_array_missing", {"items": None}, "NOT EXISTS " + _ITEM.format("true"))
_orders("flt_spread", {"items.flag": {"$in": ["R"]}}, "EXISTS " + _ITEM.format("l_returnflag = 'R'"))
_orders("flt_spread_negation", {"items.flag": {"$nin": ["R", "A"]}}, "NOT EXISTS " + _ITEM.format("l_returnflag IN ('R', 'A')"))

_DEEP = "(SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = c.c_custkey AND {})"
_on("flt_spread_two_level", cd, {"orders.items.flag": "R", "orders.items.qty": {"$gt": 49}}, ["c_custkey", "c_name"],
    f"SELECT c_custkey, c_name FROM customer c WHERE EXISTS {_DEEP.format(chr(39).join(['l_returnflag = ', 'R', '']))} AND EXISTS {_DEEP.format('l_quantity > 49')}")
_on("flt_leaf_scope", cd, {"orders.items.qty": {"$gt": 48, "$lt": 50}}, ["c_custkey"], f"SELECT c_custkey FROM customer c WHERE EXISTS {_DEEP.format('l_quantity > 48 AND l_quantity < 50')}")
_on("flt_spread_deep_negation", cd, {"orders.items.qty": {"$not": {"$gte": 48}}}, ["c_custkey"], f"SELECT c_custkey FROM customer c WHERE NOT EXISTS {_DEEP.format('l_quantity >= 48')}")

# Variants.
_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_on("flt_variant_eq", ev, {"props.k": 7}, ["event_id"], f"SELECT event_id FROM events WHERE {_K} = 7")
_on("flt_variant_range", ev, {"props.k": {"$gte": 10, "$lt": 20}}, ["event_id"], f"SELECT event_id FROM events WHERE {_K} >= 10 AND {_K} < 20")
_on("flt_variant_type", ev, {"props": {"$type": "object"}, "props.k": {"$type": "number"}, "props.gone": {"$exists": False}}, ["event_id"], "SELECT event_id FROM events WHERE json_type(props) = 'OBJECT' AND json_extract(props, '$.k') IS NOT NULL")
_on("flt_variant_deep_eq", ev, {"props": {"k": 3}}, ["event_id"], f"SELECT event_id FROM events WHERE {_K} = 3")


@register("src_object_table", f"SELECT event_id FROM events WHERE {_K} > 90 ORDER BY {_K} DESC, event_id LIMIT 25")
def src_object_table(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    doc = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"p":'), F.col("props"), F.lit("}"))
    t = ObjectTable(e.select("event_id", doc.alias("doc")), "doc", "id")
    return t.query({"p.k": {"$gt": 90}}, Slice((SortKey("p.k", -1),), limit=25)).select("event_id")


@register("src_column_table", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal, c_custkey LIMIT 15")
def src_column_table(s: SparkSession, d: str) -> DataFrame:
    return ColumnTable(table(s, d, "customer"), "c_custkey", ("c_custkey", "c_acctbal")).query({"c_acctbal": {"$gt": 0}}, Slice((SortKey("c_acctbal"),), limit=15))


# Sorting and paging.
def _page(name: str, s_: Slice, f: dict | None, sql: str) -> None:
    keep = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    QUERIES[name] = lambda s, d: query(nullable(s, d), f, s_, "o_orderkey").select(*keep)
    SQL[name] = f"SELECT {', '.join(keep)} FROM {_N} n {sql}"


_S = (SortKey("o_orderpriority", -1), SortKey("o_totalprice"))
_ORDER = "ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey"
_page("srt_multi", Slice(_S, limit=50), None, f"{_ORDER} LIMIT 50")
_page("srt_nulls_last_desc", Slice((SortKey("o_totalprice", -1),), offset=100, limit=40), {"o_orderstatus": "F", "o_totalprice": {"$not": {"$gt": 30000}}}, "WHERE o_orderstatus = 'F' AND NOT coalesce(o_totalprice > 30000, false) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 100")
_page("pg_offset", Slice(_S, limit=30, offset=200), {"o_orderstatus": "O"}, f"WHERE o_orderstatus = 'O' {_ORDER} LIMIT 30 OFFSET 200")
_page("pg_limit_zero", Slice(_S, limit=0), None, "WHERE false")
_page("pg_after_pk_stale", Slice(_S, limit=10, after_pk=-5), None, "WHERE false")
_AFTER = ("(o_orderpriority < a.p OR o_orderpriority IS NULL OR (o_orderpriority = a.p AND (o_totalprice > a.t OR o_totalprice IS NULL OR (o_totalprice = a.t AND o_orderkey > a.k))))")
_page("pg_boundary", Slice(_S, limit=30, after_boundary=Boundary(("3-MEDIUM", 50000.5), 77)), None, f", (SELECT '3-MEDIUM' AS p, 50000.5 AS t, 77 AS k) a WHERE {_AFTER} {_ORDER} LIMIT 30")
_page("pg_boundary_null", Slice(_S, limit=30, after_boundary=Boundary((None, 100000.0), 5)), None, f"WHERE o_orderpriority IS NULL AND (o_totalprice > 100000 OR o_totalprice IS NULL OR (o_totalprice = 100000 AND o_orderkey > 5)) {_ORDER} LIMIT 30")
_page("pg_after_pk", Slice((SortKey("o_orderstatus"),), limit=30, after_pk=15), None, "WHERE o_orderstatus > (SELECT o_orderstatus FROM orders WHERE o_orderkey = 15) OR o_orderstatus IS NULL OR (o_orderstatus = (SELECT o_orderstatus FROM orders WHERE o_orderkey = 15) AND o_orderkey > 15) ORDER BY o_orderstatus NULLS LAST, o_orderkey LIMIT 30")


@register("srt_codepoint", "SELECT p_partkey, p_name FROM part ORDER BY p_name DESC, p_partkey LIMIT 40")
def srt_codepoint(s: SparkSession, d: str) -> DataFrame:
    return query(table(s, d, "part").select("p_partkey", "p_name"), None, Slice((SortKey("p_name", -1),), limit=40), "p_partkey")


# Paths.
@register("path_leaves", "SELECT o_orderkey, CAST(count(l_quantity) AS BIGINT) AS n_leaves, coalesce(sum(l_quantity), 0) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def path_leaves(s: SparkSession, d: str) -> DataFrame:
    df = od(s, d)
    found = df.select("o_orderkey", leaves(F.col("items"), df.schema["items"].dataType, "qty").alias("q"))
    return found.select("o_orderkey", F.size(F.coalesce("q", F.array().cast("array<double>"))).cast("long").alias("n_leaves"), F.coalesce(F.aggregate("q", F.lit(0.0), lambda a, x: a + x), F.lit(0.0)).alias("total"))


@register("path_flatten", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def path_flatten(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("x")).alias("r"))
    flat = flatten_columns(c)
    return flat.select(*[F.col(f"`{n}`").alias(n.split(".")[-1]) for n in flat.columns])


# Change sets. The older snapshot lacks some orders and has other prices in some.
_CUR = "(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)"
_OLD = "(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0)"


def _current(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where("o_orderkey % 11 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _previous(s: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return table(s, d, "orders").where("o_orderkey % 13 <> 0").select("o_orderkey", "o_orderstatus", price.alias("o_totalprice"))


def _labelled(delta: D.Delta, pk: str) -> DataFrame:
    out = delta.remove_keys.select(F.col(pk), F.lit(None).cast("string").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"), F.lit("remove").alias("op"))
    for name in ("insert", "update", "upsert"):
        part = getattr(delta, name)
        if part is not None:
            out = out.unionByName(part.withColumn("op", F.lit(name)))
    return out


@register(
    "dlt_diff",
    f"SELECT coalesce(c.o_orderkey, p.o_orderkey) AS o_orderkey, c.o_orderstatus, c.o_totalprice, CASE WHEN p.o_orderkey IS NULL THEN 'insert' WHEN c.o_orderkey IS NULL THEN 'remove' ELSE 'update' END AS op "
    f"FROM {_CUR} c FULL JOIN {_OLD} p ON c.o_orderkey = p.o_orderkey WHERE c.o_orderkey IS NULL OR p.o_orderkey IS NULL OR c.o_totalprice <> p.o_totalprice OR c.o_orderstatus <> p.o_orderstatus",
)
def dlt_diff(s: SparkSession, d: str) -> DataFrame:
    return _labelled(D.diff(_current(s, d), _previous(s, d), "o_orderkey"), "o_orderkey")


@register("dlt_apply", f"SELECT * FROM {_CUR} c")
def dlt_apply(s: SparkSession, d: str) -> DataFrame:
    old = _previous(s, d)
    return D.apply(old, D.diff(_current(s, d), old, "o_orderkey"), "o_orderkey")


@register(
    "dlt_reduce",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, "
    "CASE WHEN o_orderkey % 6 = 0 THEN 'remove' WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN 'upsert' WHEN o_orderkey % 4 = 0 THEN 'insert' ELSE 'update' END AS op FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 6 = 0",
)
def dlt_reduce(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    third = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    deltas = [D.Delta(remove_keys=o.where("o_orderkey % 6 = 0").select("o_orderkey"), created_at="3##1"), D.Delta(update=third, created_at=2), D.Delta(insert=o.where("o_orderkey % 4 = 0"), created_at=1)]
    return _labelled(D.reduce(deltas, "o_orderkey"), "o_orderkey")


@register("dlt_constrain", f"SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS o_totalprice, CASE WHEN o_totalprice > 100000 THEN 'insert' ELSE 'remove' END AS op FROM {_CUR} c")
def dlt_constrain(s: SparkSession, d: str) -> DataFrame:
    delta = D.diff(_current(s, d), None, "o_orderkey")
    out = D.constrain(delta, {"o_totalprice": {"$gt": 100000}}, "o_orderkey")
    return _labelled(D.Delta(out.insert, None, None, out.remove_keys), "o_orderkey")


# Writes.
_DDL = Ddl({".": ListRules("o_orderkey"), "items": ListRules("line")})
_FLAT = "o_orderkey, o_orderstatus, o_totalprice"


def _lettered(df: DataFrame) -> DataFrame:
    """Keys as text: the tables hold the key 0, and a falsy key counts as none."""
    return df.withColumn("o_orderkey", F.concat(F.lit("O"), F.col("o_orderkey")))


def _written(name: str, payloads: list[dict], sql: str) -> None:
    sql = sql.replace("FROM orders", "FROM (SELECT 'O' || o_orderkey AS o_orderkey, o_orderstatus, o_totalprice FROM orders) o")

    def run(s: SparkSession, d: str) -> DataFrame:
        items = _lettered(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
        return write([WriteAction(p, f"{name}-{i}") for i, p in enumerate(payloads)], items, _DDL).changes.final_items

    QUERIES[name], SQL[name] = run, sql


_written("wr_create", [{"type": "create", "data": {"o_orderkey": "new", "o_orderstatus": "X", "o_totalprice": 1.5}}], f"SELECT {_FLAT} FROM orders UNION ALL SELECT 'new', 'X', 1.5")
_written("wr_update_merge", [{"type": "update", "data": {"o_orderstatus": "Z"}, "where": {"o_totalprice": {"$lt": 50000}}}], "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
_written("wr_update_assign", [{"type": "update", "method": "assign", "data": {"o_orderstatus": None}, "where": {"o_orderstatus": "P"}}], "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders")
_written("wr_delete", [{"type": "delete", "where": {"o_orderstatus": {"$ne": "F"}}}], f"SELECT {_FLAT} FROM orders WHERE o_orderstatus = 'F'")
_written("wr_inc", [{"type": "inc", "path": "o_totalprice", "amount": 10, "where": {"o_orderstatus": "O"}}], "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders")
_written("wr_delete_property", [{"type": "delete_property", "path": "o_orderstatus", "where": {"o_totalprice": {"$gt": 100000}}}], "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
_written(
    "wr_chain",
    [{"type": "update", "data": {"o_orderstatus": "Z"}, "where": {"o_totalprice": {"$lt": 50000}}}, {"type": "inc", "path": "o_totalprice", "amount": 1, "where": {"o_orderstatus": "Z"}}, {"type": "delete", "where": {"o_orderstatus": "F"}}],
    "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice < 50000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_totalprice < 50000 OR o_orderstatus <> 'F'",
)


def _nested(name: str, payload: dict, column: str, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = write([WriteAction(payload, name)], _lettered(od(s, d).select("o_orderkey", "tags", "items")), _DDL).changes.final_items
        value = F.array_join("tags", ",") if column == "tags" else F.aggregate("items", F.lit(0.0), lambda a, x: a + x["qty"])
        return out.select("o_orderkey", value.alias("value"))

    QUERIES[name], SQL[name] = run, f"SELECT 'O' || o_orderkey AS o_orderkey, value FROM ({sql}) w"


def _tag_sql(expr: str) -> str:
    return f"SELECT o_orderkey, array_to_string({expr}, ',') AS value FROM (SELECT o_orderkey, {_TAGS} AS t FROM orders o)"


_nested("wr_push", {"type": "push", "path": "tags", "items": ["R", "Q"], "where": {}}, "tags", _tag_sql("list_concat(coalesce(t, []), ['R', 'Q'])"))
_nested("wr_pull", {"type": "pull", "path": "tags", "items_where": ["R", "A"], "where": {}}, "tags", "SELECT o_orderkey, CASE WHEN t IS NOT NULL THEN coalesce(array_to_string(list_filter(t, lambda x: x NOT IN ('R', 'A')), ','), '') END AS value FROM (SELECT o_orderkey, " + _TAGS + " AS t FROM orders o)")
_nested("wr_add_to_set", {"type": "add_to_set", "path": "tags", "items": ["R", "Q"], "where": {"tags": "N"}}, "tags",
        _tag_sql("CASE WHEN list_contains(t, 'N') THEN list_concat(t, CASE WHEN list_contains(t, 'R') THEN [] ELSE ['R'] END, ['Q']) ELSE t END"))
_nested("wr_scope_update", {"type": "array_scope", "scope": "items", "where": {}, "action": {"type": "update", "data": {"qty": 0}, "where": {"flag": "R"}}}, "items",
        "SELECT o_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS DOUBLE) AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
_nested("wr_scope_delete", {"type": "array_scope", "scope": "items", "where": {}, "action": {"type": "delete", "where": {"qty": {"$gt": 25}}}}, "items",
        "SELECT o_orderkey, CASE WHEN count(l_orderkey) > 0 THEN CAST(coalesce(sum(CASE WHEN l_quantity <= 25 THEN l_quantity END), 0) AS DOUBLE) END AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")


@register("wr_cover_filter", f"SELECT {_FLAT} FROM orders WHERE o_orderkey = 3 OR o_orderstatus = 'P' OR o_totalprice < 2000")
def wr_cover_filter(s: SparkSession, d: str) -> DataFrame:
    batch = [{"type": "create", "data": {"o_orderkey": 3}}, {"type": "delete", "where": {"o_orderstatus": "P"}}, {"type": "inc", "path": "o_totalprice", "amount": 1, "where": {"o_totalprice": {"$lt": 2000}}}]
    f = covering_filter([WriteAction(p, str(i)) for i, p in enumerate(batch)], _DDL)
    return filter_rows(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), f)


# Deep maps.
@register("map_replace", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment, replace(c_name, 'Customer', 'Client') AS c_name FROM customer")
def map_replace(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return map_deep(c, [ReplaceValue("BUILDING", "HOUSES"), ReplaceInString(re.compile("Customer"), "Client", Target(search_key="name"))])


@register("map_rename", "SELECT c_custkey AS id, c_name FROM customer")
def map_rename(s: SparkSession, d: str) -> DataFrame:
    return map_deep(table(s, d, "customer").select("c_custkey", "c_name"), [RenameKey(Target(key="c_custkey"), "id")])


@register("map_remove", "SELECT c_custkey, c_name FROM customer")
def map_remove(s: SparkSession, d: str) -> DataFrame:
    return map_deep(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), [RemoveKey(Target(search_key=re.compile("mkt|bal")), all=True)])


from docloom.plans import catalogue_rules  # noqa: E402, F401 - it adds its queries to the same tables
