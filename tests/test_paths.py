import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import schema as S
from docloom.functions.paths import PathError, escape_segment, flatten_columns, join_path, kind_of, leaves, parse_path, path_kinds, read, read_or, resolve, schema_at, schema_tree, set_value
from docloom.operators.delta import Delta, is_applicable, is_pure
from docloom.plans.compiler import balanced, paths_of, try_compile
from docloom.plans.predicate import ARRAY_ONLY, BROADENING, EITHER, VALUE_ONLY, FilterError, bad_values, check_strict, is_filter_list, is_logic_filter, is_partial_filter, translate_regex

_INT, _TEXT = T.IntegerType(), T.StringType()
_C = T.StructType([T.StructField("d", _TEXT), T.StructField("e", T.ArrayType(T.ArrayType(_INT)))])
SCHEMA = T.StructType([
    T.StructField("id", _TEXT), T.StructField("a.b", _INT), T.StructField("a", T.StructType([T.StructField("b", T.DoubleType()), T.StructField("c", T.ArrayType(_C))])),
    T.StructField("m", T.MapType(_TEXT, T.StructType([T.StructField("v", _INT)]))), T.StructField("v", T.VariantType()),
])


def test_segments():
    assert parse_path("a.b\\.c.d") == ["a", "b.c", "d"] and parse_path("a\\b") == ["a\\b"] and parse_path("") == [""]
    for s in ("x", "x.y", "..", "a\\"):
        assert parse_path(escape_segment(s)) == [s] or s.endswith("\\")
    assert join_path("a", "", "b.c") == "a.b\\.c"


def test_resolution():
    assert resolve("a\\.b", SCHEMA).dtype == T.IntegerType() and resolve("a.b", SCHEMA).dtype == T.DoubleType()
    assert resolve("a.c.d", SCHEMA).arrays == 1 and resolve("m.anything.v", SCHEMA).record and resolve("v.x.y", SCHEMA).known
    assert not resolve("a.x", SCHEMA).known and not resolve("__proto__", SCHEMA).known
    assert schema_at("a.c", SCHEMA, unwrap_array=True).simpleString().startswith("struct")
    assert path_kinds(SCHEMA) | {"m.*.v": "number"} == path_kinds(SCHEMA) and schema_tree(SCHEMA).kind == "object"
    assert [kind_of(t) for t in (T.DateType(), T.BinaryType())] == ["time", "other"]


def test_reading_and_setting(spark):
    df = spark.createDataFrame([("1", {"b": 1.0, "c": [{"d": "x", "e": [[1], [2, 3]]}, {"d": None, "e": None}]}), ("2", None)], "id string, a struct<b:double,c:array<struct<d:string,e:array<array<int>>>>>")
    assert [r[0] for r in df.select(read(df, "a.b")).collect()] == [1.0, None]
    assert [r[0] for r in df.select(read_or(df, "a.b", 7.0)).collect()] == [1.0, 7.0]
    assert [r[0] for r in df.select(read(df, "a.nope")).collect()] == [None, None]
    t = df.schema["a"].dataType
    assert df.select(leaves(F.col("a"), t, "c.d")).first()[0] == ["x"]
    with pytest.raises(PathError):
        leaves(F.col("a"), t, "c.zz")
    out = set_value(df, "a.b", F.lit(5)).select("a.b").collect()
    assert [r[0] for r in out] == [5.0, 5.0]  # the missing parent was built
    assert flatten_columns(df).columns == ["id", "a.b", "a.c"]


def test_declared_shapes(spark):
    field = lambda name, **m: T.StructField(name, T.VariantType(), True, m)
    s = T.StructType([field("x", union=["array<int>", "string"]), field("y", union=["int", "string"]), field("z", normalizes=True), T.StructField("raw", T.BinaryType())])
    assert S.shape_ambiguous_paths(s) == ["x"] and S.multi_scalar_paths(s) == ["y"] and S.normalizing_paths(s) == ["z"] and S.unsafe_fields(s) == [("raw", "binary")]
    assert [e.kind for e in try_compile({"x": 1, "$or": [{"z": 1}]}, s, conform=True)[1]] == ["schema_ambiguous", "schema_normalizes"]
    assert try_compile({"x": {"$foo": 1}}, s)[1][0].kind == "filter" and paths_of({"$and": [{"a": 1}], "b": 2}) == ["a", "b"]
    assert S.unwrapped(SCHEMA["a"].dataType["c"].dataType) == S.element_type(SCHEMA["a"].dataType["c"].dataType)
    assert S.is_record(SCHEMA["m"].dataType) and S.shape(SCHEMA["m"].dataType) == {} and S.value_type(SCHEMA["m"].dataType).names == ["v"]


def test_guards_and_registry(spark):
    assert is_logic_filter({"$or": []}) and not is_logic_filter({"$or": 1}) and is_partial_filter({"a": 1}) and is_filter_list([{}, {"a": 1}]) and not is_filter_list([1])
    with pytest.raises(FilterError):
        check_strict({"$or": []})
    assert not VALUE_ONLY & ARRAY_ONLY and not (VALUE_ONLY | ARRAY_ONLY) & EITHER and BROADENING <= VALUE_ONLY | EITHER
    loop: list = []
    loop.append(loop)
    assert [w for _, w in bad_values({"a": [1, float("nan"), {1}], "b": loop})] == ["non_finite", "not_json", "cycle"]
    df = spark.createDataFrame([("1",)], "id string")
    assert is_pure(Delta(df, df, None, df, 1)) and not is_pure(Delta(df)) and is_applicable(Delta(df), "id") and not is_applicable(Delta(df), "k")


def test_wide_filters_stay_shallow(spark):
    depth = lambda n: balanced(list(range(n)), lambda a, b: 1 + max(a if isinstance(a, int) else 0, 0), 0)
    assert depth(0) == 0
    wide = {"$or": [{"id": {"$eq": i}} for i in range(1500)]}
    assert spark.range(3000).where(try_compile(wide, T.StructType([T.StructField("id", T.LongType())]))[0]).count() == 1500


def test_regex_translation():
    assert translate_regex("a$") == "a\\z" and translate_regex("a$", "m") == "(?m)a$" and translate_regex("[$\\d]") == "[$0-9]" and translate_regex("x", "iy") == "\\A(?:(?iu)x)"
    with pytest.raises(FilterError):
        translate_regex("a", "ii")
