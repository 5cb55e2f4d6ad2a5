import math
import random

import pytest

from docloom.operators.page import Boundary, PageError, Slice, SortKey, boundary_of, check_slice, encode_value, query, resolved_sort
from docloom.sources.tables import Clauses, ColumnTable, ObjectTable, concat, flatten, rebase


def _rows(n=40, seed=1):
    r = random.Random(seed)
    nums = [None, 0.0, 1.0, 2.0, math.nan, math.inf, -math.inf]
    return [(f"k{i:02d}", r.choice(nums), r.choice([None, "a", "B", "é", "\ue000", "\U00010000"]), r.choice([None, True, False]), r.choice([None, 2**53, 2**53 + 1])) for i in range(n)]


SCHEMA = "id string, d double, s string, b boolean, n bigint"


def _expected(rows, sort):
    def part(v, direction):
        if v is None:
            return (1,)
        if isinstance(v, bool):
            v = str(v).lower()
        number = not isinstance(v, str) and math.isfinite(v)
        text = "" if number else v if isinstance(v, str) else encode_value(v)
        key = (0 if number else 1, v if number else 0, [ord(c) for c in text])
        return (0, key) if direction == 1 else (0, tuple([-key[0], -key[1], [-x for x in key[2]] + [1]]))

    names = ["id", "d", "s", "b", "n"]
    return [r[0] for r in sorted(rows, key=lambda r: [part(r[names.index(k.key)], k.direction) for k in resolved_sort(sort, "id")])]


SORTS = [(SortKey("d"),), (SortKey("d", -1), SortKey("s")), (SortKey("s", -1),), (SortKey("b", -1), SortKey("n")), (SortKey("n", -1), SortKey("id", -1))]


@pytest.mark.parametrize("sort", SORTS, ids=str)
def test_order_and_every_keyset_page(spark, sort):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want = _expected(rows, sort)
    whole = query(df, None, Slice(sort), "id").collect()
    assert [r.id for r in whole] == want
    for cut in (0, 7, 20, 33):
        b = Boundary.parse(boundary_of(df, whole[cut], sort, "id").cursor())
        assert [r.id for r in query(df, None, Slice(sort, limit=5, after_boundary=b), "id").collect()] == want[cut + 1 : cut + 6]
        assert [r.id for r in query(df, None, Slice(sort, after_pk=whole[cut].id), "id").collect()] == want[cut + 1 :]
    assert query(df, None, Slice(sort, after_pk="gone"), "id").count() == 0
    assert [r.id for r in query(df, {}, Slice(sort, offset=3, limit=4), "id").collect()] == want[3:7]


def test_documents_sort_across_types(spark):
    docs = ['{"id":"1","v":2}', '{"id":"2","v":"a"}', '{"id":"3"}', '{"id":"4","v":null}', '{"id":"5","v":true}', '{"id":"6","v":-1.5}', "broken"]
    t = ObjectTable(spark.createDataFrame([(d,) for d in docs], "j string"), "j", "id")
    assert t.broken() == 1
    out = [r[0] for r in t.query({"id": {"$exists": True}}, Slice((SortKey("v"),))).selectExpr("try_variant_get(j, '$.id', 'string')").collect()]
    assert out == ["6", "1", "2", "5", "3", "4"]


def test_slices_are_checked(spark):
    assert check_slice(Slice(limit=-1)) and check_slice(Slice((SortKey("a"),), offset=1, after_pk=2)) and check_slice(Slice(after_pk=2))
    assert check_slice(Slice((SortKey("a"),), after_boundary=Boundary((), 1)))
    df = spark.createDataFrame(_rows(3), SCHEMA)
    for s in (Slice((SortKey("nope"),)), Slice((SortKey("d"),), after_boundary=Boundary(("x",), "k"))):
        with pytest.raises(PageError):
            query(df, None, s, "id")
    with pytest.raises(PageError):
        query(df, None, Slice((SortKey("s"),)), "id", sortable={"d": None})
    assert query(df, None, Slice(limit=0), "id").count() == 0
    assert ColumnTable(df, "id", ("id", "d")).kinds() == {"id": "string", "d": "number"}


def test_sql_text():
    assert rebase("a = $1 AND b = '$1'", 2) == "a = $3 AND b = '$1'"
    assert concat(("a = $1", [1]), ("", []), ("b = $1", [2])) == ("(a = $1) AND (b = $2)", [1, 2])
    assert flatten(Clauses("a = $1", [5], "a", 10, 2), "postgres") == ("WHERE a = $1 ORDER BY a LIMIT $2 OFFSET $3", [5, 10, 2])
    assert flatten(Clauses(offset=4), "sqlite") == ("LIMIT ? OFFSET ?", [-1, 4])
    assert encode_value(2**60) == {"$bigint": str(2**60)} == encode_value(encode_value(2**60))
