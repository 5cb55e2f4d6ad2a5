import random

import pytest

from docloom.operators.delta import Delta, DeltaError, apply, check_delta, constrain, diff, reduce
from docloom.streaming.differ import DeltaEmitter, SnapshotDiffer, emit_stream

SCHEMA = "id string, value string, version int"


def _df(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None) for r in rows], SCHEMA)


def _keys(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "id string")


def _set(df):
    return None if df is None else sorted((tuple(r) for r in df.collect()), key=repr)


def test_diff_and_apply_are_inverse(spark):
    old = _df(spark, [("1", "a", 1), ("2", "b", None), ("3", "c", 3)])
    new = _df(spark, [("1", "a", 1), ("2", "b", 5), ("4", "d", None)])
    d = diff(new, old, "id", 100)
    assert (_set(d.insert), _set(d.update), _set(d.remove_keys)) == ([("4", "d", None)], [("2", "b", 5)], [("3",)])
    assert _set(apply(old, d, "id")) == _set(new)
    first = diff(old, None, "id")
    assert _set(first.insert) == _set(old) and first.update.count() == 0


def test_apply_order_and_conflicts(spark):
    items = _df(spark, [("1", "a"), ("2", "b"), ("3", "c")])
    d = Delta(insert=_df(spark, [("1", "no"), ("4", "new"), ("5", "i")]), update=_df(spark, [("2", "upd"), ("5", "u"), ("9", "no")]), upsert=_df(spark, [("3", "up"), ("6", "up")]), remove_keys=_keys(spark, ["8"]))
    assert [r[:2] for r in _set(apply(items, d, "id"))] == [("1", "a"), ("2", "upd"), ("3", "up"), ("4", "new"), ("5", "u"), ("6", "up")]
    assert [r[0] for r in _set(apply(items, d, "id", only=["1", "4"]))] == ["1", "4"]
    assert apply(items, d, "id", only=[]).count() == 0
    with pytest.raises(DeltaError):
        check_delta(Delta(insert=_df(spark, [("1", "x")]), remove_keys=_keys(spark, ["1"])), "id")


def _fold(deltas, pure):
    """The reduction on plain lists, written out step by step."""
    ins, upd, ups, gone, last = {}, {}, {}, set(), {}
    for d in deltas:
        for k in d.get("remove_keys", ()):
            gone.add(k)
            for m in (ins, upd, ups):
                m.pop(k, None)
        for r in d.get("insert", ()):
            last[r[0]] = r
            if r[0] not in ins and r[0] not in upd and r[0] not in ups:
                gone.discard(r[0])
                ins[r[0]] = r
        for r in d.get("update", ()):
            last[r[0]] = r
            if r[0] not in gone and r[0] not in ups:
                upd[r[0]] = r
        for r in d.get("upsert", ()):
            last[r[0]] = r
            gone.discard(r[0])
            ins.pop(r[0], None)
            upd.pop(r[0], None)
            ups[r[0]] = r
    if not pure:
        for k in [k for k in upd if k in ins]:
            ups[k] = upd.pop(k)
            ins.pop(k)
    return [sorted(last[k] for k in m) for m in (ins, upd, ups)] + [sorted(gone)]


@pytest.mark.parametrize("pure", [True, False])
def test_reduce_against_a_plain_fold(spark, pure):
    r = random.Random(4)
    plain = []
    for t in range(7):
        keys = r.sample("abcdefgh", 5)
        d = {"remove_keys": keys[:1], "insert": [(k, f"i{t}", t) for k in keys[1:3]], "update": [(k, f"u{t}", t) for k in keys[2:4]]}
        if not pure and t % 2:
            d["upsert"] = [(keys[4], f"p{t}", t)]
        plain.append(d)
    stamps = [5, "5##001", "5##002", 6, "7##1", 8, 9]
    frames = [
        Delta(_df(spark, d["insert"]), _df(spark, d["update"]), _df(spark, d["upsert"]) if "upsert" in d else None, _keys(spark, d["remove_keys"]), s)
        for d, s in zip(plain, stamps, strict=True)
    ]
    mixed = frames[:]
    r.shuffle(mixed)
    out = reduce(mixed, "id")
    want = _fold(plain, pure)
    assert _set(out.insert) == want[0] and _set(out.update) == want[1] and [k[0] for k in _set(out.remove_keys)] == want[3]
    assert (out.upsert is None) if pure else _set(out.upsert) == want[2]
    assert out.created_at == 9


def test_constrain(spark):
    d = Delta(_df(spark, [("1", "a"), ("2", "b")]), _df(spark, [("3", "a")]), None, _keys(spark, ["9"]), 1)
    out = constrain(d, {"value": "a"}, "id")
    assert _set(out.insert) == [("1", "a", None)] and _set(out.remove_keys) == [("2",), ("9",)] and out.created_at == 1


def test_emitter_and_stream(spark, tmp_path):
    got = []
    e = DeltaEmitter(spark, "id", str(tmp_path / "s"), lambda d: got.append((_set(d.insert), _set(d.update), _set(d.remove_keys))))
    assert e.update(_df(spark, [("1", "a")])) and not e.update(_df(spark, [("1", "a")])) and e.update(_df(spark, [("1", "b")]))
    assert got[-1] == ([], [("1", "b", None)], [])
    assert SnapshotDiffer(spark, "id", str(tmp_path / "s")).version == 2  # the state outlives the object
    source, seen = str(tmp_path / "in"), []
    _df(spark, [("1", "a"), ("2", "b")]).coalesce(1).write.parquet(source)
    q = emit_stream(spark.readStream.schema(SCHEMA).parquet(source), "id", str(tmp_path / "t"), str(tmp_path / "c"), lambda d, i: seen.append((i, d.insert.count(), d.remove_keys.count())))
    q.processAllAvailable()
    _df(spark, [("2", "b"), ("3", "c")]).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 2, 0), (1, 1, 1)]
