"""Change sets of keyed rows: difference, application, reduction, restriction to a filter."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans.compiler import compile_filter


class DeltaError(ValueError):
    """A change set that contradicts itself."""


@dataclass(frozen=True)
class Delta:
    """Rows to insert, update and upsert, and keys to remove (a frame of the key alone). Parts may be absent;
    ``pure`` change sets (insert, update, remove_keys) hold no upsert."""

    insert: DataFrame | None = None
    update: DataFrame | None = None
    upsert: DataFrame | None = None
    remove_keys: DataFrame | None = None
    created_at: int | str | None = None

    @property
    def pure(self) -> bool:
        return self.upsert is None and None not in (self.insert, self.update, self.remove_keys)

    def modified(self) -> list[DataFrame]:
        return [x for x in (self.insert, self.update, self.upsert) if x is not None]


def is_pure(x: object) -> bool:
    return isinstance(x, Delta) and x.pure and x.created_at is not None


def is_applicable(x: object, pk: str) -> bool:
    """Whether ``x`` is a change set whose parts all hold the key."""
    return isinstance(x, Delta) and all(pk in p.columns for p in (*x.modified(), *([x.remove_keys] if x.remove_keys is not None else [])))


def _row(df: DataFrame, name: str = "row") -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def _keyed(df: DataFrame, pk: str, **labels: str | int) -> DataFrame:
    return df.select(F.col(f"`{pk}`").alias("k"), _row(df), *[F.lit(v).alias(n) for n, v in labels.items()])


def _has(t: T.DataType, kinds: tuple[type, ...]) -> bool:
    if isinstance(t, T.StructType):
        return any(_has(f.dataType, kinds) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _has(t.elementType, kinds)
    return isinstance(t, kinds) or isinstance(t, T.MapType) and _has(t.valueType, kinds)


def comparable(c: Column, t: T.DataType) -> Column:
    """A value that is equal where the row's is: maps at any depth become sorted entries, and a Variant its text, which
    has its keys in order."""
    if not _has(t, (T.MapType, T.VariantType)):
        return c
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[comparable(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda e: comparable(e, t.elementType))
    if isinstance(t, T.MapType):
        return F.sort_array(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], t.valueType).alias("value"))))
    return F.to_json(c)


def labelled_diff(current: DataFrame, previous: DataFrame, pk: str) -> DataFrame:
    """``k, row, op``: every key that differs with its new row (null where it is gone) and insert, update or remove, in
    one plan with one shuffle of both sides by the key. Structs are compared field by field, maps at any depth by their
    sorted entries, Variants by their canonical text."""
    both = _keyed(current, pk).join(_keyed(previous.select(*current.columns), pk).withColumnRenamed("row", "old"), "k", "full_outer")
    value = lambda s: comparable(F.col(s), current.schema)
    op = F.when(F.col("old").isNull(), "insert").when(F.col("row").isNull(), "remove").when(~value("row").eqNullSafe(value("old")), "update")
    return both.select("k", "row", op.alias("op")).where(F.col("op").isNotNull())


def diff(current: DataFrame, previous: DataFrame | None, pk: str, created_at: int | str | None = None) -> Delta:
    """What turns ``previous`` into ``current``, from ``labelled_diff``; each part is a filter on it."""
    if previous is None:
        return Delta(current, current.limit(0), None, current.select(pk).limit(0), created_at)
    both = labelled_diff(current, previous, pk)
    of = lambda op: both.where(F.col("op") == op)
    return Delta(of("insert").select("row.*"), of("update").select("row.*"), None, of("remove").select(F.col("k").alias(pk)), created_at)


def check_delta(delta: Delta, pk: str) -> None:
    """A key cannot be removed and modified in one change set."""
    if delta.remove_keys is None or not delta.modified():
        return
    keys = delta.modified()[0].select(pk)
    for more in delta.modified()[1:]:
        keys = keys.unionByName(more.select(pk))
    clash = keys.join(delta.remove_keys.select(pk), pk, "left_semi").limit(1).collect()
    if clash:
        raise DeltaError(f"key {clash[0][0]!r} is both removed and modified")


def apply(items: DataFrame, delta: Delta, pk: str, only: list | None = None) -> DataFrame:
    """The rows after the change set: remove, then update what exists, upsert, and insert what is absent.

    A key that is inserted and updated is upserted with the updated row. With ``only``, other keys are left out.
    """
    if only is not None and not only:
        return items.limit(0)
    check_delta(delta, pk)
    parts = [_keyed(items, pk, op=0)]
    for op, part in ((1, delta.insert), (2, delta.update), (3, delta.upsert)):
        if part is not None:
            parts.append(_keyed(part.select(*items.columns), pk, op=op))
    if delta.remove_keys is not None:
        parts.append(delta.remove_keys.select(F.col(pk).alias("k"), F.lit(None).cast(items.select(_row(items)).schema[0].dataType).alias("row"), F.lit(4).alias("op")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if only is not None:
        rows = rows.where(F.col("k").isin(only))
    pick = lambda op: F.first(F.when(F.col("op") == op, F.col("row")), ignorenulls=True)
    g = rows.groupBy("k").agg(*[pick(op).alias(n) for op, n in enumerate(("old", "ins", "upd", "ups"))], F.max(F.col("op") == 4).alias("gone"))
    old = F.when(~F.col("gone"), F.col("old"))
    final = (
        F.when(F.col("ups").isNotNull(), F.col("ups"))
        .when(F.col("ins").isNotNull() & F.col("upd").isNotNull(), F.col("upd"))
        .when(old.isNotNull() & F.col("upd").isNotNull(), F.col("upd"))
        .when(old.isNotNull(), old)
        .otherwise(F.col("ins"))
    )
    return g.select(final.alias("row")).where(F.col("row").isNotNull()).select("row.*")


def timestamp_key(t: int | str) -> tuple[int, str]:
    """Milliseconds and a sequence: ``100 < '100##001' < '100##002'``."""
    if isinstance(t, str):
        ms, sep, seq = t.partition("##")
        if not sep or not ms.isdigit():
            raise DeltaError(f"no time stamp: {t!r}")
        return int(ms), seq
    return int(t), ""


OPS = {"remove": 0, "insert": 1, "update": 2, "upsert": 3}


def change_log(deltas: list[Delta], pk: str) -> DataFrame:
    """One frame ``k, row, ms, seq, op`` of many change sets."""
    out: DataFrame | None = None
    sample = next((d.modified()[0] for d in deltas if d.modified()), None)
    dtype = sample.select(_row(sample)).schema[0].dataType if sample is not None else None
    for d in deltas:
        ms, seq = timestamp_key(d.created_at)
        labels = [F.lit(ms).cast("long").alias("ms"), F.lit(seq).alias("seq")]
        for name in OPS:
            part = d.remove_keys if name == "remove" else getattr(d, name)
            if part is None:
                continue
            row = F.lit(None).cast(dtype or "struct<x:int>").alias("row") if name == "remove" else _row(part.select(*sample.columns))
            one = part.select(F.col(pk).alias("k"), row, *labels, F.lit(OPS[name]).alias("op"))
            out = one if out is None else out.unionByName(one)
    return out


def reduce_log(log: DataFrame, allow_upsert: bool) -> DataFrame:
    """``k, insert, update, upsert, removed``: the net change of every key, folded in time order inside its group.

    Per key the state is which of the four lists holds it. A removal empties the others; an insert or upsert
    after it brings the key back, an update does not; an upsert absorbs the others. With ``allow_upsert`` a key that
    is inserted and updated is upserted. Every list carries the last row written.
    """
    steps = F.sort_array(F.collect_list(F.struct("ms", "seq", "op", "row")))
    start = F.struct(*[F.lit(False).alias(n) for n in ("i", "u", "p", "r")])

    def step(s: Column, e: Column) -> Column:
        op = e["op"]
        insert = (op == 1) & ~s["i"] & ~s["u"] & ~s["p"]
        update = (op == 2) & ~s["r"] & ~s["p"]
        return F.struct(
            (((op != 0) & (op != 3) & s["i"]) | insert).alias("i"),
            (((op != 0) & (op != 3) & s["u"]) | update).alias("u"),
            (((op != 0) & s["p"]) | (op == 3)).alias("p"),
            ((s["r"] & ~(insert | (op == 3))) | (op == 0)).alias("r"),
        )

    g = log.groupBy("k").agg(steps.alias("steps"))
    written = F.transform(F.filter("steps", lambda e: e["op"] != 0), lambda e: e["row"])
    g = g.select("k", F.aggregate("steps", start, step).alias("s"), F.try_element_at(written, F.lit(-1)).alias("row"))
    s = F.col("s")
    both = s["i"] & s["u"] if allow_upsert else F.lit(False)
    return g.select(
        "k",
        F.when(s["i"] & ~both, F.col("row")).alias("insert"),
        F.when(s["u"] & ~both, F.col("row")).alias("update"),
        F.when(s["p"] | both, F.col("row")).alias("upsert"),
        s["r"].alias("removed"),
    )


def reduce(deltas: list[Delta], pk: str) -> Delta:
    """One change set with the effect of all, in the order of their time stamps.

    Pure inputs give a pure result, in which a key inserted and updated stays in both lists; otherwise it is upserted.
    """
    if not deltas:
        return Delta()
    for d in deltas:
        check_delta(d, pk)
    if len(deltas) == 1:
        return deltas[0]
    pure = all(d.pure for d in deltas)
    net = reduce_log(change_log(deltas, pk), allow_upsert=not pure)
    rows = lambda c: net.where(F.col(c).isNotNull()).select(f"{c}.*")
    latest = max((d.created_at for d in deltas), key=timestamp_key)
    return Delta(rows("insert"), rows("update"), None if pure else rows("upsert"), net.where("removed").select(F.col("k").alias(pk)), latest)


def constrain(delta: Delta, f: dict, pk: str, doc: str | None = None) -> Delta:
    """The change set seen through a filter: modified rows that do not match are removed instead. With ``doc``, the filter
    speaks of the documents in that column."""
    parts = {n: p for n in ("insert", "update", "upsert") if (p := getattr(delta, n)) is not None}
    gone = delta.remove_keys
    kept = {}
    for name, part in parts.items():
        hit = compile_filter(f, part.schema, doc)
        kept[name] = part.where(hit)
        out = part.where(~hit).select(pk)
        gone = out if gone is None else gone.unionByName(out)
    return replace(delta, **kept, remove_keys=None if gone is None else gone.distinct())
