"""Connected components: of few edges in one task, of more by alternating large and small stars; edges never leave the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, ship

#: Edges up to this many are joined in one task, which holds about 150 bytes for each of their nodes. A round of stars over so
#: few is nine stages of as many tasks as there are shuffle partitions, and the driver keeps a record of each task.
ONE_TASK = 1 << 17


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(parent), "component": [root(x) for x in parent]}, dtype="int64")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over ``u, v`` edges: neighbours are joined to the least node of the neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else near.groupBy("u").agg(F.min("v").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the least id) for every node of the undirected edges ``u, v``.

    Up to ``ONE_TASK`` edges are joined in one task. Of more, the number of rounds grows with the logarithm of the largest
    component; every round is written to the checkpoint folder, and a hub's edges meet in joins whose large partitions
    Spark splits.
    """
    current = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen is None and state[0] <= ONE_TASK:
            ship(edges.sparkSession)
            return checkpoint(current.coalesce(1).mapInPandas(_united, "id bigint, component bigint"))
        if tuple(state) == seen:
            break
        seen = tuple(state)
        current = checkpoint(_star(_star(current, large=True), large=False))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()
