"""Streams of change sets: a differ that remembers the last snapshot, and an emitter for micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.delta import Delta, diff


class SnapshotDiffer:
    """Call it with one snapshot after the other; each call gives the change set since the one before.

    Snapshots are kept as Parquet tables under ``state_path``, one folder per version, so the state outlives the
    driver and its lineage does not grow. The last ``KEEP`` versions stay, for a batch that runs again; older ones are
    deleted.
    """

    KEEP = 3

    def __init__(self, spark: SparkSession, pk: str, state_path: str) -> None:
        self.spark, self.pk, self.path = spark, pk, state_path
        self.version = self._latest()

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(conf), path, jvm

    def _latest(self) -> int:
        fs, path, jvm = self._fs()
        if not fs.exists(path):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=-1)

    def _forget(self, last: int) -> None:
        fs, path, jvm = self._fs()
        for name in [s.getPath().getName() for s in fs.listStatus(path)]:
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) <= last:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def snapshot(self, version: int | None = None) -> DataFrame | None:
        v = self.version if version is None else version
        return self.spark.read.parquet(f"{self.path}/v{v}") if v >= 0 else None

    def __call__(self, current: DataFrame, created_at: int | str | None = None, version: int | None = None) -> Delta:
        """``version`` (a batch id) makes a repeated call give the same change set again."""
        v = self.version + 1 if version is None else version
        current.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        before = max([x for x in (self.version, v - 1) if x < v], default=-1)
        self.version = v
        self._forget(v - self.KEEP)
        return diff(self.snapshot(v), self.snapshot(before), self.pk, created_at)


def is_empty(delta: Delta) -> bool:
    return all(p is None or p.isEmpty() for p in (delta.insert, delta.update, delta.upsert, delta.remove_keys))


class DeltaEmitter:
    """Passes on a change set for each snapshot, but only one that holds something."""

    def __init__(self, spark: SparkSession, pk: str, state_path: str, listener: Callable[[Delta], None]) -> None:
        self.differ, self.listener = SnapshotDiffer(spark, pk, state_path), listener

    def update(self, items: DataFrame, created_at: int | str | None = None, version: int | None = None) -> bool:
        delta = self.differ(items, created_at, version)
        if is_empty(delta):
            return False
        self.listener(delta)
        return True


def emit_stream(stream: DataFrame, pk: str, state_path: str, checkpoint: str, listener: Callable[[Delta, int], None]) -> StreamingQuery:
    """A streaming query in which every micro-batch is a snapshot; the listener gets the change set and the batch id."""

    def batch(df: DataFrame, batch_id: int) -> None:
        DeltaEmitter(df.sparkSession, pk, state_path, lambda d: listener(d, batch_id)).update(df, batch_id, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
