"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_LONG = -(2**63)

_LOCK = threading.Lock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable holds the evaluated value, so the optimiser cannot
    inline ``value`` into an inner lambda and evaluate it for every element.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)  # one parameter: a second would be the index


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one in local mode (tests), and an
    error on a cluster, whose executors would not share it."""
    sc = spark.sparkContext
    with _LOCK:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = named or tempfile.mkdtemp(prefix="docloom-checkpoint-")
        sc.setCheckpointDir(named)
        return named


#: Rows that a Python worker gets at once where the session has Spark's default; whole texts make wide rows.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Prepare for Python functions: send this package's source to the executors, once for each context, so that they can
    import it wherever they run; and lower the session's Arrow batches from the default, which bounds a worker's memory."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    with _LOCK:
        if getattr(sc, "_docloom_shipped", False):
            return spark
        root = Path(__file__).resolve().parents[2]
        out = Path(tempfile.mkdtemp(prefix="docloom-source-")) / "docloom_source.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted((root / "docloom").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(out))
        sc._docloom_shipped = True
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder at once and go on from there.

    Spark deletes the shuffle files behind it only when the driver collects its garbage, so that is asked for here:
    a job of many steps then holds the files of one step.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many _ as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_key(doc_id: str = "doc_id") -> Column:
    """A null document id counts as the smallest one."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(MIN_LONG))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
