"""Exact dedup: equal texts, found by a 128-bit content hash and confirmed byte by byte."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WHITE, text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without white space. The grouping key is the 128-bit hash
    followed by the normalised bytes themselves, so two texts that only share the hash fall into two
    groups. Copies meet map-side first: a task sends one row per distinct text, whatever the size of a
    group of copies. The row of a group that stays is the one with the most code points, then the smallest id.

    Null text counts as empty; a null id is never preferred to another; rows repeated under one id
    (same id, same length) are one document and carry the same ``kept``. An empty table gives an empty result.
    """
    norm = F.translate(text_of(text_col), WHITE, "")
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.length(text_of(text_col)).cast("long").alias("n"),
        norm.alias("norm"),
    ).select(
        "id", "n", "norm",
        F.xxhash64("norm").alias("h1"),
        F.xxhash64(F.lit(1), F.col("norm")).alias("h2"),
    )
    # ~id reverses the order of the ids without overflow; in max() a null is the least.
    groups = (
        base.groupBy("h1", "h2", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("n", F.bitwise_not("id").alias("r"))).alias("best"))
        .select(
            "h1", "h2", F.sha2("norm", 256).alias("sha"), "group_size",
            F.col("best.n").alias("best_n"), F.bitwise_not("best.r").alias("keep_id"),
        )
    )
    rows = base.select("id", "n", "h1", "h2", F.sha2("norm", 256).alias("sha"))
    return rows.join(groups, ["h1", "h2", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("best_n"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
