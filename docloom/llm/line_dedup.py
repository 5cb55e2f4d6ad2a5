"""Line dedup: lines that occur in several documents stay only in the first one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import UPPER, WHITE, doc_key, shuffle_partitions, text_of


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Compressed keep bitmaps: ``id, text_hash, n_dropped, keep`` for the documents that lose lines.

    ``keep`` is ``array<struct<word int, bits long>>``: bit ``i`` of word ``w`` is line ``64 w + i``; words
    that are not listed keep all their lines. Documents that are not listed keep everything.

    Line hashes (128 bits) are range-partitioned with document and position behind them in the sort key, so
    that a line that fills a third of the table is cut into as many partitions as it needs. Each partition
    streams the first document of every hash in it. A hash can go on into the next partition only at a
    partition's edge: there are fewer such hashes than partitions, and only they are sent around.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    lines = docs.select(
        doc_key(id_col).alias("id"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
        F.posexplode(split_lines(text_of(text_col))).alias("pos", "line"),
    ).select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    occurrences = (
        lines.where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "id", "text_hash", "pos")
        .repartitionByRange(n, "h1", "h2", "id", "text_hash", "pos")
        .withColumn("part", F.spark_partition_id())
    )
    edge = (
        occurrences.groupBy("h1", "h2")
        .agg(F.min("id").alias("edge_first"), F.min("part").alias("a"), F.max("part").alias("b"))
        .where(F.col("a") < F.col("b"))
        .drop("a", "b")
    )
    stream = Window.partitionBy("h1", "h2", "part").orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dropped = (
        occurrences.withColumn("first", F.first("id").over(stream))
        .join(F.broadcast(edge), ["h1", "h2"], "left")  # fewer rows than partitions
        .where(F.col("id") > F.least("first", "edge_first"))
        .groupBy("id", "text_hash", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    )
    return dropped.groupBy("id", "text_hash").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"),
    )


def _kept(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set; ``keep`` null or a word not listed: all."""
    words = F.map_from_entries(keep)
    bit = lambda i: F.getbit(F.coalesce(F.try_element_at(words, F.shiftright(i, 6)), F.lit(-1).cast("long")), i.bitwiseAND(F.lit(63)))
    return F.when(keep.isNull(), lines).otherwise(F.filter(lines, lambda _, i: bit(i) == 1))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The input rows with ``text_col`` without its dropped lines, and ``n_lines`` and ``n_dropped`` beside it.

    A line's key is the line stripped of white space with A-Z lowered; keys shorter than ``min_chars`` code
    points never count. Null text is one empty line, and stays null where it was null; a null id counts as the
    smallest; rows repeated under one id count as one document. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        doc_key(id_col).alias("id"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
    )
    lines = split_lines(F.coalesce(F.col("row").getField(text_col), F.lit("")))
    joined = left.join(keep_bitmaps(docs, id_col, text_col, min_chars), ["id", "text_hash"], "left")
    text = F.when(F.col("keep").isNull(), F.col("row").getField(text_col)).otherwise(F.array_join(_kept(lines, F.col("keep")), "\n"))
    return joined.select(
        *[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in names],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, (k.key IS NOT NULL AND l.doc_id <> k.first_doc) AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
