"""A training corpus from raw documents: language, lines, near duplicates, benchmark leaks, tokens.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before it kept, and returns the
columns of its input; the last one adds the tokens. Part of the subpackage ``docloom.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, langid, line_dedup, near_dedup
from docloom.llm.common import checkpoint, table
from docloom.llm.queries import vocabulary


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` only, with ``n_chars`` brought up to date where there is one."""
    counted = F.length("text").cast(dict(docs.dtypes)["n_chars"]) if "n_chars" in docs.columns else None
    return out.select(*[(counted if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


#: Documents of a language have at least this share of their letters in words of a script that a learned language uses,
#: and at least this share of their letters in the spans of the language predicted.
LEAST_SUPPORT, LEAST_SCORE = 0.5, 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter, texts most of whose letters are of
    scripts that no learned language uses, and texts of many languages with no more than ``LEAST_SCORE`` of any.

    Where no document is labelled there is nothing to learn from, and only the letterless go. Repeated rows fare alike.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    out = langid.language_id(row, model)
    spoken = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_support") >= LEAST_SUPPORT) & (F.col("score") >= LEAST_SCORE)
    return out.where(spoken).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first of them only. No document goes."""
    return _like(line_dedup.line_dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of the least id."""
    kept = near_dedup.near_dedup(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c not in ("doc_id", "text")}))
    return kept.where("kept").select(*[F.col(c if c in ("doc_id", "text") else f"`in_{c}`").alias(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``n_tokens``, ``ids`` and the digests of the ids and of the text decoded from them."""
    return bpe.bpe_digest(docs, vocabulary(), ids_col="ids")


STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", leaks), ("bpe", tokens)]

#: Language ID, MinHash and BPE cannot be said in SQL; tests/llm compares the rows of run() with those of the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written to the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
