"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe as _bpe
from docloom.llm import decontaminate as _decon
from docloom.llm import exact_dedup as _exact
from docloom.llm import html_extract as _html
from docloom.llm import langid as _lang
from docloom.llm import license_scan as _license
from docloom.llm import line_dedup as _line
from docloom.llm import near_dedup as _near
from docloom.llm import pii as _pii
from docloom.llm import url_filter as _url
from docloom.llm.common import table, text_of


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _decon.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", F.col("first").alias("first_word"), "similarity")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _line.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _license.license_hits(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "license", "template", F.col("first").alias("first_word"), "containment")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _bpe.bpe_digest(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _pii.find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (_lang.bucket("doc_id") == 0).alias("held_out")
    return _lang.language_id(docs, _lang.fit(docs)).select("doc_id", held_out, "lang_pred", "score", "lang_support", "lang_spans")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url.url_filter(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extract, op2_decontaminate, op3_line_dedup, op4_license_scan, op5_bpe, op6_pii, op7_exact_dedup, op8_language_id, op9_url_filter, op10_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _line.ORACLE, "op7_exact_dedup": _exact.ORACLE, "op9_url_filter": _url.ORACLE}
