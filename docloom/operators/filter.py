"""Filtering: rows, single documents, and compiled matchers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.compiler import compile_filter
from docloom.plans.evaluate import matches
from docloom.plans.predicate import check_filter


def filter_rows(df: DataFrame, f: dict, doc: str | None = None, nulls_are: str = "missing") -> DataFrame:
    """Rows that match. A malformed filter is refused before anything is read, also for an empty frame."""
    return df.where(compile_filter(f, df.schema, doc, nulls_are))


def match_column(df: DataFrame, f: dict, doc: str | None = None, nulls_are: str = "missing") -> Column:
    return compile_filter(f, df.schema, doc, nulls_are)


def compiled_matcher(f: dict):
    """A test of plain documents on the driver; the filter is checked once."""
    check_filter(f)
    return lambda document: matches(document, f)


def filter_documents(spark: SparkSession, documents: list[dict], f: dict) -> list[dict]:
    """Plain documents through the Variant engine, in their order."""
    check_filter(f)
    if not all(isinstance(d, dict) for d in documents):
        raise TypeError("only plain documents can be matched")
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i long, j string")
    kept = filter_rows(rows.select("i", F.parse_json("j").alias("doc")), f, doc="doc").select("i").collect()
    return [documents[i] for i in sorted(r.i for r in kept)]
