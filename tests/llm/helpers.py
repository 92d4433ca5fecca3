"""Small tables for the corpus operators' tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ["size", "order", "pattern", "raw", "fp", "node", "component", "unit", "row", "copies", "kind", "key", "block", "virtual", "score", "pkey", "first"]


def documents(spark: SparkSession, rows: list[tuple], clashes: bool = False) -> DataFrame:
    """(doc_id, text[, lang[, source]]) rows as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1]) if r[1] else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]) if clashes else df


def odd_documents(spark: SparkSession, clashes: bool = True) -> DataFrame:
    """Nulls everywhere, empty and long texts, repeated rows and ties."""
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "", "en", None),
        (3, None, None, None),
        (None, "the quick brown fox jumps over the lazy dog", "en", "b"),
        (None, None, None, "b"),
        (4, long, "en", "a"),
        (5, "12 34 !? \t\n", None, "c"),
        (6, "Ünïcode ßtraße ÉÉ", "de", "c"),
        (2**53 + 1, "one", "fr", "a"),
    ]
    return documents(spark, rows, clashes)


def frame(df: DataFrame) -> pd.DataFrame:
    """Rows with exact long ids (None where null)."""
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
