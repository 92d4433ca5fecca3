"""Dataset bundles: a JSON description beside tables, and table sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a description may name.
TYPES = {"integer": T.LongType(), "real": T.DoubleType(), "string": T.StringType(), "categorical": T.StringType(), "boolean": T.BooleanType(), "dateTime": T.TimestampType()}
#: Roles that a description may name, and the engine's names for them.
ROLES = {"index": "index", "attribute": "attribute", "suggestedTarget": "target"}


def read_description(spark: SparkSession, folder: str) -> dict:
    """The bundle's datasetDoc.json, read through Spark so that any of its file systems will do."""
    return json.loads(spark.read.text(f"{folder}/datasetDoc.json", wholetext=True).first()[0])


def read_bundle(spark: SparkSession, folder: str, resource: str | None = None) -> DataFrame:
    """A table resource (the first by default) with the described types, and roles as column metadata."""
    tables = [r for r in read_description(spark, folder)["dataResources"] if r["resType"] == "table"]
    table = next(r for r in tables if resource in (None, r["resID"]))
    raw = spark.read.csv(f"{folder}/{table['resPath']}", header=True)
    columns = sorted(table["columns"], key=lambda c: c["colIndex"])
    out = []
    for c in columns:
        roles = [ROLES[r] for r in c.get("role", []) if r in ROLES]
        meta = {"role": roles[0]} if roles else {}
        if "refersTo" in c:
            meta["refers_to"] = c["refersTo"]["resID"]
        out.append(F.col(f"`{c['colName']}`").try_cast(TYPES.get(c["colType"], T.StringType())).alias(c["colName"], metadata=meta))
    return raw.select(*out)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, replaced whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(df: DataFrame) -> str:
    """A checksum of a table's rows, whatever their order: pins the data that a run has used.

    Sums of two hashes, so that repeated rows count each time.
    """
    row = [F.col(f"`{c}`") for c in df.columns]
    sums = [F.sum(F.xxhash64(*row, *salt).cast("decimal(38,0)")) for salt in ([], [F.lit(1)])]
    n, *totals = df.agg(F.count(F.lit(1)), *sums).first()
    return "-".join([str(n), *[f"{int(t or 0) % 2**64:016x}" for t in totals]])
