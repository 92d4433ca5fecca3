"""The vector frame: a stable id and an array of doubles, with roles in column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flatspan.functions.vectors import as_doubles

#: What one broadcast may hold; more is an error that names the way out.
MAX_BROADCAST_BYTES = 256 << 20


def vectors(df: DataFrame, id_col: str, features: str | list[str]) -> DataFrame:
    """(id, features) from an array column, or from numeric columns in the given order. Nulls become NaN."""
    x = F.col(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    return df.select(F.col(id_col).cast("long").alias("id"), as_doubles(x).alias("features"))


def width_of(df: DataFrame) -> int:
    """The common number of features; differing or missing ones are an error."""
    low, high = df.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if low is None or low != high or low < 1:
        raise ValueError("features must be arrays of one common length")
    return high


def check_broadcast(rows: int, width: int, what: str) -> None:
    """Refuse data that would not fit a broadcast, before any of it is gathered."""
    if rows * width * 8 > MAX_BROADCAST_BYTES:
        raise ValueError(f"{what}: {rows} x {width} numbers exceed {MAX_BROADCAST_BYTES} bytes; take a sample or a stated query set")


def with_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """df whose columns carry a role (index, attribute, target) in their metadata."""
    fields = {f.name: f.metadata for f in df.schema.fields}
    return df.select(*[F.col(c).alias(c, metadata=fields[c] | ({"role": roles[c]} if c in roles else {})) for c in df.columns])


def role_of(field: T.StructField) -> str | None:
    return (field.metadata or {}).get("role")
