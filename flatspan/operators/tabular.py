"""Steps around the learners: profile, parse, select by role, impute, assemble, spread, attach and score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspan.frame import role_of

#: Text with at least this share of distinct values is no category.
CATEGORY_SHARE = 0.5


def profile(df: DataFrame) -> DataFrame:
    """(column, n, n_null, n_distinct, n_long, n_double, n_timestamp, low, high, inferred): one aggregate pass.

    Every value is read as text; counts tell how many casts succeed, low and high are the smallest and largest
    text in code-point order, distinct counts are approximate (2 % by default). inferred: long, double, timestamp,
    categorical or string.
    """
    cells = []
    for c in df.columns:
        t = F.col(f"`{c}`").cast("string")
        tried = {"long": t.try_cast("long"), "double": t.try_cast("double"), "timestamp": t.try_cast("timestamp")}
        cells += [F.count(t).alias(f"{c}:present"), F.approx_count_distinct(t, 0.02).alias(f"{c}:distinct"), F.min(t).alias(f"{c}:low"), F.max(t).alias(f"{c}:high")]
        cells += [F.count(v).alias(f"{c}:{k}") for k, v in tried.items()]
    one = df.agg(F.count(F.lit(1)).alias("n"), *cells)
    at = lambda c, k: F.col(f"`{c}:{k}`")
    rows = [
        F.struct(F.lit(c).alias("column"), F.col("n"), (F.col("n") - at(c, "present")).alias("n_null"), at(c, "distinct").alias("n_distinct"), at(c, "long").alias("n_long"), at(c, "double").alias("n_double"), at(c, "timestamp").alias("n_timestamp"), at(c, "low").alias("low"), at(c, "high").alias("high"), at(c, "present").alias("present"))
        for c in df.columns
    ]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    kind = (
        F.when(F.col("present") == 0, "string")
        .when(F.col("n_long") == F.col("present"), "long")
        .when(F.col("n_double") == F.col("present"), "double")
        .when(F.col("n_timestamp") == F.col("present"), "timestamp")
        .when(F.col("n_distinct") <= CATEGORY_SHARE * F.col("present"), "categorical")
        .otherwise("string")
    )
    return out.withColumn("inferred", kind).drop("present")


def parse(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to the given types; what can't be read becomes null. Other columns stay."""
    return df.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c, metadata=f.metadata) if c in types else F.col(f"`{c}`") for c, f in zip(df.columns, df.schema.fields, strict=True)])


def parse_by_profile(df: DataFrame) -> DataFrame:
    """Columns cast to their inferred types (a category stays text); the profile has one row a column."""
    kinds = {r["column"]: r["inferred"] for r in profile(df).select("column", "inferred").collect()}
    return parse(df, {c: k for c, k in kinds.items() if k in ("long", "double", "timestamp")})


def select_by_role(df: DataFrame, *roles: str, exclude: tuple[int, ...] = ()) -> DataFrame:
    """Columns with one of the roles, but for those at the excluded places."""
    return df.select(*[F.col(f"`{f.name}`") for k, f in enumerate(df.schema.fields) if role_of(f) in roles and k not in exclude])


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaNs of numeric columns replaced by the column's mean over the rest: one aggregate, one narrow pass."""
    known = {c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in columns}
    mean = df.agg(*[F.avg(v).alias(c) for c, v in known.items()]).first()
    return df.withColumns({c: F.coalesce(v, F.lit(mean[c]).cast("double")) for c, v in known.items()})


def assemble(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, features)."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def spread(df: DataFrame, column: str = "features", prefix: str = "f", width: int = 1) -> DataFrame:
    """An array column as ``width`` columns."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[k].alias(f"{prefix}{k}") for k in range(width)])


def attach(df: DataFrame, predictions: DataFrame, id_col: str, key: str = "id") -> DataFrame:
    """Every row of df with its prediction, null where there is none."""
    return df.join(predictions.withColumnRenamed(key, "_key"), df[id_col] == F.col("_key"), "left").drop("_key")


def split(df: DataFrame, id_col: str, parts: int = 5, held: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by id modulo parts."""
    fold = F.pmod(F.col(id_col), F.lit(parts))
    return df.where(fold != held), df.where(fold == held)


def regression_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: n, mse, mae, r2."""
    e = F.col(label) - F.col(prediction)
    return df.agg(F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(label) * F.count(e))).alias("r2"))


def purity(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of rows whose true label is its cluster's most frequent one."""
    pairs = labels.join(truth, "id").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("cluster").agg(F.max("n").alias("most"), F.sum("n").alias("n")).agg((F.sum("most") / F.sum("n")).alias("purity"))
