"""Getting the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Spark's setting by which an action's shuffle files go when it ends, and how many actions of ours now hold it.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HELD, _LOCK = {"actions": 0, "before": None}, Lock()


def ship_package(spark: SparkSession) -> None:
    """Give this package to all Python workers of the session's application, once, as a zip of its sources."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="flatspan-")) / "flatspan_sources.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may fall back on a temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Actions within leave no shuffle files behind, which else stay until the driver happens to collect its garbage. May be held by several threads."""
    with _LOCK:
        if not _HELD["actions"]:
            _HELD["before"] = spark.conf.get(RELEASE, None)
            spark.conf.set(RELEASE, "true")
        _HELD["actions"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _HELD["actions"] -= 1
            if not _HELD["actions"]:
                if _HELD["before"] is None:
                    spark.conf.unset(RELEASE)
                else:
                    spark.conf.set(RELEASE, _HELD["before"])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lost executors cost no recomputation. What was shuffled for it goes."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame has the setting that held when it was made


def stored_for_now(df: DataFrame, *partition_by: str) -> tuple[DataFrame, Callable[..., None]]:
    """(df as a Parquet table in the shared folder, what deletes it or a part of it when nothing reads that any more)."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid4().hex}"
    with shuffles_released(spark):
        df.write.partitionBy(*partition_by).parquet(folder)

    def drop(part: str = "") -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}".rstrip("/"))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(folder), drop
