"""A folder that driver and executors share, for tables and files that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="shelfspark-"))
    return _LOCAL[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before the process
        pass


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/shelfspark-{uuid.uuid4().hex}-{name}"
    atexit.register(_remove, spark, path)
    return path


def save(df: DataFrame) -> DataFrame:
    """The same rows, written once: what is read from them depends on no earlier stage and no executor's memory."""
    path = fresh(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
