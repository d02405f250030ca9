"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Unset, a folder in the warehouse serves, unless that is a local folder of
    machines that share none.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_docgrid"
    local = spark.sparkContext.master.split("[")[0] == "local"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    scheme = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    if scheme == "file" and not local:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return where


def _fs(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def forget(spark: SparkSession, where: str) -> None:
    """Remove a table that no plan reads any more."""
    try:
        fs, path = _fs(spark, where)
        fs.delete(path, True)
    except Exception:  # the session may have ended
        return


def fingerprint(spark: SparkSession, where: str) -> tuple[int, int, int]:
    """What tells one state of a table's files from another: bytes, files, time of the last change of the folder."""
    fs, path = _fs(spark, where)
    held = fs.getContentSummary(path)
    return held.getLength(), held.getFileCount(), fs.getFileStatus(path).getModificationTime()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, until it is forgotten or the driver ends."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/docgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    atexit.register(forget, spark, where)
    return spark.read.schema(df.schema).parquet(where), where
