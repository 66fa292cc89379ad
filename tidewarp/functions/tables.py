"""Written cuts of lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local-mode session without that setting gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="tidewarp-series-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/tidewarp-series/{what}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read back: a lost executor costs nothing before it, and plans know its size."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Delete what this session has written so; frames that read it can't be used afterwards."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _written.pop(spark.sparkContext.applicationId, []):
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
