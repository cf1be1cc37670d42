"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset a new folder does in local mode; executors elsewhere need a shared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends, or with ``clear``."""
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        folder = f"{shared_folder(spark).rstrip('/')}/quillspan/{application}-{uuid.uuid4().hex[:8]}"
        system, place = _file_system(spark, folder)
        system.mkdirs(place)
        system.deleteOnExit(place)
        _FOLDERS[application] = folder
    return f"{_FOLDERS[application]}/{tag}-{uuid.uuid4().hex}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables now, once no result that reads them is needed; whether there were any."""
    folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if folder is None:
        return False
    system, place = _file_system(spark, folder)
    return system.delete(place, True)
