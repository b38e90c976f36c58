"""Folders on any file system that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that ``spark.checkpoint.dir`` names; a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siltstone-")
    return f"{root.rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    files, place = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder; False if it is already gone."""
    files, place = _at(spark, path)
    return bool(files.delete(place, True)) if files.exists(place) else False
