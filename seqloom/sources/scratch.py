"""Scratch tables in the folder that driver and executors share.

An operator that reads an intermediate result more than once writes it there as Parquet and reads
it back: lineage ends, and a lost executor costs nothing. All tables of an application lie in one
folder, which is deleted when the application ends; :func:`discard` deletes a table before that.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where the session names none and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder of scratch tables."""
    key = spark.sparkContext.applicationId, shared_dir(spark)
    if key not in _FOLDERS:
        folder = f"{key[1].rstrip('/')}/seqloom-{uuid.uuid4().hex[:12]}"
        fs, where = _hadoop(spark, folder)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _FOLDERS[key] = folder
    return f"{_FOLDERS[key]}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    vars(out)["_scratch_path"] = path
    return out


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, written by the driver through the file system that the path names."""
    fs, where = _hadoop(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as a table's location needs it."""
    fs, where = _hadoop(spark, path)
    return fs.makeQualified(where).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` returned and nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, vars(table)["_scratch_path"])
