"""Folders that the driver and all executors share, and what Python code on executors needs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from stratalog.errors import InvalidInput


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set, else the context's checkpoint folder, else, on one machine, a temporary folder. On a cluster there is no other: what its machines share can't be guessed, so that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise InvalidInput("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/stratalog"
    return root.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared root. It lives as long as the driver, because results read it when they are asked for; the driver deletes it as it ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


#: Schemes of Hadoop's file systems that Arrow knows by another name.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfss": "abfss", "abfs": "abfs"}


def arrow_folder(uri: str):
    """(file system, path) of a folder for Python code on executors. A scheme that Arrow can't open is an error that names it."""
    from pyarrow import ArrowException, fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    scheme, mark, rest = uri.partition("://")
    if not mark:
        return fs.LocalFileSystem(), uri
    try:
        return fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}")
    except (ArrowException, OSError, ValueError) as e:
        raise InvalidInput(f"executors can't write raw files to {scheme}:// ({e}); set spark.checkpoint.dir to file, hdfs, s3a, gs or abfss") from e


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package as a file of the session, once, unless PYTHONPATH has it for them too."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    folder = tempfile.mkdtemp()  # the driver's file server reads it until the session ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/stratalog.zip", "w") as z:
        for p in sorted((root / "stratalog").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(f"{folder}/stratalog.zip")
