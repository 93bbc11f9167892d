"""Paths as Spark and its Python workers both understand them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark resolves it: one without a scheme lies on the default file system, wherever that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return re.sub("^file:/+", "file:///", uri).rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a local session has a folder of its own; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/vantalume-{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


class Resolver:
    """qualified() for workers, without the driver: where paths without a scheme lie is asked once."""

    def __init__(self, spark: SparkSession) -> None:
        fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        self.root, self.here = fs.getUri().toString().rstrip("/"), fs.getWorkingDirectory().toUri().toString()

    def __call__(self, path: str) -> str:
        if not re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", path):
            path = f"{self.root}{path}" if path.startswith("/") else f"{self.here.rstrip('/')}/{path}"
        return re.sub("^file:/+", "file:///", path)


def opened(uri: str):
    """(file system, path) of a qualified path, for a worker that writes or reads files itself."""
    from pyarrow import fs

    if uri.startswith("file:"):  # any character may stand in a local name
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it, if it exists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
