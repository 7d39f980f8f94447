"""Intermediate tables in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and Spark runs on this machine alone (tests, a laptop) a temporary
one is made, on a cluster that is an error. A written
table cuts lineage and survives the loss of any executor, which a local checkpoint would not.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tributary.errors import EngineError

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder of this application."""
    sc = spark.sparkContext
    if sc.applicationId not in _made:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local"):
                raise EngineError("NO_SHARED_FOLDER", "set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tributary-")
            atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
        _made[sc.applicationId] = base.rstrip("/")
    return _made[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tributary/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, that of the default file system where it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def local(path: str) -> str | None:
    """A file: URI or a path without a scheme as the driver's own path, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


class Files:
    """What a store does to files that aren't the driver's own, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, uri: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.path(uri).getFileSystem(self.conf)

    def path(self, uri: str):
        return self.jvm.org.apache.hadoop.fs.Path(uri)

    def exists(self, uri: str) -> bool:
        return self.fs.exists(self.path(uri))

    def folders(self, uri: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(uri)) if s.isDirectory()) if self.exists(uri) else []

    def delete(self, uri: str) -> None:
        self.fs.delete(self.path(uri), True)

    def read(self, uri: str) -> str:
        stream = self.fs.open(self.path(uri))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, uri: str, data: bytes, new: bool = False) -> None:
        """Write a file; with ``new`` it fails where the file is there already."""
        stream = self.fs.create(self.path(uri), not new)
        try:
            stream.write(data)
        finally:
            stream.close()

    def replace(self, a: str, b: str) -> None:
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(a), self.path(b), how)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its own schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when no result that reads them is needed any more."""
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tributary")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
