"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for tables that must outlive an executor.

    A temporary folder stands in on a single machine only; on a cluster no other
    node could read it.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all nodes can read and write")
    return _folder_of_this_machine()


@cache
def _folder_of_this_machine() -> str:
    return tempfile.mkdtemp(prefix="absentia-")


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Write a table that several results read and read it back.

    Later jobs start from the files: a lost executor costs a re-read, not the
    scan and shuffle behind the table.
    """
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """The file context of a path's store, and the path itself."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        place.toUri() if place.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf),
        conf,
    )
    return context, place


def exists(spark: SparkSession, path: str) -> bool:
    context, place = _hadoop(spark, path)
    return context.util().exists(place)


def publish(spark: SparkSession, staged: str, final: str) -> bool:
    """Give a finished folder its name in one step; False if the name is taken.

    Where a store renames folders in one step, readers see all of it or nothing, and of
    two attempts one wins. The staged folder of the other is deleted.
    """
    context, source = _hadoop(spark, staged)
    target = spark._jvm.org.apache.hadoop.fs.Path(final)
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(rename, 0)
    if not context.util().exists(target):
        context.mkdir(target.getParent(), spark._jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
        try:
            context.rename(source, target, none)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
    context.delete(source, True)
    return False


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file."""
    context, place = _hadoop(spark, path)
    return context.getFileStatus(place).getLen()


def remove(spark: SparkSession, path: str) -> None:
    context, place = _hadoop(spark, path)
    if context.util().exists(place):
        context.delete(place, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under a path, but hidden ones."""
    context, place = _hadoop(spark, path)
    if not context.util().exists(place):
        return []
    names = [(s.getPath().getName(), s.isDirectory()) for s in context.util().listStatus(place)]
    return sorted(n for n, is_folder in names if is_folder and n[0] not in "._")
