"""Where jobs keep intermediate tables: the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of the sessions that have none, by application.
_TEMPORARY: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # Spark lets nobody set this name once a session runs
        folder = _TEMPORARY.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="spark-")
        _TEMPORARY[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A place in the shared folder that nothing else uses, among the application's own."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage and pins the rows: a lost executor costs a re-read of the files, never a
    second evaluation of the plan behind them.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once its successor stands."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that :func:`written` made in this application, once nothing reads them any more.

    What an application that was killed has left lies under its id and can go in the same way.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
