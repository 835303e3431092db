"""Tables written between two steps of one job.

They go to the folder the cluster shares (``spark.checkpoint.dir``), so a lost
executor costs a re-read, not a recomputation with possibly other partition
bounds.
"""
from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
#: Where the tables of ``written`` lie, as long as they are in use.
_PATHS: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a local one is made only for a local master."""
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once nothing reads them any more."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
