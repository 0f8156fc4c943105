"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task where tables are dealt by a key and sorted or joined several times.
ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset a temporary folder is made, on a local master only."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="metricspark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def kept(df: DataFrame, kind: str) -> DataFrame:
    """df written as a table of the shared folder and read again, for plans that read it several times; it survives lost executors."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts(table: DataFrame) -> int:
    """Partitions in which what comes of a kept table's rows is dealt by a key: ROWS each, and one for each core at least.

    Spark joins small partitions by their bytes in the shuffle. Rows that are much alike shrink
    to a fiftieth there, so tasks grow with the input; a number that is asked for stays. The
    count is read from the files' footers.
    """
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // ROWS))
