"""Session settings shared by the operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process and not yet released.
_written: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where unset (tests), a folder is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.getCheckpointDir():
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tanisum-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the tables that materialize() has written, once no result that reads them is needed any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
