"""Tables in and out: parquet, CSV of structures, and what clustering rounds leave behind."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for null in CSV.
NULL = "\\N"
LOGP = "DATABASE_ID string, NAME string, SMILES_n string, SMILES string, logPN double, logPI double"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_structures(spark: SparkSession, path: str, schema: str = LOGP, line_breaks: bool = False) -> DataFrame:
    """CSV with a header and quoted fields under a declared schema; files whose fields hold line breaks aren't split."""
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=line_breaks, nullValue=NULL, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_structures(df: DataFrame, path: str) -> None:
    """The same format: all fields quoted, line breaks kept, nulls told from empty strings."""
    df.write.csv(path, header=True, quoteAll=True, escape='"', nullValue=NULL, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_table(df: DataFrame, path: str, overwrite: bool = False, by: str | None = None) -> None:
    """Parquet; a folder with content is an error unless it may be overwritten."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(by) if by else w).parquet(path)


def write_round(features: DataFrame, folder: str, number: int, overwrite: bool = False) -> None:
    """Features of one clustering round; their ids stay in the rows."""
    write_table(features, os.path.join(folder, f"round={number}"), overwrite)


def read_round(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Features of a round in the order they are to enter the next: size class, then size, both falling."""
    rows = spark.read.parquet(os.path.join(folder, f"round={number}"))
    grade = sum((F.col("n") >= x).cast("int") for x in (254, 65534, 4294967294))
    return rows.orderBy(grade.desc(), F.desc("n"), F.array_min("ids"))


def write_clusters(clusters: DataFrame, path: str, overwrite: bool = False) -> None:
    """``cluster_id``, ``n``, ``ids``, the largest cluster first, as the clusters of one tree are numbered."""
    write_table(clusters.select((F.col("ord") + 1).alias("cluster_id"), "n", "ids"), path, overwrite)
