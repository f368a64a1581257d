"""Clusters fingerprints in rounds: ``spark-submit`` or ``python -m tanisum.cluster --in-dir IN --out-dir OUT``.

IN is a folder of npy files (packed or 0/1 rows, named ``*_<file>_<first id>.npy``) or of parquet with ``id`` and ``words``.
"""

from __future__ import annotations

import argparse
import contextlib

from pyspark.sql import DataFrame, SparkSession

from .. import model
from ..sources import memory, npy, tables
from . import batch


def parsed(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tanisum.cluster", description=__doc__)
    p.add_argument("--in-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--bits", type=int, default=2048)
    p.add_argument("--threshold", type=float, default=0.65)
    p.add_argument("--tolerance", type=float, default=0.05)
    p.add_argument("--branching-factor", type=int, default=50)
    p.add_argument("--bin-size", type=int, default=10)
    p.add_argument("--rows-per-part", type=int, default=10_000)
    p.add_argument("--max-files", type=int)
    p.add_argument("--max-fps", type=int, help="rows read of each file")
    p.add_argument("--num-processes", type=int, default=10, help="tasks at a time, where no cluster is given")
    p.add_argument("--idxs-are-slices", action="store_true", help="file names end in first id and end")
    p.add_argument("--unpacked", action="store_true", help="rows hold one bit an element")
    p.add_argument("--no-double-cluster-init", dest="double_init", action="store_false", help="don't break up the parts' largest clusters")
    p.add_argument("--only-first-round", action="store_true")
    p.add_argument("--no-overwrite-outputs", dest="overwrite", action="store_false", help="stop where there is output already")
    p.add_argument("--monitor-rss", metavar="CSV", help="write a trace of the memory of this process and those below it")
    return p.parse_args(args)


def read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    try:
        found = npy.listed(a.in_dir)
    except (OSError, ValueError):  # a file system that only Spark knows
        found = []
    if not found:
        return model.from_packed(spark.read.parquet(a.in_dir), "id", "words", a.bits)
    npy.register(spark)
    given = {"slices": str(a.idxs_are_slices), "unpack": str(not a.unpacked), "maxFiles": a.max_files, "maxRowsPerFile": a.max_fps}
    source = spark.read.format("npy").options(**{k: v for k, v in given.items() if v is not None})
    return model.from_dense(source.load(a.in_dir), "id", "row")


def session(tasks: int) -> SparkSession:
    builder = SparkSession.builder.appName("cluster")
    if SparkSession.getActiveSession() is None:
        from pyspark import SparkConf

        if not SparkConf().contains("spark.master"):
            builder = builder.master(f"local[{tasks}]")
    return builder.getOrCreate()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parsed(args)
    spark = spark or session(a.num_processes)
    with memory.RssTrace(a.monitor_rss) if a.monitor_rss else contextlib.nullcontext():
        found = batch.rounds(
            read(spark, a), a.bits, rows_per_part=a.rows_per_part, bin_size=a.bin_size, threshold=a.threshold, tolerance=a.tolerance, branching=a.branching_factor, double_init=a.double_init, only_first=a.only_first_round
        )
        if a.only_first_round:
            tables.write_round(found, a.out_dir, 1, a.overwrite)
        else:
            tables.write_clusters(found, a.out_dir, a.overwrite)
    print(f"peak memory, MB: {memory.peak_mb()}")


if __name__ == "__main__":
    main()
