"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .annsearch import nearest_records
from .clusters import described, similarity_groups
from .copies import collapse, copies
from .leaks import leaked
from .mixture import mixture
from .mojibake import restored
from .simjoin import similar_pairs
from .subset import varied_subset


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "logp_data")
    return nearest_records(rows, id_col="rec_id", text_col="SMILES", by="delivery_id", k=5, min_similarity=0.7)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = _neighbours(spark, d)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d)


def p3_subset(spark: SparkSession, d: str) -> DataFrame:
    return varied_subset(_table(spark, d, "logp_data"), id_col="rec_id", text_col="SMILES", share=0.01)


def p3_size(spark: SparkSession, d: str) -> DataFrame:
    """How many records were chosen, how many different and known ones among them, and how many they stand for."""
    known = _table(spark, d, "logp_data").select(F.col("rec_id").alias("id")).distinct()
    chosen = materialize(p3_subset(spark, d), "chosen")
    valid = chosen.join(known, "id", "left_semi").agg(F.countDistinct("id").alias("n_valid"))
    # one row each
    return chosen.agg(F.count(F.lit(1)).alias("n"), F.sum("n_group").alias("n_records")).join(F.broadcast(valid))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "logp_data")
    return similar_pairs(rows, id_col="rec_id", text_col="SMILES", by="delivery_id", threshold=0.8).select("id_a", "id_b")


def p4_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "logp_data")
    return similar_pairs(rows, id_col="rec_id", text_col="SMILES", by="delivery_id", threshold=0.8)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return similarity_groups(_table(spark, d, "logp_data"), id_col="rec_id", text_col="SMILES", by="delivery_id", threshold=0.7)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    groups = materialize(_groups(spark, d), "groups")
    large = groups.groupBy("first_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("first_id")
    return groups.where("id <> first_id").join(large, "first_id", "left_semi").select("first_id", F.col("id").alias("rec_id"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return described(_table(spark, d, "logp_data"), materialize(_groups(spark, d), "groups"), id_col="rec_id", text_col="SMILES")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(_table(spark, d, "logp_data"), id_col="rec_id", first_col="SMILES_n", second_col="SMILES")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "logp_data")
    return collapse(rows, copies(rows, id_col="rec_id", first_col="SMILES_n", second_col="SMILES"), id_col="rec_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaked(_table(spark, d, "documents"), _table(spark, d, "eval_item"), id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture(_table(spark, d, "documents"), _table(spark, d, "source_weight"), id_col="doc_id", text_col="text", source_col="source", below=["lang"])


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A mixture of domain (short and long texts), language and source that asks some sources for more than they have."""
    docs = _table(spark, d, "documents").withColumn("domain", F.when(F.col("n_chars") < 1500, "short").otherwise("long"))
    total = 2 * (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 3
    return mixture(docs, _table(spark, d, "source_weight"), id_col="doc_id", text_col="text", source_col="source", below=["domain", "lang"], total=total)


def p8_tree(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source keeps its cap, how often its documents may be used at most, and whether all it can give is given if it falls short."""
    report = _tree(spark, d)[1].alias("r")
    caps = _table(spark, d, "source_weight").select("source", "max_repeats")
    most = F.col("available") * F.col("max_repeats")
    whole = F.sum("tokens").over(Window.partitionBy())  # one row a source
    share = F.col("tokens") / whole
    rows = report.join(caps, "source").withColumn("share", share)
    return rows.select("source", "max_repeats", (F.col("tokens") <= most).alias("within_cap"), ((F.col("share") >= F.col("target_share") - 0.01) | (F.col("tokens") >= 0.99 * most)).alias("no_spare"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return restored(_table(spark, d, "documents"), id_col="doc_id", text_col="text").select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored(_table(spark, d, "documents"), id_col="doc_id", text_col="text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_nearest, p3_subset, p3_size, p4_found, p4_similarity, p5_found, p5_groups, p6_found, p6_counts, p7_found, p7_items, p8_mixture, p8_shares, p8_tree, p9_found, p9_restored)}
