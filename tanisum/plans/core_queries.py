"""Registered queries of the core operators.

Set operators run over the sign bits of ``embeddings`` (64 bits), the packed
fingerprints of ``fp_packed`` (256 bits) and the brands that customers bought
(``basket``, 25 bits); real ones over scaled ``embeddings`` and ``rv``. All
doubles are rounded to eight places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..cluster import batch
from ..operators import badrows, compsim, isim, normalize, pairwise, real, sampling, sigma
from ..session import materialize, work_dir
from ..sources import npy
from ..sources.tables import read as _table
from ..sources.tables import read_structures, write_structures
from ..streaming import online

M_EMB, M_FP, M_BASKET = 64, 256, 25
Query = Callable[[SparkSession, str], DataFrame]


def _r(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    # -0.0 and 0.0 are one value
    c = F.round(c, 8) + F.lit(0.0)
    return c.alias(name) if name else c


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r(c, c) if t == "double" else F.col(c) for c, t in df.dtypes])


# inputs


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return model.from_signs(_table(spark, d, "embeddings"), "vec_id", "embedding")


def _fp(spark: SparkSession, d: str) -> DataFrame:
    """Packed fingerprints, each id once; written down, as operators read them twice."""
    return model.from_packed(materialize(model.distinct_ids(_table(spark, d, "fp_packed").select("id", "words")), "fp"), "id", "words", M_FP)


def _basket(spark: SparkSession, d: str) -> DataFrame:
    """Which of 25 brands each customer bought."""
    brands = _table(spark, d, "part").select("p_partkey", (F.substring("p_brand", 7, 2).cast("int") - 1).alias("bit"))
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    orders = _table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return model.from_long(bought.select("id", "bit").distinct())


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return normalize.minmax(_vectors(spark, d))


def _descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors, each record once."""
    return model.distinct_ids(_table(spark, d, "rv").where("id is not null").select("id", "v"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return compsim.comp_sim(_emb(spark, d), M_EMB)


# lines that fail to parse


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected(badrows.logp_lines(_table(spark, d, "logp_raw"))).select("raw_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    lines = badrows.rejected(badrows.logp_lines(_table(spark, d, "logp_raw")))
    return lines.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return badrows.loaded(badrows.logp_lines(_table(spark, d, "logp_raw")))


# set similarity


def isim_index(spark: SparkSession, d: str) -> DataFrame:
    got = isim.with_counters(isim.stats(_emb(spark, d), M_EMB))
    return got.select("n", *[_r(isim.index(k), k.lower()) for k in ("JT", "RR", "SM")])


def isim_basket(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(isim.all_indices(_basket(spark, d), M_BASKET))


def isim_packed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(isim.all_indices(_fp(spark, d), M_FP))


def _index_query(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(isim.isim(_emb(spark, d), M_EMB, kind))

    return run


def isim_all_indices(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(isim.all_indices(_emb(spark, d), M_EMB))


def isim_counters(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(isim.with_counters(isim.stats(_emb(spark, d), M_EMB)).drop("c"))


def isim_counters_k2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(isim.with_counters(isim.stats(_emb(spark, d), M_EMB), 2).drop("c"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).join(_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")


def isim_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(isim.isim(_labelled(spark, d), M_EMB, by="label"))


def centroid_by_label(spark: SparkSession, d: str) -> DataFrame:
    got = isim.centroids(isim.stats(_labelled(spark, d), M_EMB, "label"))
    return got.select("label", F.explode("on").alias("bit"))


def column_sums(spark: SparkSession, d: str) -> DataFrame:
    return isim.stats(_fp(spark, d), M_FP).select(F.posexplode("c").alias("bit", "c"))


# layouts


def pack_words(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).select("id", model.to_packed(F.col("on"), M_EMB)[0].alias("word"))


def unpack_bits(spark: SparkSession, d: str) -> DataFrame:
    return model.to_long(_fp(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n_on"), F.sum("bit").alias("bit_sum"))


def popcounts(spark: SparkSession, d: str) -> DataFrame:
    rows = model.distinct_ids(_table(spark, d, "fp_packed").select("id", "words"))
    return rows.select("id", model.popcount(F.col("words")).alias("n_on"))


def flip_counts(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).select("id", F.size(model.flipped(F.col("on"), M_EMB)).alias("n_off"))


def union_words(spark: SparkSession, d: str) -> DataFrame:
    """Column sums of two halves, added up."""
    fp = _emb(spark, d)
    half = lambda k: isim.stats(fp.where(F.col("id") % 2 == k), M_EMB).select(F.col("c").alias(f"c{k}"))
    # two tables of one row
    return half(0).join(F.broadcast(half(1))).select(F.posexplode(isim.merged(F.col("c0"), F.col("c1"))).alias("bit", "c"))


# leaving one out


def _comp_query(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(compsim.comp_sim(_emb(spark, d), M_EMB, kind))

    return run


def comp_sim_packed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(compsim.comp_sim(_fp(spark, d), M_FP))


def medoid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(compsim.medoid(_scores(spark, d)))


def outlier(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(compsim.outlier(_scores(spark, d)))


# samples


def sample_medoid(spark: SparkSession, d: str) -> DataFrame:
    return sampling.medoid_sample(_scores(spark, d))


def sample_outlier(spark: SparkSession, d: str) -> DataFrame:
    return sampling.outlier_sample(_scores(spark, d))


def sample_extremes(spark: SparkSession, d: str) -> DataFrame:
    return sampling.extremes_sample(_scores(spark, d))


def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(_scores(spark, d))


def sample_strata7(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(_scores(spark, d), 10, 7)


def sample_quota(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_sample(_scores(spark, d), 10, 10)


def sample_quota_soft(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_sample(_scores(spark, d), 10, 10, hard_cap=False)


def sample_random(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_sample(_emb(spark, d).select("id"), 50)


def mixed_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Each fingerprint's bits against the packed words of the one of least id."""
    fp = _emb(spark, d)
    # one row
    least = fp.orderBy("id").limit(1).select(model.to_packed(F.col("on"), M_EMB).alias("words"))
    return _rounded(fp.join(F.broadcast(least)).select("id", pairwise.tanimoto_mixed(F.col("on"), F.col("words"), M_EMB).alias("sim")))


def centroid_of_ids(spark: SparkSession, d: str) -> DataFrame:
    """Majority bits of the objects with a listed id."""
    ids = _table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return isim.centroids(isim.stats(model.gathered(_emb(spark, d), ids), M_EMB)).select(F.explode("on").alias("bit"))


def sample_medoid_packed(spark: SparkSession, d: str) -> DataFrame:
    return sampling.medoid_sample(compsim.comp_sim(_fp(spark, d), M_FP), 1)


# pairs


def _pair_query(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(pairwise.average(_emb(spark, d), M_EMB, kind))

    return run


def pairwise_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pairwise.matrix(_emb(spark, d), M_EMB))


def one_against_many(spark: SparkSession, d: str) -> DataFrame:
    """Every packed fingerprint against that of the least id."""
    rows = model.distinct_ids(_table(spark, d, "fp_packed").select("id", "words"))
    return _rounded(pairwise.against(rows, rows.orderBy("id").limit(1)))


def topk_neighbors(spark: SparkSession, d: str) -> DataFrame:
    fp = _emb(spark, d)
    return _rounded(pairwise.nearest(fp, fp.where(F.col("id") % 50 == 0), M_EMB))


# real vectors


def minmax(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scaled(spark, d).select("id", F.posexplode("v").alias("pos", "x")))


def minmax_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(normalize.minmax(_descriptors(spark, d)).select("id", F.posexplode("v").alias("pos", "x")))


def drop_nan_columns(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(normalize.without_nan(_descriptors(spark, d)).select("id", F.posexplode("v").alias("pos", "x")))


def _real_isim_query(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(real.isim(_scaled(spark, d), kind))

    return run


def real_isim_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(real.isim(normalize.minmax(_descriptors(spark, d))))


def _real_comp_query(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(real.comp_sim(_scaled(spark, d), kind))

    return run


def real_medoid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(compsim.medoid(real.comp_sim(_scaled(spark, d))))


def real_outlier(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(compsim.outlier(real.comp_sim(_scaled(spark, d))))


def _real_pair_query(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rv = _scaled(spark, d)
        return _rounded(pairwise.average_real(rv, normalize.width(rv), kind))

    return run


def real_pair_functions(spark: SparkSession, d: str) -> DataFrame:
    """Each scaled vector against its own complement."""
    rv = _scaled(spark, d)
    return rv.select("id", *[_r(real.pair(k, F.col("v"), normalize.complement(F.col("v"))), k.lower()) for k in real.KINDS], _r(real.pair("RR", F.col("v"), normalize.squared(F.col("v")), 10), "rr10"))


# dispersion


def _sigma_query(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(sigma.fast(_emb(spark, d), M_EMB, kind))

    return run


def sigma_packed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sigma.fast(_fp(spark, d), M_FP, "RR"))


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return sigma.cooccurrence(_basket(spark, d), M_BASKET)


def stratified_sigma(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sigma.stratified(_emb(spark, d), M_EMB))


def random_sigma(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sigma.at_random(_emb(spark, d), M_EMB))


# clusters; flat ones have a tree of one leaf, which SQL can follow

FLAT = 1000


def _flat_query(method: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return batch.assignments(batch.exact(_emb(spark, d), M_EMB, method=method, threshold=0.4, branching=FLAT))

    return run


def _deep_query(method: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = _checked(batch.exact(_emb(spark, d), M_EMB, method=method, threshold=0.4))
        # a radius says nothing about the set's similarity
        return found.drop("similar") if method == "radius" else found

    return run


def _checked(clusters: DataFrame) -> DataFrame:
    """Sums, sizes and ids over all clusters; a tree of several levels has no SQL but must lose nothing."""
    return batch.checked(clusters, 0.4).select("bit", F.col("total").cast("long").alias("total"), "objects", "ids", "similar")


def _exact(spark: SparkSession, d: str, branching: int) -> DataFrame:
    return batch.exact(_emb(spark, d), M_EMB, threshold=0.4, branching=branching)


def cluster_by_label(spark: SparkSession, d: str) -> DataFrame:
    found = batch.exact(_labelled(spark, d), M_EMB, by="label", threshold=0.4)
    return found.select("label", "n", F.explode("ids").alias("id")).groupBy("label").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("id").alias("ids"), F.sum("id").alias("id_sum"))


def cluster_flat_by_label(spark: SparkSession, d: str) -> DataFrame:
    found = batch.exact(_labelled(spark, d), M_EMB, by="label", threshold=0.4, branching=FLAT)
    return found.select("label", "ord", "n", F.array_min("ids").alias("first_id"))


def cluster_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _checked(batch.rounds(_emb(spark, d), M_EMB, rows_per_part=200, bin_size=3, threshold=0.4)).drop("similar")


def cluster_flat_rounds(spark: SparkSession, d: str) -> DataFrame:
    return batch.round_assignments(_emb(spark, d), M_EMB, rows_per_part=200, bin_size=3, threshold=0.4, branching=FLAT)


def cluster_flat_centroids(spark: SparkSession, d: str) -> DataFrame:
    return batch.centroids(_exact(spark, d, FLAT)).select("ord", "n", F.size("on").alias("n_on"))


def cluster_flat_refined(spark: SparkSession, d: str) -> DataFrame:
    """The largest cluster broken up into its objects, after the other clusters."""
    rest, singles = batch.largest_broken_up(_exact(spark, d, FLAT), _emb(spark, d), M_EMB)
    return rest.select("n", "ids").unionByName(singles.select("n", "ids")).select("n", F.array_min("ids").alias("first_id"))


def cluster_poles(spark: SparkSession, d: str) -> DataFrame:
    """The two sides that a node of all embeddings would split into."""
    return batch.halves(_emb(spark, d), M_EMB)


def cluster_packed_checked(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all packed fingerprints, made in parts by diameter."""
    found = batch.rounds(_fp(spark, d), M_FP, rows_per_part=1000, threshold=0.4, only_first=True, double_init=False)
    return _checked(found)


# sources and streams


def npy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Packed fingerprints' bits written to and read from numpy files, under ids with gaps."""
    # a path that all executors see, as the shared folder is
    folder = f"{work_dir(spark)}/npy-{uuid.uuid4().hex}"
    npy.save(model.dense_rows(_fp(spark, d), M_FP), folder)
    back = spark.read.format("npy").option("slices", "true").load(folder)
    return model.from_dense(back, "id", "row").select("id", F.explode("on").alias("bit"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Structures with nulls, quotes and line breaks written to and read from CSV."""
    rows = _table(spark, d, "logp_data").select("DATABASE_ID", "NAME", "SMILES_n", "SMILES", "logPN", "logPI")
    folder = f"{work_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_structures(rows, folder)
    back = read_structures(spark, folder, line_breaks=True)
    sums = [F.sum(F.length(c)).alias(f"{c}_chars") for c in ("NAME", "SMILES_n", "SMILES")] + [F.count(c).alias(f"{c}_given") for c in ("NAME", "SMILES", "logPN")]
    return back.select(F.count(F.lit(1)).alias("n"), *sums, F.countDistinct("NAME").alias("names"), F.countDistinct("SMILES").alias("structures"))


def _online(spark: SparkSession, d: str, branching: int) -> DataFrame:
    """Clusters of the embeddings' sign bits that came in two batches."""
    fp = _emb(spark, d)
    clusters = online.OnlineClusters(f"{work_dir(spark)}/online-{uuid.uuid4().hex}", M_EMB, threshold=0.4, branching=branching)
    for k in (0, 1):
        clusters.update(fp.where(F.col("id") % 2 == k), k)
    return clusters.snapshot(spark, 1)


def stream_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_online(spark, d, 50)).drop("similar")


def stream_flat_clusters(spark: SparkSession, d: str) -> DataFrame:
    return batch.assignments(_online(spark, d, FLAT))


def stream_isim(spark: SparkSession, d: str) -> DataFrame:
    """Set similarity of packed fingerprints that came as a stream of several batches."""
    folder = work_dir(spark)
    name = f"live_{uuid.uuid4().hex}"
    _table(spark, d, "fp_packed").repartition(4).write.parquet(f"{folder}/{name}-in")
    source = spark.readStream.schema("id long, words array<long>").option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}-in")
    sums = online.live_sums(model.from_packed(source, "id", "words", M_FP), M_FP)
    # complete mode: the sums are m + 1 rows
    query = sums.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    if len([p for p in query.recentProgress if p["numInputRows"]]) < 2:
        raise RuntimeError("the stream came in one batch")
    return _rounded(online.isim_of(spark.table(name), M_FP))


def queries() -> dict[str, Query]:
    named = (
        p1_found, p1_reasons, p1_loaded, isim_index, isim_basket, isim_packed, isim_all_indices, isim_counters, isim_counters_k2, isim_by_label, centroid_by_label,
        column_sums, pack_words, unpack_bits, popcounts, flip_counts, union_words, comp_sim_packed, medoid, outlier, sample_medoid, sample_outlier,
        sample_extremes, sample_stratified, sample_strata7, sample_quota, sample_quota_soft, sample_medoid_packed, pairwise_matrix, one_against_many,
        topk_neighbors, minmax, minmax_descriptors, drop_nan_columns, real_isim_descriptors, real_medoid, real_outlier, real_pair_functions, sigma_packed, cooccurrence,
        stratified_sigma, random_sigma, cluster_poles, cluster_packed_checked, cluster_by_label, cluster_flat_by_label, cluster_rounds, cluster_flat_rounds, cluster_flat_centroids, cluster_flat_refined,
        stream_clusters, stream_flat_clusters, npy_round_trip, csv_round_trip, sample_random, mixed_layouts, centroid_of_ids, stream_isim,
    )
    found: dict[str, Query] = {f.__name__: f for f in named}
    for kind in ("JT", "RR", "SM"):
        k = kind.lower()
        found |= {f"isim_index_{k}": _index_query(kind), f"comp_sim_{k}": _comp_query(kind), f"pairwise_{k}_avg_std": _pair_query(kind), f"real_isim_{k}": _real_isim_query(kind)}
        found |= {f"real_comp_sim_{k}": _real_comp_query(kind), f"real_pairwise_{k}": _real_pair_query(kind), f"sigma_{k}": _sigma_query(kind)}
    for method in ("radius", "diameter", "tolerance", "tolerance_tough"):
        found |= {f"cluster_exact_{method}": _deep_query(method), f"cluster_flat_{method}": _flat_query(method)}
    return found
