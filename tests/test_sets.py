"""Set similarity, leave-one-out, sampling, pairs and dispersion: hand fixtures, identities, edges."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tanisum import model
from tanisum.operators import compsim, isim, normalize, pairwise, real, sampling, sigma

B4 = ["1100", "1010", "1110", "0001"]
R4 = [[0, 0.5, 1], [1, 0, 0.5], [0.5, 1, 0], [1, 1, 1]]


def bits(spark, rows):
    return model.from_dense(spark.createDataFrame([(i, [int(c) for c in r]) for i, r in enumerate(rows)], "id long, bits array<int>"), "id", "bits")


def reals(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>")


def value(df, name):
    return df.collect()[0][name]


def near(a, b):
    return a == pytest.approx(b, abs=1e-9)


def test_all_indices(spark):
    got = isim.all_indices(bits(spark, B4), 4).collect()[0].asDict()
    want = {"AC": 0.446699620962, "BUB": 5 / 12, "Fai": 5 / 16, "Gle": 5 / 12, "Ja": 15 / 29, "JT": 5 / 19, "RT": 5 / 19, "RR": 5 / 24, "SM": 5 / 12, "SS1": 5 / 33, "SS2": 10 / 17}
    assert got == pytest.approx(want, abs=1e-9)
    assert near(value(isim.isim(bits(spark, B4), 4), "isim"), 5 / 19)


def test_counters_and_roots(spark):
    got = isim.with_counters(isim.stats(bits(spark, B4), 4)).collect()[0]
    assert (got["a"], got["d"], got["total_dis"], got["total_sim"], got["p"], got["c"]) == (5, 5, 14, 10, 24, [3, 2, 2, 1])
    root = isim.with_counters(isim.stats(bits(spark, B4), 4), 2).collect()[0]
    assert near(root["a"], math.sqrt(3) + 2)


def test_undefined_sets_give_null(spark):
    assert value(isim.isim(bits(spark, ["1010"]), 4), "isim") is None
    assert value(isim.isim(bits(spark, ["0000", "0000"]), 4), "isim") is None
    assert isim.isim(bits(spark, []), 4).count() <= 1
    with pytest.raises(ValueError):
        isim.isim(bits(spark, B4), 4, "XX")
    with pytest.raises(ValueError):
        isim.with_counters(isim.stats(bits(spark, B4), 4), 0)


def test_groups_and_centroids(spark):
    fp = bits(spark, B4).withColumn("g", F.when(F.col("id") == 3, "b").otherwise("a"))
    got = {r["g"]: r["isim"] for r in isim.isim(fp, 4, by="g").collect()}
    assert near(got["a"], 5 / 9) and got["b"] is None
    two = isim.centroids(isim.stats(bits(spark, [B4[0], B4[2]]), 4)).collect()[0]
    assert two["on"] == [0, 1, 2]


def test_leave_one_out(spark):
    fp = bits(spark, B4)
    for kind, want in {"JT": [1 / 5, 1 / 5, 1 / 9, 5 / 9], "RR": [1 / 6, 1 / 6, 1 / 12, 5 / 12], "SM": [1 / 3, 1 / 3, 1 / 3, 2 / 3]}.items():
        scores = compsim.comp_sim(fp, 4, kind)
        assert [r["comp_sim"] for r in scores.orderBy("id").collect()] == pytest.approx(want)
    assert value(compsim.medoid(compsim.comp_sim(fp, 4)), "id") == 2
    assert value(compsim.outlier(compsim.comp_sim(fp, 4)), "id") == 3
    assert value(compsim.medoid(compsim.comp_sim(fp, 4, "SM")), "id") == 0
    assert all(r["comp_sim"] is None for r in compsim.comp_sim(bits(spark, B4[:2]), 4).collect())


def test_leaving_one_out_is_the_set_without_it(spark):
    rng = np.random.default_rng(1)
    rows = ["".join(map(str, r)) for r in rng.integers(0, 2, (9, 12))] + ["0" * 12]
    scores = {r["id"]: r["comp_sim"] for r in compsim.comp_sim(bits(spark, rows), 12).collect()}
    for i in (0, 4, 9):
        rest = bits(spark, rows[:i] + rows[i + 1 :])
        assert near(value(isim.isim(rest, 12), "isim"), scores[i])


def test_pairs(spark):
    fp = bits(spark, B4)
    got = {(r["i"], r["j"]): r["sim"] for r in pairwise.matrix(fp, 4).collect()}
    assert got == pytest.approx({(0, 1): 1 / 3, (0, 2): 2 / 3, (0, 3): 0, (1, 2): 2 / 3, (1, 3): 0, (2, 3): 0} | {(i, i): 1 for i in range(4)})
    for kind, mean, std in (("JT", 0.277777777778, 0.299175822619), ("RR", 0.208333333333, 0.224381866964), ("SM", 0.416666666667, 0.276385399196)):
        row = pairwise.average(fp, 4, kind).collect()[0]
        assert near(row["mean"], mean) and near(row["std"], std)
        if kind != "JT":
            assert near(value(isim.isim(fp, 4, kind), "isim"), mean)
    assert pairwise.average(bits(spark, B4[:1]), 4).collect()[0]["mean"] is None


def test_pairs_over_several_blocks(spark, monkeypatch):
    rows = ["".join(map(str, r)) for r in np.random.default_rng(2).integers(0, 2, (40, 10))]
    one = pairwise.average(bits(spark, rows), 10).collect()[0]
    monkeypatch.setattr(pairwise, "BLOCK", 7)
    many = pairwise.average(bits(spark, rows), 10).collect()[0]
    assert near(one["mean"], many["mean"]) and near(one["std"], many["std"])
    fp = bits(spark, rows)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in pairwise.nearest(fp, fp.where("id in (3, 5)"), 10, 4).collect()}
    x = np.array([[int(c) for c in r] for r in rows], float)
    s = pairwise.pair_values(x, x, "JT")
    np.fill_diagonal(s, -1)
    for q in (3, 5):
        assert [got[q, k] for k in (1, 2, 3, 4)] == sorted(range(40), key=lambda j: (-s[q, j], j))[:4]


def test_one_against_many(spark):
    words = bits(spark, B4).select("id", model.to_packed(F.col("on"), 4).alias("words"))
    got = {r["id"]: r["sim"] for r in pairwise.against(words, words.where("id = 2")).collect()}
    assert got == pytest.approx({0: 2 / 3, 1: 2 / 3, 2: 1, 3: 0})
    zero = bits(spark, ["0000"]).select("id", model.to_packed(F.col("on"), 4).alias("words"))
    assert value(pairwise.against(zero, zero), "sim") is None


def test_layouts_round_trip(spark):
    rng = np.random.default_rng(3)
    rows = ["".join(map(str, r)) for r in rng.integers(0, 2, (6, 130))] + ["0" * 130, "1" * 130]
    fp = bits(spark, rows)
    words = fp.select("id", model.to_packed(F.col("on"), 130).alias("words"))
    back = model.from_packed(words, "id", "words", 130)
    want = {r["id"]: r["on"] for r in fp.collect()}
    assert {r["id"]: r["on"] for r in back.collect()} == want
    long = model.from_long(model.to_long(fp), fp)
    assert {r["id"]: r["on"] for r in long.collect()} == want
    assert {r["id"]: r["n"] for r in words.select("id", model.popcount(F.col("words")).alias("n")).collect()} == {i: len(o) for i, o in want.items()}
    assert [r["d"] for r in fp.orderBy("id").select(model.to_dense(F.col("on"), 130).alias("d")).collect()] == [[int(c) for c in r] for r in rows]
    assert fp.select(F.sort_array(model.flipped(F.col("on"), 130)).alias("f")).count() == 8
    assert spark.range(1).select(model.resized(F.array(F.lit(1).cast("long")), 3).alias("r")).collect()[0]["r"] == [1, 0, 0]


def test_dense_rows(spark):
    fp = spark.createDataFrame([(1, [0, 4]), (2, [])], "id long, on array<int>")
    assert {r["id"]: r["row"] for r in model.dense_rows(fp, 5).collect()} == {1: [1, 0, 0, 0, 1], 2: [0] * 5}
    with pytest.raises(Exception, match="beyond the 4"):
        model.dense_rows(fp, 4).collect()


def test_nulls_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [5]), (1, [5]), (None, [1]), (2, None)], "id long, words array<bigint>")
    fp = model.from_packed(df, "id", "words", 8)
    assert [r["on"] for r in fp.collect()] == [[0, 2], [0, 2]]
    assert model.distinct_ids(fp).count() == 1


def scores(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, comp_sim double")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_samples_from_either_end(spark):
    s = scores(spark, [0.5, 0.1, 0.9, 0.1, None, 0.3, 0.7, 0.2, 0.8, 0.4, 0.6])
    assert ids(sampling.medoid_sample(s, 30)) == [1, 3, 7]
    assert sorted(ids(sampling.outlier_sample(s, 30))) == [2, 6, 8]
    assert {(r["id"], r["side"]) for r in sampling.extremes_sample(s, 40).collect()} == {(1, "low"), (3, "low"), (2, "high"), (8, "high")}
    assert ids(sampling.outlier_sample(s, 1)) == [] == ids(sampling.medoid_sample(s, 0))
    with pytest.raises(ValueError):
        sampling.medoid_sample(s, 101)


def test_strata(spark):
    s = scores(spark, [i / 10 for i in range(7)])
    assert [r["id"] for r in sampling.stratified_sample(s, 43, 3).orderBy("ord").collect()] == [0, 3, 5]
    assert [r["id"] for r in sampling.stratified_sample(s, 72, 3).orderBy("ord").collect()] == [0, 3, 5, 1, 4]
    assert len(ids(sampling.stratified_sample(s, 100))) == 7
    for bad in ((1, None), (43, 4)):
        with pytest.raises(ValueError):
            sampling.stratified_sample(s, *bad)


def test_quota(spark):
    s = scores(spark, [0.0, 0.01, 0.02, 0.03, 0.04, 0.5, 0.51, 1.0])
    assert [r["id"] for r in sampling.quota_sample(s, 50, 2).orderBy("ord").collect()] == [0, 5, 1, 6]
    assert [r["id"] for r in sampling.quota_sample(s, 40, 3).orderBy("ord").collect()] == [0, 5, 7]
    assert [r["id"] for r in sampling.quota_sample(s, 50, 3, hard_cap=False).orderBy("ord").collect()] == [0, 5, 7, 1, 6]
    assert len(ids(sampling.quota_sample(s, 50, 1))) == 4
    flat = scores(spark, [0.5] * 6)
    assert [r["id"] for r in sampling.quota_sample(flat, 50, 3).orderBy("ord").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        sampling.quota_sample(s, 10, 3)


def test_ranks_span_partitions(spark):
    s = scores(spark, [((i * 7919) % 1000) / 1000 for i in range(1000)]).repartition(5)
    rows, n = sampling.ranked(s)
    got = {r["id"]: r["rank"] for r in rows.collect()}
    order = sorted(range(1000), key=lambda i: (((i * 7919) % 1000) / 1000, i))
    assert n == 1000 and got == {i: k for k, i in enumerate(order)}


def test_bits_beyond_the_width_are_refused(spark):
    fp = spark.createDataFrame([(1, [0, 9], "x"), (2, [1], "y")], "id long, on array<int>, g string")
    for run in (lambda: isim.stats(fp, 8).count(), lambda: isim.stats(fp, 8, "g").collect(), lambda: compsim.comp_sim(fp, 8).collect()):
        with pytest.raises(Exception, match="beyond the 8"):
            run()


def test_bins_follow_their_edges(spark):
    low, high, bins = 0.1, 0.7, 7
    step = (high - low) / bins
    scores = [low + i * step + d for i in range(bins + 1) for d in (-1e-17, 0, 1e-17, step / 3)] + [high]
    df = spark.createDataFrame([(s,) for s in scores], "s double").select("s", sampling.bin_of(F.col("s"), low, step, bins).alias("b"))
    for r in df.collect():
        assert r["b"] == max(sum(low + i * step <= r["s"] for i in range(bins)) - 1, 0)
    assert {r["b"] for r in df.where("s >= 0.5").select(sampling.bin_of(F.col("s"), 0.5, 0.0, 4).alias("b")).collect()} == {3}


def test_dispersion(spark):
    fp = bits(spark, B4)
    for kind, want in (("RR", 0.224381866964), ("SM", 0.276385399196), ("JT", 0.283429726691)):
        assert near(value(sigma.fast(fp, 4, kind), "sigma"), want)
    rows = ["".join(map(str, r)) for r in np.random.default_rng(4).integers(0, 2, (60, 16))]
    fp = bits(spark, rows)
    for kind in ("RR", "SM"):
        assert near(value(sigma.fast(fp, 16, kind), "sigma"), value(pairwise.average(fp, 16, kind), "std"))
    assert sigma.stratified(fp, 16, 20).collect()[0]["mean"] is not None
    one, two = (sigma.at_random(fp, 16, 20, seed=5).collect() for _ in range(2))
    assert one == two


def test_real_sets(spark):
    rv = reals(spark, R4)
    for kind, want, comp in (("JT", 0.421052631579, [7 / 15] * 3 + [1 / 4]), ("RR", 1 / 3, [7 / 18] * 3 + [1 / 6]), ("SM", 5 / 12, [4 / 9] * 3 + [1 / 3])):
        assert near(value(real.isim(rv, kind), "isim"), want)
        assert [r["comp_sim"] for r in real.comp_sim(rv, kind).orderBy("id").collect()] == pytest.approx(comp)
    assert value(compsim.medoid(real.comp_sim(rv)), "id") == 3 and value(compsim.outlier(real.comp_sim(rv)), "id") == 0
    assert near(value(real.isim(reals(spark, R4[:3])), "isim"), 1 / 4)
    assert value(real.isim(reals(spark, R4[:1])), "isim") is None
    assert near(value(pairwise.average_real(rv, 3, "RR"), "mean"), 1 / 3)


def test_real_sets_of_bits_are_binary_ones(spark):
    rv = reals(spark, [[int(c) for c in r] for r in B4])
    for kind in ("JT", "RR", "SM"):
        assert near(value(real.isim(rv, kind), "isim"), value(isim.isim(bits(spark, B4), 4, kind), "isim"))


def test_pair_functions(spark):
    row = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4], [0.5] * 4)], "a array<double>, b array<double>")
    jt, rr, sm, rr10 = row.select(*[real.pair(k, F.col("a"), F.col("b")).alias(k) for k in real.KINDS], real.pair("RR", F.col("a"), F.col("b"), 10).alias("x")).collect()[0]
    assert (jt, rr, sm, rr10) == pytest.approx((0.5 / (0.3 + 1 - 0.5), 0.125, 0.5, 0.05))
    with pytest.raises(ValueError):
        real.pair("XX", F.col("a"), F.col("b"))


def test_normalisation(spark):
    nan = float("nan")
    rv = reals(spark, [[1, 5, nan, 2], [3, 5, 1, 4], [2, 5, 2, 8]])
    assert [r["v"] for r in normalize.minmax(rv).orderBy("id").collect()] == [[0, 0], [1, 1 / 3], [0.5, 1]]
    assert [r["v"] for r in normalize.without_nan(rv).orderBy("id").collect()] == [[1, 5, 2], [3, 5, 4], [2, 5, 8]]
    assert normalize.minmax(reals(spark, [])).count() == 0
    two = normalize.minmax(reals(spark, [[0.1, 0.2, 0.3, 0.4], [0.5] * 4]))
    assert [r["v"] for r in two.orderBy("id").collect()] == [[0] * 4, [1] * 4]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=6, max_size=6), min_size=2, max_size=8))
def test_pair_values_are_ratios(rows):
    x = np.array(rows, float)
    s = pairwise.pair_values(x, x, "JT")
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            both, any_ = sum(map(min, a, b)), sum(map(max, a, b))
            assert math.isnan(s[i, j]) if not any_ else s[i, j] == both / any_
