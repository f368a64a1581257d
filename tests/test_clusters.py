"""The clustering tree, its tables, rounds and online use."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tanisum import model
from tanisum.cluster import batch
from tanisum.cluster.criteria import criterion, set_similarity
from tanisum.cluster.tree import Feature, Tree, fit, poles
from tanisum.streaming import online


def features(rows):
    return [Feature(1, np.array([int(c) for c in r], np.int64), [i]) for i, r in enumerate(rows)]


def parts(found):
    return [sorted(f.ids) for f in found]


def random_rows(n=300, m=32, families=12, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (families, m))
    x = base[rng.integers(0, families, n)]
    x = np.where(rng.random((n, m)) < 0.06, 1 - x, x)
    return ["".join(map(str, r)) for r in x]


def test_hand_fixture():
    found = fit(features(["1100", "1010", "1110", "0001"]), 4, criterion("diameter", 0.65))
    assert parts(found) == [[0, 2], [1], [3]]


def test_set_similarity():
    ls = lambda *rows: (len(rows), np.sum([[int(c) for c in r] for r in rows], axis=0))
    assert set_similarity(ls("1100", "1010")) == pytest.approx(1 / 3)
    assert set_similarity(ls("1100", "1110", "0001")) == pytest.approx(1 / 5)
    assert np.isnan(set_similarity(ls("1100"))) and np.isnan(set_similarity(ls("0000", "0000")))


def test_empty_objects_merge_under_tolerance_only():
    assert parts(fit(features(["0000", "0000"]), 4, criterion("diameter", 0.65))) == [[0], [1]]
    assert parts(fit(features(["0000", "0000"]), 4, criterion("tolerance", 0.65))) == [[0, 1]]


def test_tough_tolerance_turns_larger_newcomers_away_from_single_ones():
    tough = criterion("tolerance_tough", 0.3)
    one = (1, np.array([1, 1, 0, 0]))
    two = (2, np.array([2, 2, 1, 0]))
    both = (3, one[1] + two[1])
    assert not tough(both, one, two) and criterion("tolerance", 0.3)(both, one, two)
    assert tough((5, two[1] * 2 + one[1]), (3, two[1] + one[1]), two)


def test_unknown_names():
    with pytest.raises(ValueError):
        criterion("other", 0.5)
    with pytest.raises(ValueError):
        Tree(4, criterion("diameter", 0.5), 1)


@pytest.mark.parametrize("method", ["radius", "diameter", "tolerance", "tolerance_tough"])
@pytest.mark.parametrize("branching", [2, 5, 50])
def test_every_object_has_one_cluster(method, branching):
    rows = random_rows()
    found = fit(features(rows), 32, criterion(method, 0.6), branching)
    assert sorted(i for f in found for i in f.ids) == list(range(300))
    assert [f.n for f in found] == sorted((f.n for f in found), reverse=True)
    for f in found:
        assert np.array_equal(f.ls, np.sum([[int(c) for c in rows[i]] for i in f.ids], axis=0)) and f.n == len(f.ids)
        if method == "diameter" and f.n > 1:
            assert set_similarity((f.n, f.ls)) >= 0.6
    assert len(found) < 300


def test_poles_are_far_apart():
    x = np.packbits(np.array([[1, 1, 1, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1, 1, 1]]), axis=1)
    first, one, two = poles(x)
    assert one[first] == 1 and two.argmax() != first


@pytest.fixture(scope="module")
def fp(spark):
    df = spark.createDataFrame([(i, [int(c) for c in r]) for i, r in enumerate(random_rows())], "id long, bits array<int>")
    return model.from_dense(df.repartition(3), "id", "bits").persist()


def table_parts(df):
    return sorted(sorted(r["ids"]) for r in df.collect())


def test_exact_table_is_the_tree(fp):
    got = batch.exact(fp, 32, threshold=0.6)
    assert table_parts(got) == sorted(parts(fit(features(random_rows()), 32, criterion("diameter", 0.6))))
    labels = batch.assignments(got)
    assert batch.complete(labels, fp) and labels.count() == 300
    sizes = [r["count"] for r in labels.groupBy("cluster_id").count().orderBy("cluster_id").collect()]
    assert sizes == sorted(sizes, reverse=True)
    assert not batch.complete(labels.where("id > 4"), fp)


def test_groups_are_clustered_apart(fp):
    got = batch.exact(fp.withColumn("g", (F.col("id") % 2).cast("string")), 32, by="g", threshold=0.6)
    assert all(len({i % 2 for i in r["ids"]}) == 1 for r in got.collect())


@pytest.mark.parametrize("double", [True, False])
def test_rounds_are_complete_and_repeatable(fp, double):
    run = lambda df: batch.rounds(df, 32, rows_per_part=40, bin_size=3, threshold=0.6, double_init=double)
    one, two = run(fp), run(fp.repartition(7))
    assert batch.complete(batch.assignments(one), fp) and table_parts(one) == table_parts(two)
    assert sum(r["n"] for r in one.collect()) == 300
    first = batch.rounds(fp, 32, rows_per_part=40, threshold=0.6, only_first=True)
    assert {r["grp"] for r in first.collect()} == set(range(8))


def test_parts_are_rows_not_ranges_of_ids(fp):
    sparse = fp.withColumn("id", F.col("id") * 1_000_000 - 5)
    first = batch.rounds(sparse, 32, rows_per_part=100, threshold=0.6, only_first=True)
    assert {r["grp"]: r["n"] for r in first.groupBy("grp").agg(F.sum("n").alias("n")).collect()} == {0: 100, 1: 100, 2: 100}
    one = batch.rounds(fp, 32, rows_per_part=40, bin_size=3, threshold=0.6)
    two = batch.round_assignments(fp, 32, rows_per_part=40, bin_size=3, threshold=0.6)
    assert sorted(map(tuple, batch.assignments(one).collect())) == sorted(map(tuple, two.collect()))


def test_bits_beyond_the_width_are_refused(fp):
    with pytest.raises(Exception, match="beyond the 16"):
        batch.exact(fp, 16).count()


def test_checks_and_halves(fp):
    got = batch.exact(fp, 32, threshold=0.6)
    assert {(r["objects"], r["ids"], r["similar"]) for r in batch.checked(got, 0.6).collect()} == {(300, 300, True)}
    assert {r["similar"] for r in batch.checked(got, 0.99).collect()} == {False}
    sides = {r["half"] for r in batch.halves(fp, 32).collect()}
    assert sides == {"left", "right"}


def test_largest_broken_up(fp):
    got = batch.exact(fp, 32, threshold=0.6)
    rest, singles = batch.largest_broken_up(got, fp, 32)
    assert rest.count() == got.count() - 1 and singles.count() == got.agg(F.max("n")).first()[0]


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, on array<int>")
    assert batch.exact(none, 8).count() == 0
    assert batch.assignments(batch.rounds(none, 8)).count() == 0


def test_online_clusters(spark, fp, tmp_path):
    o = online.OnlineClusters(str(tmp_path), 32, threshold=0.6)
    for k in range(3):
        o.update(fp.where((F.col("id") % 3) == k), k)
    last = o.snapshot(spark, 2)
    assert sorted(i for r in last.collect() for i in r["ids"]) == list(range(300))
    before = table_parts(last)
    o.update(fp.where((F.col("id") % 3) == 2), 2)  # a batch that is run again
    assert table_parts(o.snapshot(spark, 2)) == before
    assert o.snapshot(spark, -1) is None


def test_live_similarity(spark, fp, tmp_path):
    from tanisum.operators import isim

    for k in range(3):
        fp.where((F.col("id") % 3) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, on array<int>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.live_sums(stream, 32).writeStream.outputMode("complete").format("memory").queryName("live_t").trigger(availableNow=True).start()
    q.awaitTermination()
    got = online.isim_of(spark.table("live_t"), 32).collect()[0]
    assert got["n"] == 300 and got["isim"] == pytest.approx(isim.isim(fp, 32).collect()[0]["isim"])


def test_windowed_sums(spark, fp, tmp_path):
    rows = fp.withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, on array<int>, ts timestamp").parquet(str(tmp_path / "in"))
    q = online.windowed_sums(stream, 32, "ts", "1 hour", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("live_w").trigger(availableNow=True).start()
    q.awaitTermination()
    counts = [r["x"] for r in spark.table("live_w").where("bit = -1").orderBy("window").collect()]
    assert counts == [60] * 5


def test_command_line(spark, fp, tmp_path):
    from tanisum.cluster.__main__ import main

    x = np.array([[int(c) for c in r] for r in random_rows()])
    (tmp_path / "in").mkdir()
    for k in range(3):
        np.save(tmp_path / "in" / f"fps_{k}_{k * 100}.npy", np.packbits(x[k * 100 : k * 100 + 100], axis=1))
    options = ["--in-dir", str(tmp_path / "in"), "--out-dir", str(tmp_path / "out"), "--bits", "32", "--threshold", "0.6", "--rows-per-part", "100"]
    main(options, spark)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(i for r in got.collect() for i in r["ids"]) == list(range(300))
    assert table_parts(got) == table_parts(batch.rounds(fp, 32, rows_per_part=100, threshold=0.6))
    with pytest.raises(Exception, match="already exists"):
        main([*options, "--no-overwrite-outputs"], spark)
    main([*options, "--monitor-rss", str(tmp_path / "rss.csv")], spark)
    assert len((tmp_path / "rss.csv").read_text().splitlines()) > 1
    main([*options, "--out-dir", str(tmp_path / "first"), "--only-first-round", "--max-files", "2"], spark)
    assert spark.read.parquet(str(tmp_path / "first" / "round=1")).agg(F.sum("n")).first()[0] == 200
