"""Joins, nearest records, groups, subsets and copies against brute force on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tanisum.llm import clusters, copies, pieces, simjoin, subset
from tanisum.llm import components as components_module
from tanisum.llm.annsearch import nearest_records
from tanisum.llm.cells import deepened
from tanisum.llm.cftree import LEAF, Tree
from tanisum.llm.components import components
from tanisum.llm.quantize import encode, project, train

COLUMNS = "rec bigint, grp bigint, s string, n string, id string, text double, side int"


def grams(s):
    f = "" if s is None else pieces.plain([s])[0]
    return frozenset(f[i : i + 4] for i in range(len(f) - 3))


def similarity(a, b):
    return len(a & b) / len(a | b)


def series(seed=1, groups=3, families=14):
    """Rows in families of mutants, copies, odd spellings, nulls, empties and one very long text."""
    rng = random.Random(seed)
    parts = ["c1ccccc1", "C(=O)N", "CC", "OC", "N(C)C", "[nH]", "S(=O)(=O)", "Cl", "Br", "C#N", "C1CC1", "CSC", "P(O)O", "F", "I"]
    rows = []
    for f in range(families):
        base = [rng.choice(parts) for _ in range(rng.choice([6, 12, 25]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            mine = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                mine[rng.randrange(len(mine))] = rng.choice(parts)
            s = "".join(mine)
            if rng.random() < 0.2:
                s = s[:5] + rng.choice([" ", "​", ";", "'"]) + s[5:].upper()
            rows.append((rng.randrange(groups), s))
    rows += [(0, None), (0, ""), (0, "abc"), (1, "  "), (None, "CCCCCCCC"), (2, "CCO" * 20_000), (2, "CCO" * 20_000)]
    rng.shuffle(rows)
    return [(i + 1, g, s, s, "x", 1.0, 7) for i, (g, s) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return series()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def pairs_of(rows, t):
    sets = [(r[0], r[1], grams(r[2])) for r in rows if r[1] is not None and grams(r[2])]
    return {(a[0], b[0]): similarity(a[2], b[2]) for a in sets for b in sets if a[0] < b[0] and a[1] == b[1] and similarity(a[2], b[2]) >= t}


def test_plain_form_and_pieces():
    assert pieces.plain([" C c|1;'−“X﻿", None, ""]) == ["cc1-x", "", ""]
    sets = pieces.pieces(["abcdabcd", "abc", None, "ééééé"])
    assert sets.sizes.tolist() == [4, 0, 0, 1]


@pytest.mark.parametrize("t", [0.6, 0.7, 0.8, 0.95, 1.0])
@pytest.mark.parametrize("block", [16_000, 20])
def test_join_is_exact(table, rows, t, block):
    got = simjoin.similar_pairs(table, id_col="rec", text_col="s", by="grp", threshold=t, block_rows=block).collect()
    want = pairs_of(rows, t)
    assert len(got) == len(want)
    assert {(r["id_a"], r["id_b"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_join_with_short_lists_only(table, rows, monkeypatch):
    monkeypatch.setattr(simjoin, "SHORT_LIST", 2)
    monkeypatch.setattr(simjoin, "EXPANDED", 50)
    strings = [r[2] for r in rows if r[1] == 1]
    ids = np.array([r[0] for r in rows if r[1] == 1])
    a, b, _ = map(np.concatenate, zip(*simjoin.join_block(strings, ids, np.zeros(len(ids)), 0.8, False), strict=True))
    assert set(zip(a.tolist(), b.tolist())) == {k for k in pairs_of(rows, 0.8) if k[0] in set(ids.tolist())}


@pytest.mark.parametrize("block", [16_000, 15])
def test_join_of_two_tables(spark, rows, block):
    left, right = rows[::2], rows[1::2]
    got = simjoin.similar_pairs(spark.createDataFrame(left, COLUMNS), spark.createDataFrame(right, COLUMNS), id_col="rec", text_col="s", by="grp", threshold=0.8, block_rows=block)
    ids = {r[0] for r in left}
    want = {(a, b) if a in ids else (b, a) for a, b in pairs_of(rows, 0.8) if (a in ids) != (b in ids)}
    got = [(r["id_a"], r["id_b"]) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_join_of_repeated_ids(spark):
    rows = [(1, 0, "CCCCNCCCC", "", "", 0.0, 0), (1, 0, "CCCCNCCCC", "", "", 0.0, 0), (2, 0, "CCCCNCCCC", "", "", 0.0, 0)]
    got = simjoin.similar_pairs(spark.createDataFrame(rows, COLUMNS), id_col="rec", text_col="s", by="grp").collect()
    assert [(r["id_a"], r["id_b"]) for r in got] == [(1, 2)]


def best_of(rows, k, least):
    out = set()
    sets = [(r[0], r[1], grams(r[2])) for r in rows if r[1] is not None and grams(r[2])]
    for a in sets:
        near = sorted((-similarity(a[2], b[2]), b[0]) for b in sets if b[0] != a[0] and b[1] == a[1] and similarity(a[2], b[2]) >= least)
        out |= {(a[0], b, round(-s, 9)) for s, b in near[:k]}
    return out


@pytest.mark.parametrize("block", [16_000, 20])
def test_nearest_records(table, rows, block):
    got = nearest_records(table, id_col="rec", text_col="s", by="grp", k=3, min_similarity=0.6, lists=256, block_rows=block).collect()
    assert {(r["id"], r["neighbour"], round(r["similarity"], 9)) for r in got} == best_of(rows, 3, 0.6)


def test_codes_are_sums_of_words():
    x = project(pieces.pieces(["".join(random.Random(i).choices("CNOSc1", k=60)) for i in range(300)]))
    cb = train(x, 4, 16)
    codes, norms = encode(x, cb)
    back = sum(cb.words[m][codes[:, m]] for m in range(4))
    assert np.allclose((back**2).sum(1), norms, atol=1e-2)
    wide, _ = encode(x, cb, beam=1)
    loss = lambda c: ((x - sum(cb.words[m][c[:, m]] for m in range(4))) ** 2).sum()
    assert loss(codes) <= loss(wide) + 1e-3


def test_projection_of_wide_vocabularies_agrees():
    strings = ["".join(random.Random(i).choices("ABCDEFGHIJKLMNOPQRST", k=400)) for i in range(40)] + [None]
    sets = pieces.pieces(strings)
    assert len(np.unique(sets.tokens)) > 4096
    whole = project(sets)
    for i in range(40):
        assert np.allclose(project(pieces.pieces([strings[i]]))[0], whole[i], atol=1e-3)


def components_of(rows, t):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(pairs_of(rows, t)):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r[0])
    return {(i, f) for f, members in groups.items() if len(members) > 1 for i in members}


@pytest.mark.parametrize("block", [16_000, 20])
def test_groups(table, rows, block):
    got = clusters.similarity_groups(table, id_col="rec", text_col="s", by="grp", threshold=0.7, block_rows=block)
    assert {(r["id"], r["first_id"]) for r in got.collect()} == components_of(rows, 0.7)
    told = clusters.described(table, got, id_col="rec", text_col="s").collect()
    sizes = {}
    for i, f in components_of(rows, 0.7):
        sizes.setdefault(f, set()).add(i)
    assert {r["first_id"]: r["n"] for r in told} == {f: len(m) for f, m in sizes.items()}
    assert all(set(r["typical"]) <= sizes[r["first_id"]] for r in told)


@pytest.mark.parametrize("block", [16_000, 2])
def test_links_that_an_estimate_would_miss(spark, block):
    rng = random.Random(11)
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789#()[]+@/=.*%"
    base = "".join(rng.choices(alphabet, k=70))
    grown = base
    # pieces whose projections point the same way look farther apart than they are
    while similarity(grams(base), grams(grown)) * (len(grams(grown)) / (len(grams(grown)) + 1)) >= 0.7:
        x = project(pieces.pieces([base, *[grown + c for c in alphabet]]))
        grown += alphabet[((x[1:] - x[0]) ** 2).sum(1).argmax()]
    rows = [(1, 0, base), (2, 0, "".join(rng.choices(alphabet, k=70))), (3, 0, grown), (4, 1, base)]
    df = spark.createDataFrame(rows, "rec bigint, grp bigint, s string")
    got = clusters.similarity_groups(df, id_col="rec", text_col="s", by="grp", threshold=0.7, block_rows=block)
    assert sorted((r["id"], r["first_id"]) for r in got.collect()) == [(1, 1), (3, 1)]


@pytest.mark.parametrize("few", [10_000, 3])
def test_large_groups_are_described_in_parts(table, rows, monkeypatch, few):
    monkeypatch.setattr(clusters, "MEMBERS", few)
    got = clusters.similarity_groups(table, id_col="rec", text_col="s", by="grp", threshold=0.7, block_rows=20)
    assert {(r["id"], r["first_id"]) for r in got.collect()} == components_of(rows, 0.7)
    told = {r["first_id"]: (r["n"], r["typical"]) for r in clusters.described(table, got, id_col="rec", text_col="s").collect()}
    groups, text = {}, {r[0]: r[2] for r in rows}
    for i, f in sorted(components_of(rows, 0.7)):
        groups.setdefault(f, []).append(i)
    want = {}
    for f, ids in groups.items():
        x = project(pieces.pieces([text[i] for i in ids])).astype(np.float64)
        apart = np.round(((x - x.mean(0)) ** 2).sum(1), 3)
        want[f] = (len(ids), apart)
        n, typical = told[f]
        assert n == len(ids) and len(typical) == min(3, n)
        assert np.allclose(sorted(apart[[ids.index(i) for i in typical]]), np.sort(apart)[: len(typical)], atol=0.02)
    assert set(told) == set(want)


@pytest.mark.parametrize("hub", [100_000, 2])
def test_components_of_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(components_module, "HUB", hub)
    edges = [(i, 50) for i in range(51, 90)] + [(7, i) for i in range(60, 70)] + [(200, 201), (201, 202)]
    got = {(r["id"], r["root"]) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 7) for i in range(50, 90)} | {(201, 200), (202, 200)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (5, 4), (5, 4)]
    got = {(r["id"], r["root"]) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(1, 31)} | {(100 + i, 100) for i in range(1, 20)}


def test_subset_covers_families(spark):
    rng = random.Random(3)
    alphabet = "CNOSPFIBHK123456789=#()[]+-@/"
    bases = ["".join(rng.choices(alphabet, k=80)) for _ in range(30)]
    rows = []
    for f, b in enumerate(bases):
        for _ in range(200 if f == 0 else 10):
            at = rng.randrange(80)
            rows.append((len(rows), f, b[:at] + rng.choice(alphabet) + b[at + 1 :], "", "", 0.0, 0))
    rows += [(10_000, 0, None, "", "", 0.0, 0), (10_001, 0, "", "", "", 0.0, 0)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = subset.varied_subset(df, id_col="rec", text_col="s", share=0.08).collect()
    assert len(got) == round(0.08 * 490) == len({r["id"] for r in got})
    assert sum(r["n_group"] for r in got) == 490
    families = [rows[r["id"]][1] for r in got]
    assert len(set(families)) == 30
    assert families.count(0) <= 12  # its share of the rows would be 16


def test_ward_merges_the_closest_first():
    x = np.array([[0.0, 0], [0.1, 0], [5, 0], [5.3, 0], [20, 0]])
    merges = subset.ward(x, np.ones(5))
    assert [(a, b) for _, a, b in merges][:2] == [(0, 1), (2, 3)]
    assert [h for h, _, _ in merges] == sorted(h for h, _, _ in merges)


def test_summary_keeps_all_rows():
    rng = np.random.default_rng(1)
    s = subset.Summary(0.01)
    for _ in range(3):
        s.add(rng.normal(size=(1500, 96)).astype(np.float32))
    n = s.tree.n
    assert len(n) <= 2 * subset.LEAST and n.sum() == 4500 and len(s.place) == 4500
    assert np.array_equal(np.bincount(s.place, minlength=len(n)), n)


def test_trees_hold_what_went_in():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 8)).repeat(60, 0) + rng.normal(size=(2400, 8)) * 0.01).astype(np.float32)
    one, two = Tree(8), Tree(8)
    for t, part in ((one, x[::2]), (two, x[1::2])):
        t.insert(part, np.ones(len(part)), (part.astype(float) ** 2).sum(1))
        t.condense(120)
        assert max(map(len, t.leaves())) <= LEAF and sum(map(len, t.leaves())) == t.count <= 120
    # a tree takes in another one
    one.insert(two.total.copy(), two.n.copy(), two.square.copy())
    one.condense(40)
    assert one.n.sum() == 2400 and one.n.min() == one.n.max() == 60
    assert np.allclose(one.total.sum(0), x.sum(0), atol=0.1) and np.isclose(one.square.sum(), (x.astype(float) ** 2).sum())


@pytest.mark.parametrize("small", [500, 0])
def test_cells_are_divided(spark, monkeypatch, small):
    for name, v in (("CELL", 60), ("BLOCK", 100), ("SMALL", small), ("PARTS", 8), ("FEWER", 4)):
        monkeypatch.setattr(subset, name, v)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(700, 96)), np.ones((300, 96))])
    df = spark.createDataFrame([(i, 1, 1.0, v.tobytes()) for i, v in enumerate(x)], "entry long, n long, w double, total binary")
    got = subset._divided(df).select("entry", "cell").toPandas()
    assert sorted(got["entry"]) == list(range(1000))
    # what is alike and fits stays together; what can't be told apart is cut by a hash
    assert got.groupby("cell").size().max() <= 90


def test_cut_takes_exactly_the_cheapest(spark):
    rng = random.Random(5)
    rows = [(c, float(rng.choice([0.0, 0.0, 0.5, rng.random()])), s) for c in range(30) for s in range(40)]
    df = spark.createDataFrame(rows, "cell long, height double, step long")
    for k in (0, 1, 300, 700, 1200):
        got = [r["height"] for r in df.where(subset._cut(df, k)).collect()]
        assert len(got) == k and (not k or max(got) <= sorted(h for _, h, _ in rows)[k - 1])


def plain_pairs(rows):
    groups = {}
    for r in rows:
        a, b = pieces.plain([r[2], r[3]])
        if len(a) >= 4 and len(b) >= 4:
            groups.setdefault(tuple(sorted((a, b))), []).append(r[0])
    return {(min(g), i) for g in groups.values() for i in set(g) if i != min(g)}


@pytest.mark.parametrize("bits", [64, 3])
@pytest.mark.parametrize("hot", [1e-3, 0.05])
def test_copies(spark, rows, bits, hot, monkeypatch):
    monkeypatch.setattr(copies, "HOT_SHARE", hot)
    rng = random.Random(5)
    mine = []
    for r in rows * 2:
        a, b = r[2], (r[2] or "")[::-1]
        if rng.random() < 0.5:
            a, b = b, a
        mine.append((len(mine) + 1, 0, a, None if rng.random() < 0.05 else b, "", 0.0, 0))
    df = spark.createDataFrame(mine, COLUMNS)
    got = [(r["first_id"], r["copy_id"]) for r in copies.copies(df, id_col="rec", first_col="s", second_col="n", bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(mine)


@pytest.mark.parametrize("bits", [64, 2])
def test_large_groups_are_cut(spark, rows, monkeypatch, bits):
    monkeypatch.setattr(copies, "HOT_LEAST", 7)
    mine = [(r[0], r[2], r[3]) for r in rows] + [(1000 + i, "CCO" * 5 + " " * (i % 4), "NCC" * 4) for i in range(120)] + [(5, "CCO" * 5, "ncc" * 4)]
    df = spark.createDataFrame(mine, "rec bigint, s string, n string")
    got = [(r["first_id"], r["copy_id"]) for r in copies.copies(df, id_col="rec", first_col="s", second_col="n", bits=bits).collect()]
    first = {}
    for i, a, b in sorted(mine[:-1] + [(5, "CCO" * 5, "ncc" * 4)], key=lambda r: r[0]):
        x, y = pieces.plain([a, b])
        if min(len(x), len(y)) >= 4:
            first.setdefault((min(x, y), max(x, y)), []).append(i)
    want = {(min(v), i) for v in first.values() for i in v if i != min(v)}
    assert len(got) == len(set(got)) and set(got) == want


def test_collapse_counts_all_records(spark):
    rows = [(1, 0, "CCCC N", "CCCCO", "", 0.0, 0), (2, 0, "cccco", "ccccn", "", 0.0, 0), (3, 0, "x", "y", "", 0.0, 0)]
    df = spark.createDataFrame(rows, COLUMNS)
    pairs = copies.copies(df, id_col="rec", first_col="s", second_col="n")
    assert {(r["first_id"], r["n_copies"]) for r in copies.collapse(df, pairs, id_col="rec").collect()} == {(1, 2), (3, 1)}


def test_hash_ignores_what_does_not_count():
    h, n = copies.rolling_hashes(["C C;c", "ccc", "cc c​", "cd", None])
    assert h[0] == h[1] == h[2] and h[3] != h[1] and n.tolist() == [3, 3, 3, 2, 0]
    long = "é x−y" * 300
    h, n = copies.rolling_hashes([long, long.upper().replace(" ", "") + "\u200b", long + "z", "\U00010400" * 50, "\U00010428" * 50])
    assert h[0] == h[1] != h[2] and h[3] == h[4] and n.tolist() == [1200, 1200, 1201, 50, 50]
    assert copies.same_text(["A b", "ab", None], ["ab", "ba", ""]).tolist() == [True, False, True]


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    nulls = spark.createDataFrame([(None,) * 7, (1, None, None, None, None, None, None), (None, 1, "CCCCCCC", None, None, None, None)], COLUMNS)
    for df in (none, nulls):
        assert simjoin.similar_pairs(df, id_col="rec", text_col="s", by="grp").count() == 0
        assert nearest_records(df, id_col="rec", text_col="s", by="grp").count() == 0
        assert clusters.similarity_groups(df, id_col="rec", text_col="s", by="grp").count() == 0
        assert subset.varied_subset(df, id_col="rec", text_col="s").count() == 0
        assert copies.copies(df, id_col="rec", first_col="s", second_col="n").count() == 0


def test_column_named_like_the_operators_own(spark, rows):
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "text bigint, id bigint, by string").withColumn("block", F.lit("q")).withColumn("cells", F.lit(1))
    got = simjoin.similar_pairs(df, id_col="text", text_col="by", by="id")
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == set(pairs_of(rows, 0.8))


def test_nearest_cells_level_by_level():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 12)).astype(np.float32)
    cells = deepened(x, x[:8], 3000, 20)
    assert len(cells.levels) == 2 and cells.number >= 150
    whole = (cells.levels[0][:, None] + cells.levels[1][None]).reshape(-1, 12)
    # all first-level cells are kept, so the search is exact
    got = cells.nearest(x[:200], 40)
    want = np.argsort(((x[:200, None] - whole) ** 2).sum(2), axis=1)[:, :40]
    assert np.mean([len(set(a) & set(b)) / 40 for a, b in zip(got, want)]) > 0.999
    assert len(deepened(x, x[:8], 3000, 1).levels) == 3
