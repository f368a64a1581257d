"""Lines that fail to parse, numpy files, tables, optional features and the entry point."""

import importlib
import os
import re
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest

from tanisum import model
from tanisum.functions import features
from tanisum.operators import badrows
from tanisum.sources import memory, npy, tables

GOOD = [
    'M1,n,C,c1ccccc1,1.5,-2',
    '"M1","a, b","C","c1ccccc1","1.5",""',
    'M1,"say ""hi""",C,[nH]1cccc1,+15,',
    ',,,C,-10.,.5',
    "M1,n,C, \tC(=O)O ,  2 \t, \r",
    'M1,"",C,"C%12CC%12",0.0,15',
    '"""","""x""",C,C,1,1',
    f'M1,"{"x" * 100_000}{chr(34) * 20_000}",C,C,1,1',
    "M1,\x01b,C,C,1,1",
]
BAD = {
    "": "not 6 fields",
    "a,b,c,C,1": "not 6 fields",
    "a,b,c,C,1,1,1": "not 6 fields",
    'a,"b,c,C,1,1': "broken quoting",
    'a,x"b",c,C,1,1': "broken quoting",
    'a,"b"x,c,C,1,1': "broken quoting",
    'a,b"c,d,C,1,1': "broken quoting",
    "a,b,c,,1,1": "SMILES is empty",
    "a,b,c, \t,1,1": "SMILES is empty",
    "a,b,c,C!,1,1": "SMILES has a foreign character",
    "a,b,c,C)(,1,1": "SMILES has unbalanced round brackets",
    "a,b,c,C((,1,1": "SMILES has unbalanced round brackets",
    "a,b,c,[[C]],1,1": "SMILES has open or nested square brackets",
    "a,b,c,C[,1,1": "SMILES has open or nested square brackets",
    "a,b,c,C1CC,1,1": "SMILES has an unclosed ring",
    "a,b,c,C,,1": "logPN isn't a number",
    "a,b,c,C,1.2.3,1": "logPN isn't a number",
    "a,b,c,C,.,1": "logPN isn't a number",
    "a,b,c,C,1e1,1": "logPN isn't a number",
    "a,b,c,C,15.01,1": "logPN is out of range",
    "a,b,c,C,-11,1": "logPN is out of range",
    "a,b,c,C,1,x": "logPI isn't a number",
    "a,b,c,C,1,99": "logPI is out of range",
    "a,b,c,C,1,1\r\r": "logPI isn't a number",
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, 2, s) for i, s in enumerate([*GOOD, *BAD])] + [(500, 1, "anything"), (501, None, None)]
    return badrows.logp_lines(spark.createDataFrame(rows, "raw_id long, line_no long, raw_line string"))


def test_reasons(lines):
    got = {r["raw_id"]: r["errors"] for r in badrows.rejected(lines).collect()}
    assert got == {len(GOOD) + i: [why] for i, why in enumerate(BAD.values())} | {501: ["no line"]}


def test_typed_rows(lines):
    got = {r["raw_id"]: r for r in badrows.loaded(lines).collect()}
    assert set(got) == set(range(len(GOOD)))
    assert got[1]["NAME"] == "a, b" and got[1]["logPI"] is None and got[1]["logPN"] == 1.5
    assert got[2]["NAME"] == 'say "hi"' and got[2]["logPN"] == 15
    assert (got[3]["logPN"], got[3]["logPI"]) == (-10, 0.5)
    assert got[4]["SMILES"] == "C(=O)O" and got[4]["logPN"] == 2
    assert got[6]["DATABASE_ID"] == '"' and got[6]["NAME"] == '"x"'
    assert len(got[7]["NAME"]) == 110_000 and got[8]["NAME"] == "\x01b"


def test_several_reasons_at_once(spark):
    df = spark.createDataFrame([(1, 2, "a,b,c,C(1!,x,99")], "raw_id long, line_no long, raw_line string")
    assert badrows.rejected(badrows.logp_lines(df)).collect()[0]["errors"] == [
        "SMILES has a foreign character", "SMILES has unbalanced round brackets", "SMILES has an unclosed ring", "logPN isn't a number", "logPI is out of range",
    ]


def test_no_lines_and_clashing_columns(spark):
    none = spark.createDataFrame([], "raw_id long, line_no long, raw_line string")
    assert badrows.rejected(badrows.logp_lines(none)).count() == 0
    df = spark.createDataFrame([("a,b", "x", "y", 3)], "raw_line string, errors string, one string, fields int")
    got = badrows.with_errors(df, "raw_line", ("one", "two"), (), {}).collect()[0]
    assert (got["one"], got["two"], got["errors"], got["fields"]) == ("a", "b", [], 3)


def test_one_scan_without_shuffle(lines):
    plan = badrows.rejected(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def files(folder, names, rows=4, cols=3):
    folder.mkdir(exist_ok=True)
    for k, name in enumerate(names):
        np.save(folder / name, np.arange(rows * cols).reshape(rows, cols) + 100 * k)
    return str(folder)


def test_npy_read(spark, tmp_path):
    npy.register(spark)
    at = files(tmp_path / "a", ["x_1_4.npy", "x_0_0.npy", "x_10_44.npy"][:2])
    got = sorted((r["id"], r["row"]) for r in spark.read.format("npy").load(at).collect())
    assert [i for i, _ in got] == list(range(8)) and got[4][1] == [0, 1, 2] and got[0][1] == [100, 101, 102]
    assert spark.read.format("npy").option("maxRowsPerFile", "1").load(at).count() == 2
    assert spark.read.format("npy").option("maxFiles", "1").load(at).count() == 4


def test_npy_order_and_checks(tmp_path):
    at = files(tmp_path / "b", ["x_2_8.npy", "x_10_40.npy", "x_0_0.npy"])
    assert [p.name for p in npy.listed(at)] == ["x_0_0.npy", "x_2_8.npy", "x_10_40.npy"]
    for bad in (at, str(tmp_path / "none"), files(tmp_path / "c", []), files(tmp_path / "d", ["x.npy"])):
        with pytest.raises(ValueError):
            npy.checked(bad)
    assert len(npy.checked(at, slices=True)) == 3
    assert npy.first_id(npy.listed(at)[1]) == 8 and npy.first_id(npy.listed(at)[1], slices=True) == 2


def test_npy_packed_bits(spark, tmp_path):
    npy.register(spark)
    x = np.random.default_rng(1).integers(0, 2, (5, 16))
    (tmp_path / "e").mkdir()
    np.save(tmp_path / "e" / "fp_0_7.npy", np.packbits(x, axis=1))
    df = spark.read.format("npy").option("unpack", "true").load(str(tmp_path / "e"))
    on = {r["id"]: r["on"] for r in model.from_dense(df, "id", "row").collect()}
    assert on == {7 + i: np.flatnonzero(r).tolist() for i, r in enumerate(x)}


def test_npy_write(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "f")
    # ids in any order and with gaps
    df = spark.createDataFrame([(i, [float(i), 0.5]) for i in (9, 0, 5, 1, 6, 7, 3, 40, 41)], "id long, row array<double>").repartition(3)
    npy.save(df, at)
    back = spark.read.format("npy").option("slices", "true").load("file://" + at)
    assert sorted((r["id"], r["row"]) for r in back.collect()) == [(i, [float(i), 0.5]) for i in (0, 1, 3, 5, 6, 7, 9, 40, 41)]
    with pytest.raises(Exception, match="isn't empty"):
        npy.save(df, at)
    npy.save(df.where("id < 2"), at, overwrite=True)
    assert spark.read.format("npy").option("slices", "true").load(at).count() == 2
    for bad, why in (([(1, [1.0]), (1, [2.0])], "not repeat"), ([(1, [1.0]), (2, [2.0, 3.0])], "one length"), ([(1, None)], "not be null")):
        with pytest.raises(Exception, match=why):
            npy.save(spark.createDataFrame(bad, "id long, row array<double>").coalesce(1), str(tmp_path / "g"), overwrite=True)


def test_npy_files_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(npy, "FILE_BYTES", 64)
    w = npy.NpyWriter({"path": str(tmp_path / "h")}, True)
    batch = lambda ids: pa.RecordBatch.from_arrays([pa.array(ids), pa.array([[i, i + 1] for i in ids])], names=["id", "row"])
    w.commit([w.write(iter([batch([0, 1, 2]), batch([3, 4, 5]), batch([8, 9])])), w.write(iter([]))])
    assert [p.name for p in npy.listed(str(tmp_path / "h"))] == ["rows_0_3.npy", "rows_3_6.npy", "rows_8_10.npy"]
    assert np.load(tmp_path / "h" / "rows_3_6.npy").tolist() == [[3, 4], [4, 5], [5, 6]]


def test_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text('DATABASE_ID,NAME,SMILES_n,SMILES,logPN,logPI\nA,"x, ""y""",C,CC,1.5,-2\n')
    row = tables.read_structures(spark, str(tmp_path / "s.csv")).collect()[0]
    assert (row["NAME"], row["logPN"]) == ('x, "y"', 1.5)
    df = spark.createDataFrame([(1, 1, [1], [7]), (0, 300, [5], [1, 2])], "ord int, n long, ls array<long>, ids array<long>")
    tables.write_round(df, str(tmp_path), 1)
    assert [r["n"] for r in tables.read_round(spark, str(tmp_path), 1).collect()] == [300, 1]
    with pytest.raises(Exception, match="already exists"):
        tables.write_round(df, str(tmp_path), 1)
    tables.write_round(df, str(tmp_path), 1, overwrite=True)
    tables.write_clusters(df, str(tmp_path / "c"))
    assert [(r["cluster_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "c")).orderBy("cluster_id").collect()] == [(1, 300), (2, 1)]
    for text in ("a,\r\nb", 'say "x"', "", None, " y "):
        tables.write_structures(spark.createDataFrame([("A", text, "C", "CC", None, 1.0)], tables.LOGP), str(tmp_path / "csv" / str(hash(text))))
        assert tables.read_structures(spark, str(tmp_path / "csv" / str(hash(text))), line_breaks=True).first()["NAME"] == text


def test_memory(spark, tmp_path):
    assert memory.memory_report(spark).count() >= 1
    with memory.RssTrace(str(tmp_path / "rss.csv"), 0.01) as trace:
        time.sleep(0.1)
    lines = (tmp_path / "rss.csv").read_text().splitlines()
    assert lines[0] == "seconds,rss_gib" and len(lines) > 3 and trace.peak > 0
    assert memory.peak_mb()["self"] > 1


def test_features_need_their_toolkit(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "not one")], "id long, smiles string")
    with pytest.raises(ValueError):
        features.binary_fps(df, kind="other")
    if features.Chem is None:
        with pytest.raises(RuntimeError):
            features.binary_fps(df)
        with pytest.raises(RuntimeError):
            features.real_fps(df)
    else:
        assert {r["id"]: r["on"] is None for r in features.binary_fps(df).collect()} == {1: False, 2: True}


class Molecule:
    def __init__(self, text):
        self.text = text

    def GetOnBits(self):  # noqa: N802
        return sorted({ord(c) % 16 for c in self.text})


def test_features_with_a_stand_in_toolkit(spark, monkeypatch):
    """The plumbing, with a toolkit whose molecules are their letters."""
    from types import SimpleNamespace as Space

    def failing(x):
        raise ValueError

    generator = Space(GetFingerprint=lambda x: x)
    monkeypatch.setattr(features, "Chem", Space(MolFromSmiles=lambda s: None if "!" in s else Molecule(s)))
    monkeypatch.setattr(features, "rdFingerprintGenerator", Space(GetRDKitFPGenerator=lambda fpSize: generator, GetMorganGenerator=lambda radius, fpSize: generator), raising=False)
    monkeypatch.setattr(features, "MACCSkeys", Space(GenMACCSKeys=lambda x: x), raising=False)
    monkeypatch.setattr(features, "Descriptors", Space(descList=[("length", lambda x: len(x.text)), ("none", failing)]), raising=False)
    batch = lambda rows: [pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "smiles": [r[1] for r in rows]})]
    rows = [(1, "CCO"), (2, "C!"), (3, None), (4, "")]
    for kind in features.KINDS:
        make = features._maker(kind, 16)
        assert make(Molecule("CO")).GetOnBits() == [3, 15]
        got = pa.Table.from_batches(features._binary(batch(rows), kind, 16)).to_pylist()
        assert [(r["id"], r["on"]) for r in got] == [(1, [3, 15]), (2, None), (3, None), (4, None)]
    got = pa.Table.from_batches(features._real(batch(rows))).to_pylist()
    assert got[0]["v"][0] == 3.0 and np.isnan(got[0]["v"][1]) and np.isnan(got[1]["v"]).all()


def test_entry_and_names(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() == 1


def test_rest_imports_without_the_subpackage():
    code = "import sys; sys.modules['tanisum.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p4_found' not in q"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_core_does_not_name_the_subpackage():
    root = os.path.dirname(importlib.import_module("tanisum").__file__)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"\bllm\b", open(os.path.join(folder, n)).read())


def test_intermediate_tables_are_released(spark):
    from tanisum import session

    got = session.materialize(spark.range(5).toDF("x"), "t")
    assert got.count() == 5
    folder = got.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert os.path.isdir(folder)
    session.release(spark)
    assert not os.path.isdir(folder) and not session._written
