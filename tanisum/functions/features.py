"""Fingerprints and descriptors of structures, where a chemistry toolkit is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

try:
    from rdkit import Chem
    from rdkit.Chem import Descriptors, MACCSkeys, rdFingerprintGenerator
except ImportError:
    Chem = None

KINDS = ("RDKIT", "ECFP4", "ECFP6", "MACCS")


def _needed() -> None:
    if Chem is None:
        raise RuntimeError("rdkit isn't installed")


def _maker(kind: str, m: int):  # noqa: ANN202
    if kind == "RDKIT":
        g = rdFingerprintGenerator.GetRDKitFPGenerator(fpSize=m)
        return g.GetFingerprint
    if kind == "MACCS":
        return MACCSkeys.GenMACCSKeys
    g = rdFingerprintGenerator.GetMorganGenerator(radius=2 if kind == "ECFP4" else 3, fpSize=m)
    return g.GetFingerprint


def _binary(batches: Iterator[pa.RecordBatch], kind: str, m: int) -> Iterator[pa.RecordBatch]:
    make = _maker(kind, m)
    for b in batches:
        mols = [Chem.MolFromSmiles(s) if s else None for s in b.column("smiles").to_pylist()]
        on = [None if x is None else list(make(x).GetOnBits()) for x in mols]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(on, pa.list_(pa.int32()))], names=["id", "on"])


def _descriptors(s: str | None) -> list[float]:
    mol = Chem.MolFromSmiles(s) if s else None
    out = []
    for _, f in Descriptors.descList:
        try:
            out.append(float("nan") if mol is None else float(f(mol)))
        except Exception:  # noqa: BLE001  a descriptor that fails is missing
            out.append(float("nan"))
    return out


def _real(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = [_descriptors(s) for s in b.column("smiles").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(v, pa.list_(pa.float64()))], names=["id", "v"])


def binary_fps(df: DataFrame, id_col: str = "id", smiles_col: str = "smiles", kind: str = "RDKIT", m: int = 2048) -> DataFrame:
    """``id``, ``on``; null bits for structures that can't be read."""
    if kind not in KINDS:
        raise ValueError(f"unknown fingerprint {kind}; known are {', '.join(KINDS)}")
    _needed()

    rows = df.selectExpr(f"cast(`{id_col}` as long) as id", f"`{smiles_col}` as smiles")
    return rows.mapInArrow(lambda batches: _binary(batches, kind, m), "id long, on array<int>")


def real_fps(df: DataFrame, id_col: str = "id", smiles_col: str = "smiles") -> DataFrame:
    """``id``, ``v``: all descriptors, NaN where one fails; see normalize for dropping columns."""
    _needed()
    return df.selectExpr(f"cast(`{id_col}` as long) as id", f"`{smiles_col}` as smiles").mapInArrow(_real, "id long, v array<double>")
