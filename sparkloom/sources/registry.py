"""Datasets by name: each name has a reader of its files under one root."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from sparkloom.sources import binary, text

READERS: dict[str, Callable] = {"mtx": text.read_mtx, "edges": text.read_edge_list, "lg": text.read_lg, "sadj": text.read_labelled_adjacency, "dimacs": text.read_dimacs, "metis": text.read_metis, "gr": binary.read_gr, "csr": binary.read_csr}
_known: dict[str, tuple[str, str]] = {}


def register(name: str, kind: str, path: str) -> None:
    """Let :func:`load` find ``name`` at ``path``, read as ``kind``."""
    if kind not in READERS:
        raise ValueError(f"kinds are {', '.join(READERS)}")
    _known[name] = (kind, path)


def load(spark: SparkSession, name: str, **options):
    kind, path = _known[name]
    return READERS[kind](spark, path, **options)
