"""Strings inside JSON texts, at any depth."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk(x, path: str = "$"):
    """Path and value of every string value; field names are no values."""
    if isinstance(x, str):
        yield path, x
    elif isinstance(x, dict):
        for k, v in x.items():
            yield from walk(v, f"{path}.{k}" if k.isidentifier() else f'{path}."{k}"')
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from walk(v, f"{path}[{i}]")


def strings(rows: DataFrame, column: str) -> DataFrame:
    """The other columns, path and value for every string in a column of JSON texts; what is null or not JSON has none."""

    def run(batches):
        for b in batches:
            at, paths, values = [], [], []
            for i, t in enumerate(b[column].to_pylist()):
                try:
                    found = list(walk(json.loads(t))) if t else []
                except (ValueError, RecursionError):
                    found = []
                for p, v in found:
                    at.append(i)
                    paths.append(p)
                    values.append(v)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b[c].take(take) for c in rest), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[*rest, "path", "value"])

    rest = [c for c in rows.columns if c != column]
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "path string, value string"]))


def instructions(rows: DataFrame, column: str) -> DataFrame:
    """Only the strings that stand under a field `instructions`, at any depth."""
    return strings(rows, column).where(F.col("path").rlike(r"\.instructions$"))
