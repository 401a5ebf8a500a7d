"""Hashes of the grams of a text, all at once and in time linear in its length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0xD1342543DE82EF95)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _hashed(columns) -> np.ndarray:
    """Of grams given as one array per place."""
    out = None
    for c in columns:
        out = c.copy() if out is None else out * _BASE + c
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x7FB5D329728EA185)
    return (out ^ out >> np.uint64(27)).view(np.int64)


def rolling(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of each gram of `size` characters, in order; none where the text is shorter."""
    a = _codes(text)
    n = len(a) - size + 1
    return _hashed(a[k : k + n] for k in range(size)) if n > 0 else np.zeros(0, np.int64)


def ends(size: int):
    """For mapInArrow over `unit`, texts of `size` characters or more: unit, and the hashes of its first and last gram."""

    def run(batches):
        for b in batches:
            units = b["unit"].to_pylist()
            if not units:
                continue
            edge = lambda cut: pa.array(_hashed(_codes("".join(map(cut, units))).reshape(-1, size).T))
            yield pa.RecordBatch.from_arrays([b["unit"], edge(lambda u: u[:size]), edge(lambda u: u[-size:])], names=["unit", "first", "last"])

    return run


def all_grams(size: int):
    """For mapInArrow over `d` and `doc`: d and the hash of each gram of doc, once where a gram is repeated."""

    def run(batches):
        for b in batches:
            texts = b["doc"].to_pylist()
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            h = rolling("".join(texts), size)
            row = np.repeat(np.arange(len(texts)), n)[: len(h)]
            inside = np.arange(len(h)) + size <= np.cumsum(n)[row]
            pair = np.unique(np.stack([row[inside], h[inside]], 1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b["d"].to_numpy()[pair[:, 0]], pa.int64()), pa.array(pair[:, 1], pa.int64())], names=["d", "gram"])

    return run
