"""Letters and digits of a text, and integer grams over them, for whole Arrow batches at once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

SEP = "\0"
_B = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """True at code points of the categories L and N, and at the separator."""
    t = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    t[0] = True
    return t


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(texts: list[str | None]) -> list[str]:
    """Case folded, and only code points of the categories L and N; null gives the empty text."""
    if not texts:
        return []
    s = SEP.join(t or "" for t in texts)
    if s.count(SEP) != len(texts) - 1:
        s = SEP.join((t or "").replace(SEP, "") for t in texts)
    a = codes(s.casefold())
    return a[_kept()[a]].tobytes().decode("utf-32-le", "surrogatepass").split(SEP)


def ragged(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points in one array, with the start and the length of each text."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes("".join(texts)), np.cumsum(n) - n, n


def _join(a: np.ndarray, b: np.ndarray, at: int, factor: int) -> np.ndarray:
    """Hash of a's window followed by b's, which starts `at` later; the tail, where b is missing, holds no window."""
    out = a * np.uint64(pow(_B, factor, 1 << 64))
    out[: len(a) - at] += b[at:]
    return out


def windows(a: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of the `size` code points from each position on; only valid where they exist."""
    power = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out, done, width = None, 0, 1
    while True:
        if size & width:
            out = power.copy() if out is None else _join(out, power, done, width)
            done += width
        width *= 2
        if width > size:
            return out
        if len(power) <= width // 2:
            return np.zeros(len(a), np.uint64)
        power = _join(power, power, width // 2, width // 2)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))
