"""Deterministic uniforms, splits and orders from SHA-256, the same on every engine and in every run."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 2.0**64


def digest(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts joined by colons; strings are literals."""
    return F.sha2(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def uniform(*parts: Column | str) -> Column:
    """In [0, 1): the first eight bytes of the digest as a fraction."""
    return F.conv(F.substring(digest(*parts), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(SCALE)


def hash_split(key: Column, test: float = 0.02, dev: float = 0.02) -> Column:
    u = uniform("split", key)
    return F.when(u < test, "test").when(u < test + dev, "dev").otherwise("train")


def fold(key: Column) -> Column:
    """0 or 1 by the parity of the key's digest."""
    return (F.conv(F.substring(F.sha2(key, 256), 64, 1), 16, 10).cast("int") % 2).alias("fold")


def pick(options: Column, u: Column) -> Column:
    """The option that a uniform falls on."""
    return F.element_at(options, (F.floor(u * F.size(options)) + 1).cast("int"))


PRIME = (1 << 31) - 1


def number(*parts: Column | str) -> Column:
    """The digest's first 60 bits."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("long")


def _mixer(salt: str, name: str) -> tuple[int, int]:
    h = hashlib.sha256(f"{salt}:{name}".encode()).digest()
    return int.from_bytes(h[:4], "big") % (PRIME - 1) + 1, int.from_bytes(h[4:8], "big") % PRIME


def place(name: str, n: Column, salt: str) -> Column:
    """A fixed name's place in the order that follows from the number n of a row."""
    a, b = _mixer(salt, name)
    return ((n % PRIME) * a + b) % PRIME


def ordered(names: tuple[str, ...], n: Column, salt: str) -> Column:
    """Fixed names in an order that follows from the number n of a row: one multiplication a name instead of a digest."""
    keyed = [F.struct(place(x, n, salt), F.lit(x)) for x in names]
    return F.transform(F.array_sort(F.array(*keyed)), lambda x: x["col2"])


def sql_number(*parts: str) -> str:
    return f"('0x' || substr({sql_digest(*parts)}, 1, 15))::BIGINT"


def sql_ordered(names: tuple[str, ...], n: str, salt: str) -> str:
    each = ", ".join(f"{{'k': (({n} % {PRIME}) * {a} + {b}) % {PRIME}, 'v': '{x}'}}" for x in names for a, b in [_mixer(salt, x)])
    return f"list_transform(list_sort([{each}]), lambda x: x.v)"


def sql_digest(*parts: str) -> str:
    return f"sha256(concat_ws(':', {', '.join(parts)}))"


def sql_uniform(*parts: str) -> str:
    return f"(('0x' || substr({sql_digest(*parts)}, 1, 16))::UBIGINT::DOUBLE / {SCALE:.1f})"
