"""Functions over probability and label arrays.

Spark looks up names inside an array function's body among the aliases of the same select first. So give a result that goes
into one select with others made from it a name that none of their inputs has, or use withColumn step by step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-6


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def renormalised(p: Column) -> Column:
    """Summing to one; all zeros become uniform. Null and empty arrays stay null and empty."""
    s = total(p)
    return F.when(s > 0, F.transform(p, lambda x: x / s)).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def softmax(z: Column, t: Column | float = 1.0) -> Column:
    t = F.lit(t) if isinstance(t, float) else t
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp((x - top) / t))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def predicted(p: Column, qtype: Column) -> Column:
    """noul: whether p[1] is at least one half; else the first index of the largest."""
    return F.when(qtype == "noul", (p[1] >= 0.5).cast("int")).otherwise((F.array_position(p, F.array_max(p)) - 1).cast("int"))


def brier(p: Column, gold: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: (x - F.when(i == gold, 1.0).otherwise(0.0)) * (x - F.when(i == gold, 1.0).otherwise(0.0))), F.lit(0.0), lambda s, x: s + x)


def nll(p: Column, gold: Column) -> Column:
    return -F.ln(F.greatest(F.get(p, gold), F.lit(CLIP)))


def onehot(gold: Column, k: Column, smooth: float = 0.05) -> Column:
    """smooth / k everywhere, and 1 - smooth more on the gold."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.lit(smooth) / k + F.when(i == gold, 1.0 - smooth).otherwise(0.0))


def ordinal(gold: Column, k: Column, neighbour: float = 0.1) -> Column:
    """1 - 2 x neighbour on the gold, neighbour on the levels beside it, renormalised."""
    raw = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == gold, 1.0 - 2 * neighbour).when(F.abs(i - gold) == 1, neighbour).otherwise(0.0))
    s = total(raw)
    return F.transform(raw, lambda x: x / s)


def expectation(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)


def untempered(p: Column, t: Column) -> Column:
    """Probabilities at temperature one: p to the power of the temperature, renormalised."""
    q = F.transform(p, lambda x: F.pow(x, t))
    s = total(q)
    return F.when(s > 0, F.transform(q, lambda x: x / s)).otherwise(p)


def level(value: Column, count: Column, levels: int = 5) -> Column:
    """Level of a mean rating in [0, 1]; null under two ratings."""
    return F.when(value.isNotNull() & (count >= 2), F.least(F.lit(levels - 1), F.floor(value * levels).cast("int")))


def unique(options: Column) -> Column:
    return F.size(F.array_distinct(options)) == F.size(options)
