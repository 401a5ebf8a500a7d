"""Batches of similar length, their cost, the plan over epochs and ranks, and schedules over steps."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.functions.hashing import uniform

BUCKETS = 1024


def padded(n: Column, multiple: int = 32) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("long")


def cut(lengths: list[int], size: int, most: int, multiple: int = 32) -> list[int]:
    """Batch number of each item of ascending length: a new batch where the next item would pass `size` items or `most` padded
    tokens. most = 0 sets no token limit; an item beyond it alone is a batch of its own."""
    out, k, n = [], 0, 0
    for x in lengths:
        wide = -(-x // multiple) * multiple
        if n and (n + 1 > size or most and (n + 1) * wide > most):
            k, n = k + 1, 0
        n += 1
        out.append(k)
    return out


def pooled(items: DataFrame, total: int, size: int, pool: int = 50, most: int = 0, seed: str = "13") -> DataFrame:
    """items (id, n) with pool and batch: items fall into pools of about size x pool by hash, and each pool is sorted by
    length and cut. A pool is small whatever the input; `total` is the number of items."""
    pools = max(1, math.ceil(total / (size * pool)))
    p = items.withColumn("pool", F.floor(uniform(seed, "pool", F.col("id")) * pools).cast("int"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "id"], ignore_index=True)
        rows["batch"] = cut(rows["n"].tolist(), size, most)
        return rows

    return p.groupBy("pool").applyInPandas(one, f"id {dict(items.dtypes)['id']}, n long, pool int, batch int")


def by_length(items: DataFrame, size: int, most: int, multiple: int = 32) -> DataFrame:
    """items (id, n) with wide and batch for inference: items of one padded length share batches, as many as fit, in the order of length, a hash of the id,
    and id. Places are counted over length and hash first, so that no task sorts all items of a width."""
    i = items.withColumn("wide", F.greatest(padded(F.col("n"), multiple), F.lit(multiple))).withColumn("_b", F.floor(uniform("place", F.col("id")) * BUCKETS).cast("int"))
    keys = ["wide", "n", "_b"]
    sizes = i.groupBy(*keys).agg(F.count("*").alias("_c"))
    before = sizes.select(*keys, (F.sum("_c").over(W.partitionBy("wide").orderBy("n", "_b")) - F.col("_c")).alias("_before"))  # multiple x BUCKETS rows a width at most
    fits = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(most) / F.col("wide"))))
    place = F.col("_before") + F.row_number().over(W.partitionBy(*keys).orderBy("id")) - 1
    return i.join(before, keys).withColumn("batch", F.floor(place / fits).cast("long")).select(*items.columns, "wide", "batch")


def worst(batches: DataFrame, *by: str) -> DataFrame:
    """The batch with the most padded tokens and the one with the longest item."""
    b = batches.groupBy(*by).agg(F.count("*").alias("items"), F.max("n").alias("longest")).withColumn("tokens", F.col("items") * padded(F.col("longest")))
    key = F.to_json(F.struct(*by))
    return b.agg(F.max("tokens").alias("most_tokens"), F.max_by(key, F.struct("tokens", key)).alias("by_tokens"), F.max("longest").alias("longest"), F.max_by(key, F.struct("longest", key)).alias("by_length"))


def pad(a: Column, width: Column, value: Column) -> Column:
    return F.concat(a, F.array_repeat(value, (width - F.size(a)).cast("int")))


def plan(batches: DataFrame, key: Column, epochs: int, seed: str = "13", max_steps: int | None = None) -> DataFrame:
    """The batches of every epoch in an order of its own, u; with max_steps only the first so many, numbered as step."""
    p = batches.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("u", uniform(seed, F.col("epoch"), key))
    if max_steps is None:
        return p
    first = p.withColumn("_k", key).orderBy("epoch", "u", "_k").limit(max_steps)
    return first.withColumn("step", F.row_number().over(W.orderBy("epoch", "u", "_k")) - 1).drop("_k")  # max_steps rows


def epochs_needed(n_batches: int, max_steps: int) -> int:
    return max(1, math.ceil(max_steps / max(1, n_batches)))


def learning_rate(step: Column, steps: int, warmup: int, top: float, floor: float = 0.0) -> Column:
    """Linear warm-up, then a half cosine down to the floor."""
    x = (step - warmup) / max(1, steps - warmup)
    return F.when(step < warmup, top * (step + 1) / warmup).otherwise(floor + (top - floor) * 0.5 * (1 + F.cos(math.pi * x)))


def ramp(step: Column, steps: int, start: float, stop: float) -> Column:
    return start + (stop - start) * F.least(F.lit(1.0), step / steps)
