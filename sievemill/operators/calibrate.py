"""Temperatures: fitting on a grid with refinement, per type and per number of options, applied and cross-fitted."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import arrays as A

LO, HI, GRID, FINE, ROUNDS, NEAR = 0.5, 5.0, 61, 21, 3, 1.08
LEAST = 10


def grid() -> list[float]:
    return [math.exp(math.log(LO) + i * (math.log(HI) - math.log(LO)) / (GRID - 1)) for i in range(GRID)]


def losses(z: list[np.ndarray], gold: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Negative log of the gold's softmax, per temperature (of all rows alike, or per row) and row."""
    n = np.fromiter(map(len, z), np.int64, len(z))
    flat, start = np.concatenate(z), np.cumsum(n) - n
    top = np.maximum.reduceat(flat, start)
    out = np.empty((t.shape[-1], len(z)))
    for k in range(t.shape[-1]):
        at = t[:, k]
        out[k] = np.log(np.add.reduceat(np.exp((flat - np.repeat(top, n)) / np.repeat(at, n)), start)) - (flat[start + gold] - top) / at
    return out


def _sums(by: str, candidates: dict):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            group = b[by].to_pylist()
            z, gold = [np.asarray(x, float) for x in b["z"].to_pylist()], b["gold"].to_numpy(zero_copy_only=False).astype(np.int64)
            t = np.array([candidates[g] for g in group])
            loss = losses(z, gold, t)
            names, which = np.unique(group, return_inverse=True)
            sums = np.stack([np.bincount(which, row, len(names)) for row in loss])
            counts = np.bincount(which, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, t.shape[1]).tolist(), pa.string()), pa.array(np.tile(np.arange(t.shape[1]), len(names)), pa.int32()), pa.array(sums.T.ravel()), pa.array(np.repeat(counts, t.shape[1]))], names=["g", "k", "loss", "n"])

    return run


def fit(rows: DataFrame, by: str) -> DataFrame:
    """The temperature per group of rows (by, z, gold) that minimises the mean log loss: a logarithmic grid, then three
    rounds around the best. A round is one pass that gives a sum per task, group and temperature; no row is copied. Groups
    are types or buckets, a dozen, so each round's temperatures are the driver's. Groups under ten rows get 1. Ties go to the smaller temperature. Rows without
    logits, group or gold take no part."""
    r = rows.where(F.col(by).isNotNull() & (F.size("z") > 0) & F.col("gold").between(0, F.size("z") - 1)).select(by, "z", "gold")
    sizes = {x[by]: x["n"] for x in r.groupBy(by).agg(F.count("*").alias("n")).collect()}  # a row per group
    candidates = {g: grid() for g in sizes}
    best: dict[str, float] = {}
    for left in range(ROUNDS, -1, -1):
        sums = r.mapInArrow(_sums(by, candidates), "g string, k int, loss double, n long").groupBy("g", "k").agg((F.sum("loss") / F.sum("n")).alias("loss")).collect()  # GRID rows per group
        for g in sizes:
            best[g] = min((x["loss"], candidates[g][x["k"]]) for x in sums if x["g"] == g)[1]
        if left:
            candidates = {g: [lo + (hi - lo) * i / (FINE - 1) for i in range(FINE)] for g, t in best.items() for lo, hi in [(t / NEAR, t * NEAR)]}
    out = [(g, n, 1.0 if n < LEAST else max(LO, min(HI, best[g]))) for g, n in sizes.items()]
    return rows.sparkSession.createDataFrame(out, f"`{by}` string, n long, t double")


def bucket(qtype: Column, k: Column) -> Column:
    """Type and number of options: 2, 3-5, 6-10, 11+."""
    return F.concat(qtype, F.lit("/"), F.when(k <= 2, "2").when(k <= 5, "3-5").when(k <= 10, "6-10").otherwise("11+"))


def fit_both(rows: DataFrame, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """Temperatures per type, and per bucket of at least `least` rows; both rounded to four places."""
    r = rows.withColumn("bucket", bucket(F.col("qtype"), F.size("z")))
    by_type = fit(r, "qtype").withColumn("t", F.round("t", 4))
    return by_type, fit(r, "bucket").where(F.col("n") >= least).withColumn("t", F.round("t", 4))


def apply(rows: DataFrame, by_type: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """rows with probs at the temperature of their bucket, else of their type, else 1. Both tables have a row per type or
    bucket, twelve at most."""
    r = rows.withColumn("bucket", bucket(F.col("qtype"), F.size("z")))
    r = r.join(F.broadcast(by_bucket.select("bucket", F.col("t").alias("tb"))), "bucket", "left").join(F.broadcast(by_type.select("qtype", F.col("t").alias("tq"))), "qtype", "left")
    return r.withColumn("probs", A.softmax(F.col("z"), F.coalesce("tb", "tq", F.lit(1.0)))).drop("tb", "tq", "bucket")


def crossfit(rows: DataFrame, fold: Column, least: int = 200) -> DataFrame:
    """rows with probs under temperatures fitted on the other half by fold."""
    r = rows.withColumn("fold", fold)
    parts = [apply(r.where(F.col("fold") == f), *fit_both(r.where(F.col("fold") != f), least)) for f in (0, 1)]
    return parts[0].unionByName(parts[1])
