"""Batches and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.functions.hashing import sql_uniform
from sievemill.operators import batching as B
from sievemill.plans.registry import query

SIZE = 16
_N = "length(question) + coalesce(length(context), 0)"


def _items(t):
    return t.records.where("question IS NOT NULL").select(F.col("ord").alias("id"), (F.length("question") + F.coalesce(F.length("context"), F.lit(0))).cast("long").alias("n"))


_POOL = f"""(SELECT id, n, floor({sql_uniform("'13'", "'pool'", "id::VARCHAR")} * greatest(1, ceil((SELECT count(*) FROM records WHERE question IS NOT NULL) / {SIZE * 50}.0)))::INT AS pool FROM (SELECT ord AS id, {_N} AS n FROM records WHERE question IS NOT NULL))"""


@query(f"SELECT id, n, pool, ((row_number() OVER (PARTITION BY pool ORDER BY n, id) - 1) // {SIZE})::INT AS batch FROM {_POOL}")
def batch_pools(t):
    i = _items(t)
    return B.pooled(i, i.count(), SIZE)


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY n, id) AS rn, greatest(0, ceil(n / 32)::BIGINT * 32) AS wide FROM {_POOL}),
c AS (SELECT id, n, pool, rn, 0 AS batch, 1 AS held FROM s WHERE rn = 1 UNION ALL SELECT s.id, s.n, s.pool, s.rn, CASE WHEN c.held + 1 > {SIZE} OR (c.held + 1) * s.wide > 4096 THEN c.batch + 1 ELSE c.batch END,
CASE WHEN c.held + 1 > {SIZE} OR (c.held + 1) * s.wide > 4096 THEN 1 ELSE c.held + 1 END FROM c JOIN s ON s.pool = c.pool AND s.rn = c.rn + 1) SELECT id, n, pool, batch FROM c""")
def batch_pools_capped(t):
    i = _items(t)
    return B.pooled(i, i.count(), SIZE, most=4096)


_WIDE = f"(SELECT ord AS id, {_N} AS n, greatest(32, ceil(({_N}) / 32)::BIGINT * 32) AS wide FROM records WHERE question IS NOT NULL)"


@query(f"SELECT wide, batch, count(*) AS items FROM (SELECT wide, (row_number() OVER (PARTITION BY wide ORDER BY n, id) - 1) // greatest(1, least({SIZE}, 4096 // wide)) AS batch FROM {_WIDE}) GROUP BY ALL")
def batch_by_length(t):
    return B.by_length(_items(t), SIZE, 4096).groupBy("wide", "batch").agg(F.count("*").alias("items"))


@query(f"SELECT max(tokens) AS most_tokens, max(longest) AS longest FROM (SELECT count(*) * ceil(max(n) / 32)::BIGINT * 32 AS tokens, max(n) AS longest FROM (SELECT n, pool, (row_number() OVER (PARTITION BY pool ORDER BY n, id) - 1) // {SIZE} AS batch FROM {_POOL}) GROUP BY pool, batch)")
def batch_worst(t):
    i = _items(t)
    return B.worst(B.pooled(i, i.count(), SIZE), "pool", "batch").select("most_tokens", "longest")


@query(f"SELECT round(sum(wide) / sum(n), 8) AS padding, round(avg(n), 8) AS mean_length FROM {_WIDE}")
def batch_padding(t):
    i = _items(t).withColumn("wide", F.greatest(B.padded(F.col("n")), F.lit(32)))
    return i.agg(F.round(F.sum("wide") / F.sum("n"), 8).alias("padding"), F.round(F.avg("n"), 8).alias("mean_length"))


@query("""SELECT id, scored_at, list_resize(probs, k, 0.0) AS probs, list_concat(list_transform(probs, lambda x: 1), list_transform(range(k - len(probs)), lambda x: 0)) AS mask FROM
(SELECT id, scored_at, probs, max(len(probs)) OVER (PARTITION BY split_part(id, '/', 1)) AS k FROM predictions WHERE probs IS NOT NULL)""")
def batch_collate(t):
    p = t.predictions.where("probs IS NOT NULL").select("id", "scored_at", "probs", F.split_part("id", F.lit("/"), F.lit(1)).alias("source"))
    width = p.groupBy("source").agg(F.max(F.size("probs")).alias("k"))
    j = p.join(width, "source")
    return j.select("id", "scored_at", B.pad(F.col("probs"), F.col("k"), F.lit(0.0)).alias("probs"), B.pad(F.transform("probs", lambda x: F.lit(1)), F.col("k"), F.lit(0)).alias("mask"))


_BATCHES = f"(SELECT DISTINCT pool, (row_number() OVER (PARTITION BY pool ORDER BY n, id) - 1) // {SIZE} AS batch FROM {_POOL})"


@query(f"""SELECT epoch, pool, batch::INT AS batch, (row_number() OVER (ORDER BY epoch, u, k) - 1)::INT AS step FROM (SELECT *, {sql_uniform("'13'", "epoch::VARCHAR", "k")} AS u FROM (SELECT *, concat_ws('/', pool, batch) AS k FROM {_BATCHES}), (VALUES (0), (1), (2)) e(epoch)) QUALIFY step < 700""")
def batch_plan(t):
    """Three epochs of the batches, each shuffled anew, cut off after 700 steps."""
    i = _items(t)
    b = B.pooled(i, i.count(), SIZE).select("pool", "batch").distinct()
    return B.plan(b, F.concat_ws("/", "pool", "batch"), 3, max_steps=700).select("epoch", "pool", "batch", "step")


@query("SELECT step, rank, (step * 4 + rank) % 23 AS batch FROM range(100) s(step), range(4) r(rank)")
def batch_ranks(t):
    r = t.spark.range(100).select(F.col("id").alias("step"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(4)))).alias("rank"))
    return r.select("step", "rank", ((F.col("step") * 4 + F.col("rank")) % 23).alias("batch"))


@query(f"SELECT step, round(CASE WHEN step < 50 THEN 3e-5 * (step + 1) / 50 ELSE 3e-5 * 0.5 * (1 + cos({math.pi!r} * (step - 50) / 450)) END, 12) AS rate, round(0.1 + 0.4 * least(1.0, step / 200), 10) AS sigma FROM range(500) s(step)")
def schedules(t):
    s = F.col("id")
    return t.spark.range(500).select(s.alias("step"), F.round(B.learning_rate(s, 500, 50, 3e-5), 12).alias("rate"), F.round(B.ramp(s, 200, 0.1, 0.5), 10).alias("sigma"))


@query(f"SELECT source, ord, n FROM (SELECT source, ord, {_N} AS n FROM records) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC NULLS LAST, ord) <= 3")
def longest_per_source(t):
    r = t.records.select("source", "ord", (F.length("question") + F.coalesce(F.length("context"), F.lit(0))).alias("n"))
    w = W.partitionBy("source").orderBy(F.desc_nulls_last("n"), "ord")
    return r.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")
