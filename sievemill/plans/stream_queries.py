"""The streaming surface, run over whole tables as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievemill.functions import text as X
from sievemill.plans.registry import query
from sievemill.session import shared_dir
from sievemill.streaming import incremental as I


def _run(t, stream, mode="append"):
    at = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    I.run_once(stream, f"{at}/out", f"{at}/check", mode)
    return t.spark.read.schema(stream.schema).parquet(f"{at}/out")


def _stream(t, name, **kw):
    # A file is named by a pattern, as a stream wants a folder; a table in several files is a folder already.
    return I.records_stream(t.spark, f"{t.sf_dir}/{name[:-1]}[{name[-1]}].parquet", getattr(t, name).schema, **kw)


@query("SELECT DISTINCT source, split, question, coalesce(context, '') AS context, options FROM records WHERE loaded_at IS NOT NULL")
def stream_dedup(t):
    out = _run(t, I.dedup(_stream(t, "records"), late="3650 days"))
    return out.select("source", "split", "question", F.coalesce("context", F.lit("")).alias("context"), "options")


_K = X.sql_norm_key("context")


@query(f"SELECT ord FROM records WHERE NOT (split = 'train' AND length({_K}) >= {X.MIN_UNIT} AND {_K} IN (SELECT {_K} FROM records WHERE split <> 'train' AND context IS NOT NULL))")
def stream_leaks(t):
    held = t.records.where("split <> 'train' AND context IS NOT NULL").select(X.norm_key(F.col("context")).alias("unit"))
    return _run(t, I.without_leaks(_stream(t, "records"), held)).select("ord")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL")
def stream_windows(t):
    # One batch of all files: the watermark moves between batches, and files come in no order of time.
    return _run(t, I.counts(_stream(t, "events", files_per_batch=2**31 - 1))).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
