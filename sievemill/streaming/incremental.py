"""Incremental de-duplication and leakage filtering of arriving records.

A stream of records drops what it has seen within the watermark, by the same key as the batch operator, and what shares a unit with
a static set of held-out units; late rows beyond the watermark are left to the batch run. Rows without an arrival time have no
place in the stream: they are taken by the batch run as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import text as X


def records_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def dedup(stream: DataFrame, arrived: str = "loaded_at", late: str = "30 days") -> DataFrame:
    """The first arrival of each source, split, question, context and ordered options. The state holds a digest per key, and only
    for as long as the watermark allows copies to come."""
    key = F.sha2(F.to_json(F.struct("source", "split", "question", F.coalesce("context", F.lit("")).alias("c"), "options")), 256)
    timed = stream.where(F.col(arrived).isNotNull()).withColumn("_key", key).withColumn(arrived, F.col(arrived).cast("timestamp")).withWatermark(arrived, late)
    return timed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def without_leaks(stream: DataFrame, units: DataFrame) -> DataFrame:
    """Training records whose context isn't among the static units; the other splits pass. A stream-static anti join, so the
    static side is read anew for every batch."""
    key = X.norm_key(F.col("context"))
    marked = stream.withColumn("unit", F.when((F.col("split") == "train") & (F.length(key) >= X.MIN_UNIT), key))
    known = units.select("unit").distinct().withColumn("_leak", F.lit(True))
    return marked.join(known, "unit", "left").where("_leak IS NULL").drop("unit", "_leak")


def counts(stream: DataFrame, arrived: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Rows and sums per window and type of an event stream; late rows count until the watermark passes their window."""
    w = F.window(arrived, window)
    return stream.withColumn(arrived, F.col(arrived).cast("timestamp")).withWatermark(arrived, late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, in batches, into a Parquet folder, exactly once per checkpoint."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
