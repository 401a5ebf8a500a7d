"""Profiles of a corpus and the battery of checks over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.functions import arrays as A
from sievemill.operators.records import well_formed


def nearest_rank(rows: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    """Per group and share q the value at rank min(n - 1, int(q n)) in ascending order, counted over the distinct values with
    their frequencies, so a group of any size costs as many rows as it has values."""
    freq = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by)
    run = freq.withColumn("_end", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    each = run.withColumn("q", F.explode(F.array(*map(F.lit, shares))))
    rank = F.least(F.col("_n") - 1, F.floor(F.col("q") * F.col("_n")))
    return each.where((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c"))).select(*by, "q", F.col(value).alias("value"))


def mode_share(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by, value).agg(F.count("*").alias("_c")).groupBy(*by).agg((F.max("_c") / F.sum("_c")).alias("share"))


def view_ok(view: Column) -> Column:
    """A view has a kind, a task and texts that aren't blank; no view is fine."""
    texts = view["text"]
    return view.isNull() | F.coalesce((view["kind"] != "") & (view["task"] != "") & (F.size(texts) > 0) & ~F.exists(texts, lambda x: x.isNull() | (F.trim(x) == "")), F.lit(False))


def checks(records: DataFrame, datasets: DataFrame, licences: DataFrame, classes: list[str]) -> DataFrame:
    """check and n_bad: rows that break the schema, the view or the grouping rule, ids given to different rows, options twice in a
    record, and sources that aren't listed, enabled and licensed. All row checks share one pass."""
    n = lambda c, name: F.count_if(~F.coalesce(c, F.lit(False))).alias(name)
    one = records.agg(
        n(well_formed(), "schema"),
        n(view_ok(F.col("view")), "view"),
        n(F.col("grp").isNull() | (F.col("split") == "train"), "group_outside_train"),
        n(F.col("options").isNull() | A.unique(F.col("options")), "options_twice"),
        n(F.col("id").startswith(F.concat_ws("/", "source", "split")), "id_prefix"),
    )
    names = one.columns
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("n_bad")) for c in names))).alias("x")).select("x.*")
    ids = records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("unique_ids").alias("check"), F.count("*").alias("n_bad"))
    good = datasets.where("enabled").join(F.broadcast(licences.where(F.col("class").isin(*classes)).select(F.col("key").alias("license"))), "license", "left_semi").select(F.col("key").alias("source"))
    bad = records.select("source").distinct().join(good, "source", "left_anti").agg(F.lit("licensed_sources").alias("check"), F.count("*").alias("n_bad"))
    return rows.unionByName(ids).unionByName(bad)
