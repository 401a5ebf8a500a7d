"""The whole battery of checks over a built corpus: each a name and the number of rows, parts or texts that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions import text as X
from sievemill.operators import governance, leakage, profile, rendering

WARNINGS = ("pinned_counts",)


def option_collisions(records: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct options of training records whose key is that of a probe's option."""
    keys = items.select(F.explode("q_native.question.criteria.key").alias("key")).select(X.norm_key(F.col("key")).alias("k")).distinct()
    return records.where("split = 'train'").select(F.explode("options").alias("o")).distinct().withColumn("k", X.norm_key(F.col("o"))).join(keys, "k", "left_semi").select("o")


def count_differences(pinned: DataFrame, found: DataFrame) -> DataFrame:
    """source, split, expected and found where the counts of held-out records aren't those pinned (source, split, n)."""
    a, b = pinned.select("source", "split", F.col("n").alias("expected")), found.select("source", "split", F.col("n").alias("found"))
    j = a.join(b, ["source", "split"], "full").select("source", "split", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return j.where("expected <> found")


def checks(records: DataFrame, items: DataFrame, datasets: DataFrame, licences: DataFrame, classes: list[str], pinned: DataFrame) -> DataFrame:
    """check and n_bad. pinned is the manifest (source, split, n, sha256) that the corpus was sealed with. Everything but a warning must be 0."""
    rows = leakage.unit_rows(records)
    train, held = rows.where("split = 'train'"), rows.where("split <> 'train'")
    probe = leakage.probe_units(items).select("unit").distinct()
    only = datasets.where("role = 'eval_only'").select(F.col("key").alias("source"))
    texts = records.where("context IS NOT NULL").join(F.broadcast(only), "source", "left_semi").select(X.norm_key(F.col("context")).alias("doc"))
    found = governance.manifest(records)
    asked = items.select(F.col("q_native.question.instructions").alias("instructions")).union(items.select("q_en.question.instructions"))
    questions = records.where("split = 'train'").select("question").distinct()
    twice = records.where("split <> 'train'").select("id", "question", "context", "options", "label").distinct().groupBy("id").count().where("count > 1")
    each = {
        "checksums": governance.differing(pinned, found),
        "train_in_held_out": leakage.overlapping(train, leakage.held_out_units(rows)),
        "train_inside_eval_only": leakage.contained(train, texts),
        "held_out_in_probes": leakage.overlapping(held, probe),
        "train_in_probes": leakage.overlapping(train, probe),
        "instructions_of_probes": rendering.same_texts(asked, questions),
        "options_of_probes": option_collisions(records, items),
        "held_out_ids": twice,
        "pinned_counts": count_differences(pinned.where("split <> 'train'"), found.where("split <> 'train'")),
    }
    out = profile.checks(records, datasets, licences, classes)
    for name, df in each.items():
        out = out.unionByName(df.agg(F.lit(name).alias("check"), F.count("*").alias("n_bad")))
    return out
