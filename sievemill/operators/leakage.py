"""Duplicates and leakage: what of the training split stands in held-out or probe texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.functions import grams as G
from sievemill.functions import text as X
from sievemill.session import spread, stored


def _units(records: DataFrame) -> DataFrame:
    """ord, split and unit: the keys of at least MIN_UNIT characters of the texts in each record. Texts become rows before
    they are rewritten, so the key is computed column-wise and not inside an array."""
    parts = X.record_parts(F.col("context"), F.col("type"), F.col("question"), F.col("view.text"))
    return spread(records.select("ord", "split", "type", "question", "context", "view")).select("ord", "split", F.explode(parts).alias("part")).select("ord", "split", X.norm_key(F.col("part"), once=True).alias("unit")).where(F.length("unit") >= X.MIN_UNIT)


def units_of(records: DataFrame) -> DataFrame:
    """ord and the sorted distinct units of every record, none for those without."""
    per = _units(records).groupBy("ord").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    return records.select("ord").join(per, "ord", "left").withColumn("units", F.coalesce("units", F.array().cast("array<string>")))


def dedup(records: DataFrame) -> DataFrame:
    """The first record, by ord, of each source, split, question, context (null as empty) and ordered options."""
    w = W.partitionBy("source", "split", "question", F.coalesce("context", F.lit("")), "options").orderBy("ord")
    return records.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_hashed(records: DataFrame) -> DataFrame:
    """The same by one hash aggregation on a digest of the key: a hot key is combined before the shuffle and no group is
    sorted in one task."""
    return records.join(first_ords(records), "ord", "left_semi")


def first_ords(records: DataFrame) -> DataFrame:
    """ord of the records that dedup keeps."""
    key = F.sha2(F.to_json(F.struct("source", "split", "question", F.coalesce("context", F.lit("")).alias("c"), "options")), 256)
    return records.select(key.alias("k"), "ord").groupBy("k").agg(F.min("ord").alias("ord")).select("ord")


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def probe_units(items: DataFrame) -> DataFrame:
    """source and key of the state of every item, whole and line by line, of at least MIN_UNIT characters."""
    s = items.select("source", F.explode(F.array_distinct(F.array("q_native.state", "q_en.state"))).alias("s")).where("s IS NOT NULL")
    pieces = s.select("source", F.explode(F.array_distinct(F.concat(F.array("s"), F.split("s", "\n")))).alias("p"))
    return pieces.select("source", X.norm_key(F.col("p"), once=True).alias("unit")).where(F.length("unit") >= X.MIN_UNIT)


def unit_rows(records: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """ord, split and unit, a row per unit, written once for all the checks that read it. `more` (ord, units) has further texts of a record, such as the
    raw fields a converter made it from; they become units like its own."""
    rows = _units(records)
    if more is not None:
        extra = records.select("ord", "split").join(more, "ord").select("ord", "split", F.explode("units").alias("part")).select("ord", "split", X.norm_key(F.col("part"), once=True).alias("unit"))
        rows = rows.unionByName(extra.where(F.length("unit") >= X.MIN_UNIT)).distinct()
    return stored(rows, "units")


def external_units(texts: DataFrame) -> DataFrame:
    """The distinct units of evaluation texts from outside (text), whole and line by line."""
    t = texts.where("text IS NOT NULL").select(F.explode(F.array_distinct(F.concat(F.array("text"), F.split("text", "\n")))).alias("p"))
    return t.select(X.norm_key(F.col("p"), once=True).alias("unit")).where(F.length("unit") >= X.MIN_UNIT).distinct()


def held_out_units(rows: DataFrame) -> DataFrame:
    """The distinct units of dev and test among unit_rows."""
    return rows.where("split <> 'train'").select("unit").distinct()


def overlapping(rows: DataFrame, units: DataFrame) -> DataFrame:
    """ord of the records any of whose unit_rows is among `units`."""
    return rows.select("ord", "unit").join(units.select("unit").distinct(), "unit", "left_semi").select("ord").distinct()


def contained(rows: DataFrame, texts: DataFrame, least: int = X.MIN_CONTAINED) -> DataFrame:
    """ord of the records a unit of which, of at least `least` characters, stands inside one of texts.doc (keys).

    The grams of `least` characters of each text are hashed in one pass over it; of them stay, before anything is paired, those that begin or end a
    unit. A unit meets the texts that hold its first gram and its last one, through the one of both that fewer texts hold, and the exact
    test follows."""
    units = rows.select("unit").where(F.length("unit") >= least).distinct().mapInArrow(G.ends(least), "unit string, first long, last long")
    docs = stored(spread(texts).select("doc").where(F.length("doc") >= least).distinct().withColumn("d", F.monotonically_increasing_id()), "texts")
    units = stored(units, "unit-ends")
    known = units.select(F.col("first").alias("gram")).union(units.select(F.col("last").alias("gram"))).distinct()
    grams = stored(docs.select("d", "doc").mapInArrow(G.all_grams(least), "d long, gram long").join(known, "gram", "left_semi"), "grams")
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = units.join(often.withColumnRenamed("gram", "first").withColumnRenamed("n", "n_first"), "first").join(often.withColumnRenamed("gram", "last").withColumnRenamed("n", "n_last"), "last")
    seek = F.when(F.col("n_first") <= F.col("n_last"), F.col("first")).otherwise(F.col("last"))
    other = F.when(F.col("n_first") <= F.col("n_last"), F.col("last")).otherwise(F.col("first"))
    met = ranked.select("unit", seek.alias("gram"), other.alias("other")).join(grams, "gram").select("unit", "d", F.col("other").alias("gram")).join(grams, ["gram", "d"], "left_semi")
    hits = met.join(docs, "d").where(F.contains("doc", "unit")).select("unit").distinct()
    return rows.select("ord", "unit").join(hits, "unit", "left_semi").select("ord").distinct()


def decontaminate(records: DataFrame, items: DataFrame, eval_only: DataFrame, selected: DataFrame | None = None, external: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """Every record with the reason it is dropped for, or 'kept'. Copies go first; a copy of a contaminated record counts as
    a copy only. Held-out units are those of all dev and test records before any drop. Training records go for a unit among
    them or among the probes' (overlap), or for one inside a context of a source in eval_only.source (inside); dev and
    test records go for a unit among the probes' (probe).

    The evaluation side: without `selected` the dev and test records of every source (mode full); with it only those of the sources in selected.source.
    `external` (text) adds evaluation texts from outside to the held-out units and to the texts that units may stand inside of. `more` (ord, units) adds
    the converters' own units to those of the records."""
    probe = probe_units(items).select("unit").distinct()
    rows = unit_rows(records, more)
    train, held = rows.where("split = 'train'"), rows.where("split <> 'train'")
    side = held
    if selected is not None:
        ours = records.select("ord", "source").join(selected.select("source").distinct(), "source", "left_semi")
        side = held.join(ours.select("ord"), "ord", "left_semi")
    units = held_out_units(side).unionByName(probe)
    only = records.join(F.broadcast(eval_only.select("source").distinct()), "source", "left_semi")  # eval_only: a column of the dataset list
    texts = only.where("context IS NOT NULL").select(X.norm_key(F.col("context"), once=True).alias("doc"))
    if external is not None:
        units = units.unionByName(external_units(external))
        texts = texts.unionByName(external.where("text IS NOT NULL").select(X.norm_key(F.col("text"), once=True).alias("doc")))
    marks = [
        (first_ords(records), "first"),
        (overlapping(train, units), "overlap"),
        (contained(train, texts), "inside"),
        (overlapping(held, probe), "probe"),
    ]
    # The marks meet in one narrow aggregation, so the records themselves are joined once.
    every = marks[0][0].withColumn("mark", F.lit(marks[0][1]))
    for m, name in marks[1:]:
        every = every.unionByName(m.withColumn("mark", F.lit(name)))
    flags = every.groupBy("ord").agg(*(F.max(F.col("mark") == name).alias(f"_{name}") for _, name in marks))
    out = records.join(flags, "ord", "left")
    reason = F.when(~F.coalesce("_first", F.lit(False)), "duplicate").when(F.col("_overlap"), "overlap").when(F.col("_inside"), "inside").when(F.col("_probe"), "probe").otherwise("kept")
    return out.withColumn("reason", reason).drop(*(f"_{name}" for _, name in marks))
