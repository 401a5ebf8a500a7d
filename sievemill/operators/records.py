"""The unified record and the typed decision made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import arrays as A

SCHEMA = "id string, lang string, type string, question string, options array<string>, context string, label int, source string, split string, view struct<kind: string, text: array<string>, task: string, arg: string>, grp string, ord long"


def well_formed() -> Column:
    """Whether a row is a valid record; null fields that a record needs make it false."""
    o, label = F.col("options"), F.col("label")
    noul = label.isin(0, 1) & o.isNull()
    listed = (label >= 0) & (label < F.size(o)) & (F.size(o) >= 2) & A.unique(o)
    ok = F.col("lang").isin("zh", "en") & F.col("type").isin("choice", "score", "noul") & F.col("split").isin("train", "dev", "test") & (F.trim("question") != "")
    return F.coalesce(ok & F.when(F.col("type") == "noul", noul).otherwise(listed), F.lit(False))


def construct(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Records from rows with source, split, row (and variant, where a source makes several): the id is put together from
    them. Malformed rows are dropped, or end the query with an error if strict."""
    parts = [F.col(c).cast("string") for c in ("source", "split", "row", *(["variant"] if "variant" in rows.columns else []))]
    out = rows.withColumn("id", F.concat_ws("/", *parts))
    if strict:
        return out.where(F.when(well_formed(), True).otherwise(F.raise_error(F.concat(F.lit("malformed record "), F.col("id"))).cast("boolean")))
    return out.where(well_formed())


def typed(records: DataFrame, smooth: float = 0.05, neighbour: float = 0.1) -> DataFrame:
    """Typed decisions: state, question in parts, target distribution and gold. Records without a label are out."""
    k = F.when(F.col("type") == "noul", 2).otherwise(F.size("options"))
    gold = F.col("label")
    target = F.when(F.col("type") == "score", A.ordinal(gold, k, neighbour)).otherwise(A.onehot(gold, k, smooth))
    return records.where("label IS NOT NULL").select("ord", "id", "source", "lang", F.coalesce("context", F.lit("")).alias("state"), F.col("type").alias("qtype"), F.col("question").alias("instructions"), F.col("options").alias("criteria"), target.alias("target"), gold.alias("gold"), k.alias("k"))


def probe_decisions(items: DataFrame, prompt: str) -> DataFrame:
    """Decisions of probe items under the native or the English prompt."""
    q, g = F.col("q_native" if prompt == "native" else "q_en"), F.col("gold_native" if prompt == "native" else "gold_en")
    at = F.array_position(q["question"]["criteria"]["key"], g) - 1
    gold = (
        F.when(F.col("qtype") == "choice", F.when(at >= 0, at.cast("int")))
        .when(F.col("qtype") == "score", F.expr(f"try_cast(gold_{'native' if prompt == 'native' else 'en'} AS int)"))
        .otherwise(F.when(F.lower(g).isin("1", "true"), 1).when(F.lower(g).isin("0", "false"), 0))
    )
    k = F.when(F.col("qtype") == "noul", 2).otherwise(F.size(q["question"]["criteria"]))
    k = F.when(k >= 0, k)
    name = F.concat_ws("/", F.lit("probe"), "lang", F.lit("native" if prompt == "native" else "en"))
    slices = F.array(name, F.concat(name, F.lit("/family:"), F.coalesce("family", F.lit(""))), F.concat(name, F.lit("/qtype:"), "qtype"))
    return items.select("item_id", F.concat("id", F.lit(f"#{prompt}")).alias("id"), "source", "lang", q["state"].alias("state"), "qtype", q["question"]["instructions"].alias("instructions"), q["question"]["criteria"].alias("criteria"), gold.alias("gold"), k.alias("k"), slices.alias("slices"))
