"""Probe items: evaluation questions in a native wording and in English, drawn evenly over the classes of several sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.operators.sampling import balanced
from sievemill.sources import sinks

CRITERIA = "array<struct<key: string, desc: string>>"


@dataclass(frozen=True)
class Family:
    """A set's questions. `labels` lead from a label of the set to the native and the English name of its answer, in the order of the options."""

    name: str
    source: str
    lang: str
    split: str
    qtype: str
    per_class: int
    instructions: tuple[str, str]
    labels: dict[str, tuple[str, str]]
    note: str | None = None


def question(state: Column, qtype: Column, instructions: Column, criteria: Column) -> Column:
    """A state and what is asked of it."""
    return F.struct(state.alias("state"), F.struct(qtype.alias("type"), instructions.alias("instructions"), criteria.cast(CRITERIA).alias("criteria")).alias("question"))


def _criteria(names: list[str]) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("key"), F.lit(None).cast("string").alias("desc")) for n in names))


def items(family: Family, rows: DataFrame) -> DataFrame:
    """Items from rows (row, text, label): as many of each label by digest, and an error where a label has too few. Rows without a text or with
    another label are no items."""
    good = rows.where(F.col("text").isNotNull() & (F.trim("text") != "") & F.col("label").isin(*family.labels)).select(F.col("row").cast("string").alias("row"), "text", "label")
    drawn = balanced(good, family.per_class, ["label"], F.col("row"), "probe", family.name, family.source, strict=True)
    native, english = ([v[i] for v in family.labels.values()] for i in (0, 1))
    gold = lambda i: F.coalesce(*(F.when(F.col("label") == k, v[i]) for k, v in family.labels.items()))
    ask = lambda i, names: question(F.col("text"), F.lit(family.qtype), F.lit(family.instructions[i]), F.lit(None) if family.qtype == "noul" else _criteria(names))
    return drawn.select(
        F.concat_ws("-", F.lit("probe"), F.lit(family.name), F.lit(family.lang), "row").alias("id"),
        F.lit(family.lang).alias("lang"),
        F.lit(family.source).alias("source"),
        F.lit(family.split).alias("split"),
        F.col("row").alias("source_row"),
        F.lit(family.name).alias("family"),
        F.lit(family.qtype).alias("qtype"),
        ask(0, native).alias("q_native"),
        gold(0).alias("gold_native"),
        ask(1, english).alias("q_en"),
        gold(1).alias("gold_en"),
        F.lit(family.note).cast("string").alias("note"),
    )


def build(families: list[Family], tables: dict[str, DataFrame]) -> DataFrame:
    """The items of all families; tables by the family's name."""
    out = items(families[0], tables[families[0].name])
    for f in families[1:]:
        out = out.unionByName(items(f, tables[f.name]))
    return out


def flattened(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """A row for each entry of the array `inner` in each struct of the array `outer`: the other columns, the struct's other fields, i and j."""
    o = rows.select(*(c for c in rows.columns if c != outer), F.posexplode(outer).alias("i", "_o")).select("*", "_o.*").drop("_o")
    return o.select(*(c for c in o.columns if c != inner), F.posexplode(inner).alias("j", inner))


def zipped(a: DataFrame, b: DataFrame, by: list[str], order_a: str, order_b: str, same: tuple[str, str] | None = None) -> DataFrame:
    """Rows of a and b at the same place within `by`, in the order of a column each. same names a column of each that must agree in all pairs; a
    pair where they don't ends the query with an error, as the two are then not aligned."""
    at = lambda df, c: df.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(c)))
    j = at(a, order_a).join(at(b, order_b), [*by, "_at"])
    if same:
        ok = F.col(same[0]).eqNullSafe(F.col(same[1]))
        j = j.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("not aligned at "), F.concat_ws("/", *by, "_at"))).cast("boolean")))
    return j.drop("_at")


def parallel(zh: DataFrame, en: DataFrame, name: str, labels: dict[str, tuple[str, str]], instructions: tuple[str, str]) -> DataFrame:
    """Items of one set in two languages, (row, premise, hypothesis, label) each, joined by place: the same item in both wordings, whose labels must agree."""
    a = zh.select("row", F.col("premise").alias("pa"), F.col("hypothesis").alias("ha"), F.col("label").alias("la"), F.lit(0).alias("_one"))
    b = en.select(F.col("row").alias("row_b"), F.col("premise").alias("pb"), F.col("hypothesis").alias("hb"), F.col("label").alias("lb"), F.lit(0).alias("_one"))
    j = zipped(a, b, ["_one"], "row", "row_b", ("la", "lb")).where(F.col("la").isin(*labels))
    side = lambda p, h, i: question(F.concat(p, F.lit("\n"), h), F.lit("choice"), F.lit(instructions[i]), _criteria([v[i] for v in labels.values()]))
    gold = lambda i: F.coalesce(*(F.when(F.col("la") == k, v[i]) for k, v in labels.items()))
    return j.select(F.concat_ws("-", F.lit("probe"), F.lit(name), "row").alias("id"), F.lit(name).alias("family"), side(F.col("pa"), F.col("ha"), 0).alias("q_native"), gold(0).alias("gold_native"), side(F.col("pb"), F.col("hb"), 1).alias("q_en"), gold(1).alias("gold_en"))


def typed_decisions(cases: DataFrame) -> DataFrame:
    """A row per question of cases (id, state, questions, gold), the last three JSON texts: case and question as id, the state as it stands where it isn't an object, the
    question's type, instructions and options, its gold label and soft gold. A case whose JSON doesn't parse has no rows."""
    ask = "map<string, struct<type: string, instructions: string, criteria: array<string>>>"
    answer = "map<string, struct<label: string, probabilities: array<double>, score: double>>"
    j = cases.select("id", "state", F.from_json("questions", ask).alias("q"), F.from_json("gold", answer).alias("g"))
    each = j.select("id", "state", "g", F.explode("q").alias("qid", "question"))
    g = F.element_at("g", F.col("qid"))
    return each.select(F.concat_ws("/", "id", "qid").alias("id"), "state", F.col("question.type").alias("qtype"), F.col("question.instructions").alias("instructions"), F.col("question.criteria").alias("criteria"), g["label"].alias("gold"), g["probabilities"].alias("gold_soft"), g["score"].alias("gold_score"))


def dump(spark: SparkSession, items: DataFrame, path: str, order: str = "id") -> str:
    """The items as JSON lines in order, with the checksums of the files beside them; gives the digest of that list."""
    sinks.jsonl(items, path, [order])
    return sinks.seal(spark, path)
