"""Probe builders over the tables at hand."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievemill.functions.hashing import sql_digest
from sievemill.operators import probes as P
from sievemill.plans.registry import query
from sievemill.session import shared_dir
from sievemill.sources import sinks

# Families that the documents and messages can carry, with a wording of their own.
FAMILIES = [
    P.Family("domain", "documents", "en", "test", "choice", 2, ("Which field is it from?", "Which field is it from?"), {"law": ("law", "law"), "travel": ("travel", "travel"), "health": ("health", "health")}),
    P.Family("length", "documents", "en", "test", "noul", 3, ("Is it long?", "Is it long?"), {"yes": ("true", "true"), "no": ("false", "false")}, "length only"),
    P.Family("stars", "messages", "zh", "test", "score", 1, ("质量如何？", "How good is it?"), {"0": ("差", "bad"), "1": ("中", "fair"), "2": ("好", "good")}),
]
_LONG = "CASE WHEN n_chars > 800 THEN 'yes' WHEN n_chars < 200 THEN 'no' END"
_SOURCES = {
    "domain": "SELECT doc_id::VARCHAR AS row, text, domain AS label FROM documents",
    "length": f"SELECT doc_id::VARCHAR AS row, text, {_LONG} AS label FROM documents",
    "stars": "SELECT message_id || '/' || n AS row, text, floor(least(v, 0.99) * 3)::INT::VARCHAR AS label FROM (SELECT message_id, text, unnest(labels.name) AS n, unnest(labels.value) AS v FROM (SELECT DISTINCT message_id, text, labels FROM messages)) WHERE n = 'quality'",
}


def _family(f: P.Family) -> str:
    at = {k: v[0] for k, v in f.labels.items()}
    gold = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in at.items()) + " END"
    return f"""SELECT 'probe-{f.name}-{f.lang}-' || row AS id, '{f.name}' AS family, '{f.qtype}' AS qtype, text AS state, {gold} AS gold, CASE WHEN '{f.qtype}' = 'noul' THEN 0 ELSE {len(at)} END AS options FROM ({_SOURCES[f.name]}) WHERE trim(text) <> '' AND label IN {tuple(at)}
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sql_digest("'probe'", f"'{f.name}'", f"'{f.source}'", "row")}, row) <= {f.per_class}"""


def _tables(t):
    d = t.documents
    long_ = F.when(F.col("n_chars") > 800, "yes").when(F.col("n_chars") < 200, "no")
    m = t.messages.select("message_id", "text", F.arrays_zip("labels.name", "labels.value").alias("each")).distinct()
    rated = m.select("message_id", "text", F.explode("each").alias("x")).where("x.name = 'quality'")
    return {
        "domain": d.select(F.col("doc_id").alias("row"), "text", F.col("domain").alias("label")),
        "length": d.select(F.col("doc_id").alias("row"), "text", long_.alias("label")),
        "stars": rated.select(F.concat_ws("/", "message_id", "x.name").alias("row"), "text", F.floor(F.least(F.col("x.value"), F.lit(0.99)) * 3).cast("int").cast("string").alias("label")),
    }


@query(" UNION ALL ".join(f"({_family(f)})" for f in FAMILIES))
def probes_families(t):
    """As many items of each class for a choice, a yes-no question and a scale."""
    p = P.build(FAMILIES, _tables(t))
    return p.select("id", "family", "qtype", F.col("q_native.state").alias("state"), F.col("gold_native").alias("gold"), F.coalesce(F.size("q_native.question.criteria"), F.lit(0)).alias("options"))


@query("SELECT message_id, (i - 1)::INT AS i, (j - 1)::INT AS j, n AS part FROM (SELECT message_id, i, unnest(ns) AS n, generate_subscripts(ns, 1) AS j FROM (SELECT message_id, unnest([labels.name, ['text', role]]) AS ns, unnest([1, 2]) AS i FROM (SELECT DISTINCT message_id, role, labels FROM messages)))")
def probes_flattened(t):
    """Nested questions, a row each: here a message's label names and two fixed entries."""
    m = t.messages.select("message_id", "role", "labels").distinct()
    nested = m.select("message_id", F.array(F.struct(F.col("labels.name").alias("part")), F.struct(F.array(F.lit("text"), "role").alias("part"))).alias("outer"))
    return P.flattened(nested, "outer", "part").select("message_id", "i", "j", "part")


_SIDE = "(SELECT q_native.state AS s, q_{0}.question.instructions AS h, qtype, row_number() OVER (ORDER BY item_id) AS i FROM probe_items)"


@query(f"SELECT 'probe-par-' || lpad(a.i::VARCHAR, 6, '0') AS id, a.s || chr(10) || a.h AS native, b.s || chr(10) || b.h AS en, a.qtype AS gold FROM {_SIDE.replace('{0}', 'native')} a JOIN {_SIDE.replace('{0}', 'en')} b USING (i) WHERE a.h IS NOT NULL AND a.s IS NOT NULL AND b.h IS NOT NULL")
def probes_parallel(t):
    """The same items in two wordings, joined by place; their types agree."""
    from pyspark.sql import Window as W

    i = t.probe_items.withColumn("row", F.lpad(F.row_number().over(W.orderBy("item_id")).cast("string"), 6, "0"))  # a list of fixed size
    side = lambda k: i.select("row", F.col("q_native.state").alias("premise"), F.col(f"q_{k}.question.instructions").alias("hypothesis"), F.col("qtype").alias("label"))
    p = P.parallel(side("native"), side("en"), "par", {k: (k, k) for k in ("choice", "score", "noul")}, ("?", "?"))
    return p.select("id", F.col("q_native.state").alias("native"), F.col("q_en.state").alias("en"), F.col("gold_native").alias("gold")).where("native IS NOT NULL AND en IS NOT NULL")


@query("""SELECT item_id || '/' || q AS id, q_native.state AS state, qtype, CASE q WHEN 'a' THEN q_native.question.instructions ELSE q_en.question.instructions END AS instructions, CASE q WHEN 'a' THEN gold_native ELSE gold_en END AS gold
FROM probe_items, (VALUES ('a'), ('b')) v(q)""")
def probes_typed(t):
    """Cases of two questions each, written as JSON texts and parsed."""
    i = t.probe_items
    ask = lambda k: F.struct(F.col("qtype").alias("type"), F.col(f"q_{k}.question.instructions").alias("instructions"), F.col(f"q_{k}.question.criteria.key").alias("criteria"))
    gold = lambda k: F.struct(F.col(f"gold_{k}").alias("label"))
    cases = i.select(F.col("item_id").cast("string").alias("id"), F.col("q_native.state").alias("state"), F.to_json(F.struct(ask("native").alias("a"), ask("en").alias("b"))).alias("questions"), F.to_json(F.struct(gold("native").alias("a"), gold("en").alias("b"))).alias("gold"))
    return P.typed_decisions(cases).select("id", "state", "qtype", "instructions", "gold")


@query("SELECT lang, count(*) AS n, 0 AS broken FROM probe_items GROUP BY lang")
def probes_dump(t):
    """Written per language with checksums, checked against these, and read back."""
    out = None
    for lang in [r["lang"] for r in t.probe_items.select("lang").distinct().collect()]:  # the languages of a fixed list
        path = f"{shared_dir(t.spark)}/probes-{uuid.uuid4().hex}"
        P.dump(t.spark, t.probe_items.where(F.col("lang").eqNullSafe(F.lit(lang))), path, "item_id")
        bad = sinks.broken(t.spark, path).count()
        back = t.spark.read.schema("item_id long, lang string").json(path).groupBy("lang").agg(F.count("*").alias("n"), F.lit(bad).alias("broken"))
        out = back if out is None else out.unionByName(back)
    return out
