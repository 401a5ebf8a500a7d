"""Leakage of held-out and probe texts into training records, and the joins and set operations behind it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import text as X
from sievemill.operators import leakage as L
from sievemill.plans.registry import query
from sievemill.plans.render_queries import W

# Units of every record, once; the checks below are written over these three relations.
_U = f"u AS MATERIALIZED (SELECT ord, source, split, unnest({X.sql_units('nfc_normalize(context)', 'type', 'nfc_normalize(question)', 'list_transform(view.text, lambda v: nfc_normalize(v))')}) AS unit FROM records)"
_P = f"""p AS MATERIALIZED (SELECT DISTINCT source, unit FROM (SELECT source, {X.sql_norm_key('piece')} AS unit FROM (SELECT source, unnest(list_distinct(list_concat([s], string_split(s, chr(10))))) AS piece
FROM (SELECT source, unnest([q_native.state, q_en.state]) AS s FROM probe_items) WHERE s IS NOT NULL)) WHERE length(unit) >= {X.MIN_UNIT})"""
_ONLY = "SELECT key FROM datasets WHERE role = 'eval_only'"
_T = f"t AS MATERIALIZED (SELECT DISTINCT {X.sql_norm_key('context')} AS doc FROM records WHERE source IN ({_ONLY}) AND context IS NOT NULL)"
_F = "f AS MATERIALIZED (SELECT ord FROM records QUALIFY row_number() OVER (PARTITION BY source, split, question, coalesce(context, ''), options ORDER BY ord) = 1)"
_GRAM = f"""g AS MATERIALIZED (SELECT DISTINCT doc, substr(doc, i, {X.MIN_CONTAINED}) AS gram FROM (SELECT doc, unnest(range(1, length(doc) - {X.MIN_CONTAINED} + 2)) AS i FROM t WHERE length(doc) >= {X.MIN_CONTAINED}))"""
_IN = f"""inside AS MATERIALIZED (SELECT DISTINCT u.ord FROM u JOIN g ON g.gram = left(u.unit, {X.MIN_CONTAINED}) WHERE length(u.unit) >= {X.MIN_CONTAINED} AND u.split = 'train' AND contains(g.doc, u.unit))"""


def _eval_only(t):
    return t.datasets.where("role = 'eval_only'").select(F.col("key").alias("source"))


@query(f"WITH {_P} SELECT source, unit FROM p")
def probe_unit_keys(t):
    return L.probe_units(t.probe_items).distinct()


@query(f"WITH {_P} SELECT source, count(*) AS n FROM p GROUP BY source")
def probe_unit_counts(t):
    return L.probe_units(t.probe_items).distinct().groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {_U}, {_P} SELECT count(*) AS n FROM (SELECT unit FROM u WHERE split <> 'train' UNION SELECT unit FROM p)")
def eval_unit_set(t):
    return L.held_out_units(L.unit_rows(t.records)).union(L.probe_units(t.probe_items).select("unit")).distinct().agg(F.count("*").alias("n"))


@query(f"WITH {_U} SELECT DISTINCT ord FROM u WHERE split = 'train' AND unit IN (SELECT unit FROM u WHERE split <> 'train')")
def leak_overlap(t):
    rows = L.unit_rows(t.records)
    return L.overlapping(rows.where("split = 'train'"), L.held_out_units(rows))


@query(f"WITH {_P} SELECT DISTINCT doc_id FROM (SELECT doc_id, {X.sql_norm_key('piece')} AS k FROM (SELECT doc_id, unnest(list_concat([text], string_split(text, chr(10)), string_split(text, '. '), string_split(text, '。'))) AS piece FROM documents WHERE text IS NOT NULL)) WHERE k IN (SELECT unit FROM p)")
def leak_probe_overlap(t):
    """Documents of which the whole, a line or a sentence is a unit of the probes."""
    d = t.documents.where("text IS NOT NULL")
    pieces = d.select(F.col("doc_id").alias("ord"), F.explode(F.concat(F.array("text"), F.split("text", "\n"), F.split("text", r"\. "), F.split("text", "。"))).alias("p"))
    rows = pieces.select("ord", X.norm_key(F.col("p"), once=True).alias("unit"))
    return L.overlapping(rows, L.probe_units(t.probe_items)).select(F.col("ord").alias("doc_id"))


@query(f"WITH {_U}, {_T}, {_GRAM}, {_IN} SELECT ord FROM inside")
def leak_containment(t):
    texts = t.records.join(F.broadcast(_eval_only(t)), "source", "left_semi").where("context IS NOT NULL").select(X.norm_key(F.col("context"), once=True).alias("doc"))
    return L.contained(L.unit_rows(t.records.where("split = 'train'")), texts)


def _reasons(units: str = _U, side: str = "true", external: str = "SELECT NULL WHERE false", more: str = "SELECT NULL, NULL WHERE false") -> str:
    return f"""WITH {units}, {_P}, x AS MATERIALIZED (SELECT DISTINCT text FROM ({external}) e(text) WHERE text IS NOT NULL),
t AS MATERIALIZED (SELECT DISTINCT {X.sql_norm_key('context')} AS doc FROM records WHERE source IN ({_ONLY}) AND context IS NOT NULL UNION SELECT {X.sql_norm_key('text')} FROM x), {_GRAM}, {_F}, {_IN},
e AS MATERIALIZED (SELECT unit FROM u WHERE split <> 'train' AND {side} UNION SELECT unit FROM p UNION SELECT k FROM (SELECT {X.sql_norm_key('piece')} AS k FROM (SELECT unnest(list_concat([text], string_split(text, chr(10)))) AS piece FROM x)) WHERE length(k) >= {X.MIN_UNIT}),
o AS (SELECT DISTINCT ord FROM u WHERE split = 'train' AND unit IN (SELECT unit FROM e)), q AS (SELECT DISTINCT ord FROM u WHERE split <> 'train' AND unit IN (SELECT unit FROM p)),
reasons AS (SELECT r.ord, r.source, r.split, r.type, r.id, CASE WHEN r.ord NOT IN (SELECT ord FROM f) THEN 'duplicate' WHEN r.ord IN (SELECT ord FROM o) THEN 'overlap'
WHEN r.ord IN (SELECT ord FROM inside) THEN 'inside' WHEN r.ord IN (SELECT ord FROM q) THEN 'probe' ELSE 'kept' END AS reason FROM records r)"""


_REASON = _reasons()


@query(f"{_REASON} SELECT split, type, reason, count(*) AS n FROM reasons GROUP BY ALL")
def corpus_build(t):
    """The flagship: copies out, then leakage, then counts with the reason of every drop."""
    return L.decontaminate(t.records, t.probe_items, _eval_only(t)).groupBy("split", "type", "reason").agg(F.count("*").alias("n"))


_CHOSEN = "SELECT key FROM datasets WHERE enabled AND lang = 'zh'"


@query(f"""{_reasons(side=f"source IN ({_CHOSEN})")} SELECT split, type, reason, count(*) AS n FROM reasons GROUP BY ALL""")
def corpus_build_selected(t):
    """The same against the evaluation records of selected sources only."""
    chosen = t.datasets.where("enabled AND lang = 'zh'").select(F.col("key").alias("source"))
    return L.decontaminate(t.records, t.probe_items, _eval_only(t), selected=chosen).groupBy("split", "type", "reason").agg(F.count("*").alias("n"))


@query(f"""{_reasons(external="SELECT text FROM documents WHERE domain = 'exams'")} SELECT split, type, reason, count(*) AS n FROM reasons GROUP BY ALL""")
def corpus_build_external(t):
    """The same with evaluation texts from outside the corpus."""
    outside = t.documents.where("domain = 'exams'").select("text")
    return L.decontaminate(t.records, t.probe_items, _eval_only(t), external=outside).groupBy("split", "type", "reason").agg(F.count("*").alias("n"))


# Units a converter would hand over beside the record: here its question and its options.
_MORE = f"""u AS MATERIALIZED (SELECT DISTINCT ord, source, split, unit FROM (SELECT ord, source, split, unnest({X.sql_units('nfc_normalize(context)', 'type', 'nfc_normalize(question)', 'list_transform(view.text, lambda v: nfc_normalize(v))')}) AS unit FROM records
UNION ALL SELECT ord, source, split, {X.sql_norm_key('part')} FROM (SELECT ord, source, split, unnest(list_append(options, question)) AS part FROM records)) WHERE length(unit) >= {X.MIN_UNIT})"""


@query(f"WITH {_MORE} SELECT ord, count(*) AS n FROM u GROUP BY ord")
def all_units(t):
    more = t.records.select("ord", F.concat(F.coalesce("options", F.array().cast("array<string>")), F.array("question")).alias("units"))
    return L.unit_rows(t.records, more).distinct().groupBy("ord").agg(F.count("*").alias("n"))


@query("SELECT unit FROM (SELECT DISTINCT " + X.sql_norm_key("piece") + " AS unit FROM (SELECT unnest(list_concat([text], string_split(text, chr(10)))) AS piece FROM documents WHERE domain = 'exams')) WHERE length(unit) >= " + str(X.MIN_UNIT))
def external_eval_units(t):
    return L.external_units(t.documents.where("domain = 'exams'").select("text"))


@query(f"""{_REASON} SELECT source, count(*) AS n, count(*) FILTER (reason = 'duplicate') AS duplicates, count(*) FILTER (reason IN ('overlap', 'inside')) AS contaminated,
count(*) FILTER (reason = 'inside') AS inside_only, count(*) FILTER (reason = 'probe') AS probe_drops FROM reasons GROUP BY source""")
def drop_counters(t):
    r = F.col("reason")
    d = L.decontaminate(t.records, t.probe_items, _eval_only(t))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(r == "duplicate").alias("duplicates"), F.count_if(r.isin("overlap", "inside")).alias("contaminated"), F.count_if(r == "inside").alias("inside_only"), F.count_if(r == "probe").alias("probe_drops"))


@query(f"WITH {_U}, {_P} SELECT source, split, count(DISTINCT ord) AS n_records, count(DISTINCT ord) FILTER (unit IN (SELECT unit FROM u WHERE split <> 'train')) AS in_held_out, count(DISTINCT ord) FILTER (unit IN (SELECT unit FROM p)) AS in_probes FROM u GROUP BY source, split")
def unit_hits(t):
    """Per source and split the records that have units, and those that share one with the held-out records or the probes."""
    rows = L.unit_rows(t.records)
    marks = [rows.select("ord").distinct().withColumn("mark", F.lit("any")), L.overlapping(rows, L.held_out_units(rows)).withColumn("mark", F.lit("held")), L.overlapping(rows, L.probe_units(t.probe_items)).withColumn("mark", F.lit("probe"))]
    every = marks[0].unionByName(marks[1]).unionByName(marks[2])
    n = lambda m: F.count_if(F.col("mark") == m)
    return every.join(t.records.select("ord", "source", "split"), "ord").groupBy("source", "split").agg(n("any").alias("n_records"), n("held").alias("in_held_out"), n("probe").alias("in_probes"))


@query(f"{_REASON} SELECT source, reason, ord, id FROM reasons WHERE reason <> 'kept' QUALIFY row_number() OVER (PARTITION BY source, reason ORDER BY ord) <= 3")
def drop_examples(t):
    from pyspark.sql import Window as W

    d = L.decontaminate(t.records, t.probe_items, _eval_only(t)).where("reason <> 'kept'")
    return d.withColumn("rn", F.row_number().over(W.partitionBy("source", "reason").orderBy("ord"))).where("rn <= 3").select("source", "reason", "ord", "id")


@query("""SELECT DISTINCT i.q_native.question.instructions AS instructions FROM probe_items i
WHERE EXISTS (SELECT 1 FROM records r WHERE r.split = 'train' AND r.question = i.q_native.question.instructions)""")
def collide_instructions(t):
    from sievemill.operators.rendering import same_texts

    found = t.probe_items.select(F.col("q_native.question.instructions").alias("instructions"))
    return same_texts(found, t.records.where("split = 'train'").select("question"))


@query(f"""SELECT DISTINCT o FROM (SELECT DISTINCT unnest(options) AS o FROM records WHERE split = 'train') WHERE {X.sql_norm_key('o')} IN
(SELECT {X.sql_norm_key('c.key')} FROM (SELECT unnest(q_native.question.criteria) AS c FROM probe_items))""")
def collide_options(t):
    keys = t.probe_items.select(F.explode("q_native.question.criteria.key").alias("key")).select(X.norm_key(F.col("key")).alias("k")).distinct()
    return t.records.where("split = 'train'").select(F.explode("options").alias("o")).distinct().withColumn("k", X.norm_key(F.col("o"))).join(keys, "k", "left_semi").select("o")


# Joins and set operations.


@query("""SELECT DISTINCT r.message_id, 'User: ' || p.text || chr(10) || chr(10) || 'Assistant: ' || r.text AS context FROM messages r JOIN messages p ON p.message_id = r.parent_id
WHERE r.role = 'assistant' AND r.text IS NOT NULL AND p.text IS NOT NULL""")
def join_parent(t):
    p = t.messages.where("text IS NOT NULL").select(F.col("message_id").alias("parent_id"), F.col("text").alias("user"))
    r = t.messages.where("role = 'assistant' AND text IS NOT NULL").select("message_id", "parent_id", "text")
    return r.join(p, "parent_id").select("message_id", X.turns(F.col("user"), F.col("text")).alias("context")).distinct()


@query("""WITH RECURSIVE m AS (SELECT DISTINCT message_id, parent_id FROM messages), w AS (SELECT message_id, message_id AS root, 0 AS depth FROM m WHERE parent_id IS NULL
UNION ALL SELECT m.message_id, w.root, w.depth + 1 FROM m JOIN w ON m.parent_id = w.message_id) SELECT message_id, root, depth FROM w""")
def tree_root(t):
    from sievemill.operators.trees import roots

    return roots(t.messages)


@query("""WITH m AS (SELECT DISTINCT message_id, role, lang, created_at FROM messages)
SELECT message_id, last_value(CASE WHEN role = 'prompter' THEN message_id END IGNORE NULLS) OVER (PARTITION BY lang ORDER BY created_at, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m""")
def previous_prompt(t):
    from sievemill.operators.trees import carry_forward

    m = t.messages.select("message_id", "role", "lang", "created_at").distinct()
    return carry_forward(m, ["lang"], ["created_at", "message_id"], F.when(F.col("role") == "prompter", F.col("message_id")), "before", F.date_trunc("hour", "created_at")).select("message_id", "before")


@query("""SELECT a.item_id, b.item_id AS other, a.qtype FROM (SELECT item_id, lang, qtype, row_number() OVER (PARTITION BY lang, qtype ORDER BY item_id) AS i FROM probe_items) a
JOIN (SELECT item_id, lang, qtype, row_number() OVER (PARTITION BY lang, qtype ORDER BY item_id) AS i FROM probe_items) b USING (qtype, i) WHERE a.lang = 'zh' AND b.lang = 'en'""")
def join_positional(t):
    from sievemill.operators.probes import zipped

    p = t.probe_items.select("item_id", "lang", "qtype")
    return zipped(p.where("lang = 'zh'"), p.where("lang = 'en'").withColumnRenamed("item_id", "other"), ["qtype"], "item_id", "other").select("item_id", "other", "qtype")


@query("""SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS held, coalesce(b.n, 0) AS scored FROM (SELECT source, count(DISTINCT id) AS n FROM records WHERE split = 'test' GROUP BY 1) a
FULL JOIN (SELECT split_part(id, '/', 1) AS source, count(DISTINCT id) AS n FROM predictions WHERE id LIKE '%/test/%' GROUP BY 1) b ON a.source = b.source""")
def join_counts(t):
    a = t.records.where("split = 'test'").groupBy("source").agg(F.countDistinct("id").alias("held"))
    b = t.predictions.where("id LIKE '%/test/%'").groupBy(F.split_part("id", F.lit("/"), F.lit(1)).alias("source")).agg(F.countDistinct("id").alias("scored"))
    return a.join(b, "source", "full").select("source", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("scored", F.lit(0)).alias("scored"))


@query("SELECT p.id, p.scored_at, r.source, r.type FROM predictions p JOIN (SELECT DISTINCT id, source, type FROM records) r USING (id)")
def join_predictions(t):
    return t.predictions.select("id", "scored_at").join(t.records.select("id", "source", "type").distinct(), "id")


@query("SELECT d.key, l.class, l.share_alike FROM datasets d LEFT JOIN licenses l ON l.key = d.license")
def join_licences(t):
    return t.datasets.select("key", "license").join(F.broadcast(t.licenses.withColumnRenamed("key", "license")), "license", "left").select("key", "class", "share_alike")


# The wording's instructions and languages, those with an argument or without.
_PAIRS = f"SELECT unnest({[k for k in W.asked]}) AS task"


@query(f"SELECT task, v.lang, count(r.ord) AS n FROM ({_PAIRS}) CROSS JOIN (VALUES ('zh'), ('en')) v(lang) LEFT JOIN records r ON r.view.task = task AND r.lang = v.lang GROUP BY ALL")
def join_templates(t):
    """Every task in every language, by a cross join of two lists written by hand, with the records that could be asked so."""
    spark = t.spark
    tasks = spark.createDataFrame([(k,) for k in W.asked], "task string")
    langs = F.explode(F.array(F.lit("zh"), F.lit("en"))).alias("lang")
    r = t.records.select(F.col("view.task").alias("task"), "lang", "ord")
    return tasks.select("task", langs).join(r, ["task", "lang"], "left").groupBy("task", "lang").agg(F.count("ord").alias("n"))


@query("""SELECT source, 'missing' AS state FROM (SELECT key AS source FROM datasets EXCEPT SELECT source FROM records) UNION ALL
SELECT source, 'extra' FROM (SELECT source FROM records EXCEPT SELECT key FROM datasets)""")
def set_difference(t):
    a, b = t.datasets.select(F.col("key").alias("source")), t.records.select("source")
    return a.subtract(b).withColumn("state", F.lit("missing")).unionByName(b.subtract(a).withColumn("state", F.lit("extra")))


@query("SELECT text FROM (SELECT context AS text FROM records WHERE context IS NOT NULL UNION SELECT text FROM documents WHERE text IS NOT NULL)")
def set_union(t):
    return t.records.where("context IS NOT NULL").select(F.col("context").alias("text")).unionByName(t.documents.where("text IS NOT NULL").select("text")).distinct()


@query("SELECT ord FROM records WHERE list_has_any(options, ['law', '法律'])")
def set_overlap(t):
    return t.records.where(F.arrays_overlap("options", F.array(F.lit("law"), F.lit("法律")))).select("ord")


@query("SELECT ord, source, split FROM records WHERE split = 'train' UNION ALL SELECT ord, source, split FROM records WHERE split = 'dev'")
def corpus_concat(t):
    c = ["ord", "source", "split"]
    return t.records.where("split = 'train'").select(c).unionByName(t.records.where("split = 'dev'").select(c))
