"""Row construction and scalar functions: texts, labels, arrays, targets, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import arrays as A
from sievemill.functions import text as X
from sievemill.functions.hashing import sql_uniform, uniform
from sievemill.plans.registry import query

ONCE = "(SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)"


@query(f"SELECT doc_id, {X.sql_clean('text')} AS text FROM documents")
def text_clean(t):
    return t.documents.select("doc_id", X.clean(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {X.sql_clean_keep_lines('text')} AS text FROM documents")
def text_clean_lines(t):
    return t.documents.select("doc_id", X.clean_keep_lines(F.col("text")).alias("text"))


@query(f"SELECT ord, {X.sql_norm_key('context')} AS k FROM records")
def text_norm_key(t):
    return t.records.select("ord", X.norm_key(F.col("context")).alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN left(text, 239) || '…' ELSE text END AS text FROM documents")
def text_truncate(t):
    return t.documents.select("doc_id", X.truncate(F.col("text"), 240).alias("text"))


@query("""SELECT ord, CASE WHEN b = '' THEN b ELSE upper(left(b, 1)) || substr(b, 2) || '?' END AS question
FROM (SELECT ord, regexp_replace(trim(question), '[? ]+$', '') AS b FROM records)""")
def text_question_form(t):
    return t.records.select("ord", X.question_form(F.col("question")).alias("question"))


@query("SELECT key, replace(key, '_', ' ') AS name FROM datasets")
def text_prettify(t):
    return t.datasets.select("key", X.prettify(F.col("key")).alias("name"))


@query(f"SELECT ord, list_sort({X.sql_units('nfc_normalize(context)', 'type', 'nfc_normalize(question)', 'list_transform(view.text, lambda v: nfc_normalize(v))')}) AS units FROM records")
def text_record_units(t):
    from sievemill.operators.leakage import units_of

    return units_of(t.records)


LANGS = {"zh": "Chinese", "en": "English"}


@query("SELECT ord, CASE split_part(replace(lower(lang), 'eng', 'en'), '-', 1) WHEN 'zh' THEN 'Chinese' WHEN 'en' THEN 'English' END AS language FROM records")
def label_lookup(t):
    names = F.create_map(*(F.lit(x) for p in LANGS.items() for x in p))
    code = F.substring_index(F.replace(F.lower("lang"), F.lit("eng"), F.lit("en")), "-", 1)
    return t.records.select("ord", F.element_at(names, code).alias("language"))


# A label table in two languages; a label is looked up in either and given in the one asked for.
LEVELS = [("poor", "差"), ("weak", "较差"), ("fair", "中等"), ("good", "良好"), ("excellent", "优秀")]


@query(f"""SELECT ord, list_transform(options, lambda o: CASE {" ".join(f"WHEN o IN ('{e}', '{z}') THEN '{e}'" for e, z in LEVELS)} END) AS labels
FROM records WHERE type = 'score'""")
def label_translate(t):
    table = F.create_map(*(F.lit(x) for e, z in LEVELS for x in (e, e, z, e)))
    return t.records.where("type = 'score'").select("ord", F.transform("options", lambda o: F.element_at(table, o)).alias("labels"))


@query("""SELECT id, scored_at, CASE WHEN m < .1 THEN 0 WHEN m < .3 THEN 1 WHEN m < .5 THEN 2 WHEN m < .8 THEN 3 ELSE 4 END AS bin
FROM (SELECT id, scored_at, list_max(probs) AS m FROM predictions) WHERE m IS NOT NULL""")
def numeric_bins(t):
    m = F.array_max("probs")
    b = F.when(m < 0.1, 0).when(m < 0.3, 1).when(m < 0.5, 2).when(m < 0.8, 3).otherwise(4)
    return t.predictions.where(m.isNotNull()).select("id", "scored_at", b.alias("bin"))


RATED = """(SELECT message_id, received_at, unnest(labels.name) AS name, unnest(labels.value) AS value, unnest(labels.count) AS count FROM messages)"""


@query(f"SELECT message_id, received_at, name, value, count FROM {RATED}")
def arrays_to_pairs(t):
    z = F.explode(F.arrays_zip(*(F.col(f"labels.{c}").alias(c) for c in ("name", "value", "count")))).alias("z")
    return t.messages.select("message_id", "received_at", z).select("message_id", "received_at", "z.*")


@query(f"SELECT message_id, received_at, name, CASE WHEN count >= 2 THEN least(4, floor(value * 5)::INT) END AS level FROM {RATED}")
def rating_level(t):
    return arrays_to_pairs(t).select("message_id", "received_at", "name", A.level(F.col("value"), F.col("count")).alias("level"))


GOOD, BAD = ["quality", "helpfulness", "creativity", "humor"], ["toxicity", "violence", "spam", "fails_task"]


@query(f"""SELECT message_id, received_at, CASE WHEN n IS NULL OR len(n) = 0 THEN NULL WHEN g AND NOT b THEN 1 WHEN b AND NOT g THEN -1 WHEN NOT g AND NOT b THEN 0 END AS polarity
FROM (SELECT message_id, received_at, labels.name AS n, list_has_any(labels.name, {GOOD}) AS g, list_has_any(labels.name, {BAD}) AS b FROM messages)""")
def label_polarity(t):
    n = F.col("labels.name")
    g, b = (F.arrays_overlap(n, F.array(*map(F.lit, x))) for x in (GOOD, BAD))
    p = F.when(n.isNull() | (F.size(n) == 0), None).when(g & ~b, 1).when(b & ~g, -1).when(~g & ~b, 0)
    return t.messages.select("message_id", "received_at", p.alias("polarity"))


@query("""SELECT item_id, list_position(list_transform(q_native.question.criteria, lambda c: c.key), gold_native) - 1 AS gold
FROM probe_items WHERE qtype = 'choice'""")
def answer_index(t):
    at = F.array_position(F.col("q_native.question.criteria.key"), F.col("gold_native")) - 1
    return t.probe_items.where("qtype = 'choice'").select("item_id", F.when(at >= 0, at).alias("gold"))


@query("SELECT ord, len(list_distinct(options)) = len(options) AS distinct_options FROM records WHERE options IS NOT NULL")
def options_unique(t):
    return t.records.where("options IS NOT NULL").select("ord", A.unique(F.col("options")).alias("distinct_options"))


@query("SELECT source, list_sort(list(DISTINCT o)) AS labels FROM (SELECT source, unnest(options) AS o FROM records) GROUP BY source")
def labels_of_source(t):
    return t.records.select("source", F.explode("options").alias("o")).groupBy("source").agg(F.array_sort(F.collect_set("o")).alias("labels"))


@query("""SELECT ord, path, value FROM (SELECT r.ord, j.fullkey AS path, j.atom->>'$' AS value FROM records r, json_tree(r.context) j
WHERE r.context LIKE '{%}' AND json_valid(r.context) AND j.type = 'VARCHAR')""")
def nested_strings(t):
    from sievemill.operators.nested import strings

    return strings(t.records.where("context LIKE '{%}'").select("ord", "context"), "context")


@query("""SELECT ord, list_transform(range(len(options)), lambda i: round(0.05 / len(options) + CASE WHEN i = label THEN 0.95 ELSE 0 END, 9)) AS target
FROM records WHERE type = 'choice' AND label IS NOT NULL""")
def target_onehot(t):
    v = A.onehot(F.col("label"), F.size("options"))
    return t.records.where("type = 'choice' AND label IS NOT NULL").select("ord", F.transform(v, lambda x: F.round(x, 9)).alias("target"))


@query("""SELECT ord, list_transform(raw, lambda x: round(x / list_sum(raw), 9)) AS target FROM (
SELECT ord, list_transform(range(len(options)), lambda i: (CASE WHEN i = label THEN 0.8 WHEN abs(i - label) = 1 THEN 0.1 ELSE 0 END)::DOUBLE) AS raw
FROM records WHERE type = 'score' AND label IS NOT NULL)""")
def target_ordinal(t):
    v = A.ordinal(F.col("label"), F.size("options"))
    return t.records.where("type = 'score' AND label IS NOT NULL").select("ord", F.transform(v, lambda x: F.round(x, 9)).alias("target"))


@query("""SELECT ord, id, coalesce(context, '') AS state, type AS qtype, question AS instructions, options AS criteria, label AS gold,
CASE type WHEN 'noul' THEN 2 ELSE len(options) END AS k FROM records WHERE label IS NOT NULL""")
def typed_question(t):
    from sievemill.operators.records import typed

    return typed(t.records).select("ord", "id", "state", "qtype", "instructions", "criteria", "gold", "k")


@query("""SELECT item_id, CASE qtype WHEN 'choice' THEN list_position(list_transform(q_native.question.criteria, lambda c: c.key), gold_native) - 1
WHEN 'score' THEN TRY_CAST(gold_native AS INT) ELSE CASE WHEN lower(gold_native) IN ('1', 'true') THEN 1 WHEN lower(gold_native) IN ('0', 'false') THEN 0 END END AS gold,
CASE qtype WHEN 'noul' THEN 2 ELSE len(q_native.question.criteria) END AS k FROM probe_items""")
def probe_gold(t):
    from sievemill.operators.records import probe_decisions

    return probe_decisions(t.probe_items, "native").select("item_id", "gold", "k")


@query("""SELECT id, scored_at, list_transform(gold_soft, lambda x: round(x / list_sum(gold_soft), 9)) AS soft FROM predictions
WHERE gold_soft IS NOT NULL AND list_sum(gold_soft) > 0""")
def soft_gold(t):
    s = A.renormalised(F.col("gold_soft"))
    return t.predictions.where(F.col("gold_soft").isNotNull() & (A.total(F.col("gold_soft")) > 0)).select("id", "scored_at", F.transform(s, lambda x: F.round(x, 9)).alias("soft"))


@query("""SELECT source || '/' || split || '/' || ord AS id, lang, type, question, options, context, label, source, split FROM records
WHERE lang IN ('zh', 'en') AND type IN ('choice', 'score', 'noul') AND split IN ('train', 'dev', 'test') AND trim(question) <> '' AND
CASE type WHEN 'noul' THEN label IN (0, 1) AND options IS NULL ELSE label >= 0 AND label < len(options) AND len(options) >= 2 AND len(list_distinct(options)) = len(options) END""")
def record_construct(t):
    from sievemill.operators.records import construct

    return construct(t.records.withColumn("row", F.col("ord"))).select("id", "lang", "type", "question", "options", "context", "label", "source", "split")


@query("SELECT doc_id, source FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND length(text) BETWEEN 20 AND 1500")
def filter_length(t):
    return t.documents.where("text IS NOT NULL AND trim(text) <> '' AND length(text) BETWEEN 20 AND 1500").select("doc_id", "source")


@query("SELECT ord, label FROM records WHERE label IN (0, 1, 2) AND type = 'choice'")
def filter_labels(t):
    return t.records.where(F.col("label").isin(0, 1, 2) & (F.col("type") == "choice")).select("ord", "label")


@query("SELECT DISTINCT message_id FROM messages WHERE lang = 'en' AND NOT coalesce(deleted, false) AND coalesce(review_result, false) AND role = 'assistant'")
def filter_reviewed(t):
    return t.messages.where((F.col("lang") == "en") & ~F.coalesce("deleted", F.lit(False)) & F.col("review_result").eqNullSafe(True) & (F.col("role") == "assistant")).select("message_id").distinct()


@query(f"""SELECT doc_id FROM documents WHERE text IS NOT NULL AND {X.sql_norm_key('text')} NOT IN
(SELECT {X.sql_norm_key('context')} FROM records WHERE context IS NOT NULL AND split <> 'train')""")
def filter_unseen_texts(t):
    held = t.records.where("context IS NOT NULL AND split <> 'train'").select(X.norm_key(F.col("context")).alias("k")).distinct()
    docs = t.documents.where("text IS NOT NULL").select("doc_id", X.norm_key(F.col("text")).alias("k"))
    return docs.join(held, "k", "left_anti").select("doc_id")


@query("SELECT id, ord FROM records WHERE id NOT IN (SELECT id FROM predictions WHERE id IS NOT NULL)")
def filter_unscored(t):
    return t.records.select("id", "ord").join(t.predictions.select("id").distinct(), "id", "left_anti")


@query(f"""SELECT name FROM (SELECT name, level, count(*) AS n FROM (SELECT name, CASE WHEN count >= 2 THEN least(4, floor(value * 5)::INT) END AS level FROM {RATED})
WHERE level IS NOT NULL GROUP BY ALL) GROUP BY name HAVING max(n) / sum(n) <= 0.6""")
def filter_not_skewed(t):
    n = rating_level(t).where("level IS NOT NULL").groupBy("name", "level").count()
    return n.groupBy("name").agg((F.max("count") / F.sum("count")).alias("share")).where("share <= 0.6").select("name")


@query("SELECT ord, source FROM records WHERE source IN (SELECT key FROM datasets WHERE domain IN ('exams', 'science', 'law') AND enabled)")
def filter_classes(t):
    d = t.datasets.where(F.col("domain").isin("exams", "science", "law") & F.col("enabled")).select(F.col("key").alias("source"))
    return t.records.join(F.broadcast(d), "source", "left_semi").select("ord", "source")  # datasets: one row per source


@query(f"""SELECT ord, round(u, 12) AS u, CASE WHEN type = 'noul' THEN 'noul' WHEN u < 0.5 THEN 'full' WHEN u < 0.75 THEN 'subset' ELSE 'yes-no' END AS task
FROM (SELECT ord, type, {sql_uniform("'13'", "'task'", 'id')} AS u FROM records)""")
def random_branch(t):
    u = uniform("13", "task", F.col("id"))
    return t.records.select("ord", F.round(u, 12).alias("u"), F.when(F.col("type") == "noul", "noul").when(u < 0.5, "full").when(u < 0.75, "subset").otherwise("yes-no").alias("task"))
