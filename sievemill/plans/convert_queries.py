"""Converters over the tables at hand, each standing in for the sources of its shape, and the probe builder."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sievemill.functions import text as X
from sievemill.functions.hashing import hash_split, sql_digest, sql_number, sql_ordered, sql_uniform
from sievemill.operators.sampling import sql_negatives
from sievemill.plans.registry import query
from sievemill.sources.convert import Spec, convert

_SPLIT = f"CASE WHEN {sql_uniform(chr(39) + 'split' + chr(39), 'row')} < 0.02 THEN 'test' WHEN {sql_uniform(chr(39) + 'split' + chr(39), 'row')} < 0.04 THEN 'dev' ELSE 'train' END"
# Domains of documents and attributes of ratings that occur in the tables.
DOMAINS = ("assistant", "banking", "encyclopedia", "exams", "health", "language", "law", "news", "retail", "science", "social", "travel", "web")
ATTRIBUTES = ("quality", "helpfulness", "creativity", "humor")
LEVELS = ("lowest", "second", "third", "fourth", "highest")
LABELLED = Spec("documents_domain", "en", "labelled", {"text": "text", "label": "domain"}, DOMAINS, full=0.5, subset=0.25)
INTENTS = Spec("documents_intent", "en", "intents", {"text": "text", "label": "domain", "second": "lang"}, DOMAINS, ("en", "zh"), full=0.6, subset=0.2)
TOPICAL = Spec("documents_topic", "en", "topical", {"text": "text", "topic": "domain", "label": "long"}, ("health", "law", "travel"), full=0.5, yes_no="Is the text long?")
PASSAGE = Spec("documents_passage", "en", "passage", {"text": "text", "question": "ask", "label": "long"})
BINNED = Spec("documents_length", "en", "binned", {"text": "text", "number": "n_chars"}, ("tiny", "short", "middling", "long", "huge"), edges=(100, 400, 1000, 3000), full=0.7, question="How long is the text?", yes_no="Is the text long?")
BALANCED = replace(BINNED, source="documents_balanced", per_bin={"train": 40, "test": 3})
RATED = Spec("messages_rated", "en", "rated", {"prompt": "prompt", "reply": "reply", "ratings": "ratings", "group": "parent_id"}, LEVELS, ATTRIBUTES, first=0.7, extras=True, cuts=(1200, 2400), question="Rate the reply by {}.")
SCALED = Spec("messages_scaled", "en", "rated", {"prompt": "prompt", "reply": "reply"}, ("0", "1", "2", "3", "4"), ("quality", "humor"), scale=(0.0, 4.0), first=0.5, question="Rate the reply by {}.")
CHOICE = Spec("probe_choice", "zh", "multiple_choice", {"question": "question", "passage": "passage", "options": "options", "label": "answer"})
NUMBERED = Spec("probe_number", "zh", "multiple_choice", {"question": "question", "passage": "passage", "label": "answer"}, choices=("choice1", "choice2"), base=0)
PAIR = Spec("messages_pair", "en", "pair", {"a": "prompt", "b": "reply", "label": "label"}, questions=("Same meaning?", "Do they agree?"))
NLI = Spec("messages_nli", "en", "nli", {"a": "prompt", "b": "reply", "label": "label"}, ("follows", "open", "against"), full=0.7, subset=0.15)
DIALOGUE = Spec("messages_turns", "en", "dialogue", {"text": "reply", "before": "prompt", "domains": "domains", "slots": "slots"}, ATTRIBUTES, ATTRIBUTES, full=0.5, subset=0.25)
PAPER = Spec("messages_paper", "en", "paper", {"title": "prompt", "text": "reply", "label": "kind", "second": "second", "keywords": "keywords"}, ("long", "short"), ATTRIBUTES, full=0.5, subset=0.25)
EMOTIONS = Spec("messages_emotions", "en", "emotions", {"text": "reply", "labels": "keywords"}, ATTRIBUTES, full=0.6)
VALENCE = Spec("messages_valence", "en", "valence", {"text": "reply", "labels": "keywords"}, ("humor",), ("quality",), questions=("bad", "neither", "good"), question="Which side?")


def _with_split(rows, row):
    return rows.withColumn("row", row.cast("string")).withColumn("split", hash_split(F.col("row")))


def _u(spec: Spec, *purpose: str) -> str:
    return sql_uniform("'13'", f"'{spec.source}'", *(f"'{p}'" for p in purpose), "split", "row")


def _n(spec: Spec) -> str:
    return sql_number("'13'", f"'{spec.source}'", "split", "row")


def _id(spec: Spec) -> str:
    return f"'{spec.source}/' || split || '/' || row AS id"


def _order(names: tuple[str, ...], salt: str) -> str:
    return sql_ordered(names, "num", salt)


def _some(names: tuple[str, ...], gold: str, least: int, most: int, u: str) -> str:
    picked = f"list_filter({_order(names, 'pick')}, lambda x: x <> {gold})"
    return f"list_filter({_order(names, 'order')}, lambda x: x = {gold} OR list_contains({picked}[1:least({len(names)}, {least} + floor({u} * {most - least + 1})::INT) - 1], x))"


def _other(names: tuple[str, ...], gold: str) -> str:
    return f"list_filter({_order(names, 'negative')}, lambda x: x <> {gold})[1]"


def _docs(columns: str) -> str:
    return f"(SELECT *, {_SPLIT} AS split FROM (SELECT doc_id::VARCHAR AS row, {X.sql_clean('text')} AS context, {columns} FROM documents) WHERE context <> '')"


def _documents(t, *columns):
    return _with_split(t.documents.select("doc_id", "text", *columns), F.col("doc_id"))


_NAMES = str(list(DOMAINS))


@query(f"""SELECT id, type, CASE WHEN type = 'choice' THEN 'Which label fits the text best?' ELSE 'Does this label fit the text: ' || asked || '?' END AS question, options, context,
CASE WHEN type = 'choice' THEN list_position(options, gold) - 1 ELSE yes::INT END AS label, split FROM (SELECT {_id(LABELLED)}, *, CASE WHEN form IS NULL THEN 'noul' ELSE 'choice' END AS type, CASE WHEN yes THEN gold ELSE {_other(DOMAINS, 'gold')} END AS asked,
CASE form WHEN 1 THEN {_order(DOMAINS, 'order')} WHEN 2 THEN {_some(DOMAINS, 'gold', 4, 12, 'uk')} END AS options
FROM (SELECT *, CASE WHEN split = 'test' OR u < 0.5 THEN 1 WHEN u < 0.75 THEN 2 END AS form FROM (SELECT *, {_u(LABELLED, 'form')} AS u, {_u(LABELLED, 'positive')} < 0.5 AS yes, {_u(LABELLED, 'k')} AS uk, {_n(LABELLED)} AS num FROM {_docs('domain AS gold')} WHERE gold IN {tuple(DOMAINS)})))""")
def convert_labelled(t):
    return convert(LABELLED, _documents(t, "domain")).select("id", "type", "question", "options", "context", "label", "split")


@query(f"""SELECT id, CASE WHEN form IS NULL THEN 'noul' ELSE 'choice' END AS type, options, CASE WHEN form IS NULL THEN yes::INT ELSE list_position(options, CASE form WHEN 3 THEN scene ELSE gold END) - 1 END AS label
FROM (SELECT {_id(INTENTS)}, *, CASE form WHEN 1 THEN {_order(DOMAINS, 'order')} WHEN 2 THEN {_some(DOMAINS, 'gold', 4, 12, 'uk')} WHEN 3 THEN {_order(('en', 'zh'), 'scenario')} END AS options
FROM (SELECT *, CASE WHEN split = 'test' OR u < 0.3 THEN 1 WHEN u < 0.6 THEN 2 WHEN u < 0.8 THEN 3 END AS form FROM (SELECT *, {_u(INTENTS, 'form')} AS u, {_u(INTENTS, 'positive')} < 0.5 AS yes, {_u(INTENTS, 'k')} AS uk, {_n(INTENTS)} AS num
FROM {_docs("domain AS gold, CASE WHEN lang IN ('en', 'zh') THEN lang END AS scene")} WHERE gold IN {tuple(DOMAINS)}))) WHERE NOT (form IS NOT DISTINCT FROM 3 AND scene IS NULL)""")
def convert_intents(t):
    return convert(INTENTS, _documents(t, "domain", "lang")).select("id", "type", "options", "label")


@query(f"""SELECT id, type, CASE type WHEN 'noul' THEN long ELSE list_position(options, gold) - 1 END AS label, options FROM (SELECT {_id(TOPICAL)}, *, CASE type WHEN 'choice' THEN {_order(TOPICAL.names, 'order')} END AS options
FROM (SELECT *, {_n(TOPICAL)} AS num, CASE WHEN gold IS NULL OR {_u(TOPICAL, 'form')} < 0.5 THEN 'noul' ELSE 'choice' END AS type FROM {_docs(f"CASE WHEN domain IN {TOPICAL.names} THEN domain END AS gold, (n_chars > 500)::INT AS long")})) WHERE type = 'choice' OR long IS NOT NULL""")
def convert_topical(t):
    return convert(TOPICAL, _documents(t, "domain", (F.col("n_chars") > 500).cast("int").alias("long"))).select("id", "type", "label", "options")


@query(f"SELECT {_id(PASSAGE)}, 'Is it about ' || domain || '?' AS question, long AS label FROM {_docs('domain, (n_chars > 500)::INT AS long')} WHERE domain IS NOT NULL AND long IS NOT NULL")
def convert_passage(t):
    return convert(PASSAGE, _documents(t, F.concat(F.lit("is it about "), "domain").alias("ask"), (F.col("n_chars") > 500).alias("long"))).select("id", "question", "label")


_BIN = "CASE WHEN n < 100 THEN 0 WHEN n < 400 THEN 1 WHEN n < 1000 THEN 2 WHEN n < 3000 THEN 3 ELSE 4 END"


@query(f"SELECT {_id(BINNED)}, CASE WHEN f THEN 'score' ELSE 'noul' END AS type, CASE WHEN f THEN {_BIN} ELSE (n >= 1000)::INT END AS label FROM (SELECT *, split = 'test' OR {_u(BINNED, 'form')} < 0.7 AS f FROM {_docs('n_chars AS n')} WHERE n IS NOT NULL)")
def convert_binned(t):
    return convert(BINNED, _documents(t, "n_chars")).select("id", "type", "label")


@query(f"""SELECT {_id(BALANCED)}, bin FROM (SELECT *, row_number() OVER (PARTITION BY split, bin ORDER BY {sql_digest("'13'", "'documents_balanced'", "'bin'", "row")}, row) AS rn FROM
(SELECT *, {_BIN} AS bin, {_SPLIT} AS split FROM (SELECT doc_id::VARCHAR AS row, {X.sql_clean('text')} AS context, n_chars AS n FROM documents WHERE n_chars IS NOT NULL))) WHERE context <> '' AND rn <= CASE split WHEN 'train' THEN 40 WHEN 'test' THEN 3 ELSE 1000000000 END""")
def convert_balanced(t):
    """As many texts of each bin: those drawn whose text is blank give no record."""
    rows = _documents(t, "n_chars")
    n = F.col("n_chars")
    bins = F.when(n < 100, 0).when(n < 400, 1).when(n < 1000, 2).when(n < 3000, 3).otherwise(4)
    keyed = rows.select(F.concat_ws("/", F.lit(BALANCED.source), "split", "row").alias("id"), bins.alias("bin"))
    return convert(BALANCED, rows).select("id").join(keyed, "id").select("id", "bin")


_CHAT = f"(SELECT *, {_SPLIT} AS split FROM (SELECT DISTINCT r.message_id AS row, r.parent_id, {X.sql_clean_keep_lines('p.text')} AS kept_a, {X.sql_clean_keep_lines('r.text')} AS kept_b, {X.sql_clean('p.text')} AS a, {X.sql_clean('r.text')} AS b, p.text AS prompt, r.text AS reply, r.labels AS l, r.labels.name AS keywords FROM messages r JOIN (SELECT DISTINCT message_id, text FROM messages) p ON p.message_id = r.parent_id WHERE r.role = 'assistant') WHERE b <> '' AND a <> '')"
# Where only the reply must say something.
_REPLIES = _CHAT.replace(" AND a <> ''", "")


def _chat(t, *columns):
    p = t.messages.select(F.col("message_id").alias("parent_id"), F.col("text").alias("prompt")).distinct()
    r = t.messages.where("role = 'assistant'").select("message_id", "parent_id", F.col("text").alias("reply"), "labels", F.col("labels.name").alias("keywords")).distinct()
    return _with_split(r.join(p, "parent_id").select("*", *columns), F.col("message_id"))


_TURNS = "'User: ' || CASE WHEN length(kept_a) > 1200 THEN left(kept_a, 1199) || '…' ELSE kept_a END || chr(10) || chr(10) || 'Assistant: ' || CASE WHEN length(kept_b) > 2400 THEN left(kept_b, 2399) || '…' ELSE kept_b END"
_EACH = "list_sort(list_filter(list_transform(l.name, lambda x, i: {'name': x, 'value': l.value[i], 'count': l.count[i]}), lambda x: x.value IS NOT NULL AND coalesce(x.count, 0) >= 2))"


@query(f"""WITH r AS MATERIALIZED (SELECT *, {_EACH} AS each FROM {_CHAT} WHERE l IS NOT NULL),
x AS MATERIALIZED (SELECT *, list_filter(list_transform(each, lambda z: z.name), lambda z: z <> 'quality') AS rest, unnest(each) AS one FROM r WHERE len(each) > 0),
m AS MATERIALIZED (SELECT *, CASE WHEN list_contains(list_transform(each, lambda z: z.name), 'quality') AND {_u(RATED, 'attribute')} < 0.7 THEN 'quality' WHEN len(rest) > 0 THEN rest[1 + floor({_u(RATED, 'which')} * len(rest))::INT] ELSE 'quality' END AS lead, least(4, floor(one.value * 5)::INT) AS label FROM x),
skewed AS (SELECT one.name AS n FROM m WHERE one.name <> lead AND split = 'train' GROUP BY 1 HAVING avg((label >= 4)::INT) > 0.6)
SELECT {_id(RATED)} || CASE WHEN one.name = lead THEN '' ELSE '/' || one.name END AS id, {_TURNS} AS context, 'Rate the reply by ' || one.name || '.' AS question, label, CASE WHEN split = 'train' THEN parent_id END AS grp FROM m WHERE one.name = lead OR split = 'train' AND one.name NOT IN (SELECT n FROM skewed)""".replace(" AS id ||", " ||", 1))
def convert_rated(t):
    """Every rating of at least two raters: one attribute a reply, and the others too in training, held together by the parent."""
    ratings = F.zip_with(F.arrays_zip("labels.name", "labels.value"), "labels.count", lambda x, n: F.struct(x["name"].alias("name"), x["value"].alias("value"), n.alias("count")))
    return convert(RATED, _chat(t, ratings.alias("ratings"))).select("id", "context", "question", "label", "grp")


@query(f"""SELECT {_id(SCALED)}, lead AS attribute, least(4, floor(CASE lead WHEN 'quality' THEN q ELSE h END / 4.0 * 5)::INT) AS label FROM (SELECT *, CASE WHEN q IS NOT NULL AND {_u(SCALED, 'attribute')} < 0.5 THEN 'quality' WHEN h IS NOT NULL THEN 'humor' ELSE 'quality' END AS lead
FROM (SELECT *, length(reply) % 5 AS q, CASE WHEN length(prompt) % 7 < 5 THEN length(prompt) % 7 END AS h FROM {_CHAT}))""")
def convert_scaled(t):
    """Ratings from 0 to 4 in a column each."""
    n = F.length("prompt") % 7
    rows = _chat(t, (F.length("reply") % 5).alias("quality"), F.when(n < 5, n).alias("humor"))
    return convert(SCALED, rows).select("id", F.col("view.arg").alias("attribute"), "label")


@query(f"""SELECT {_id(PAIR)}, ['Same meaning?', 'Do they agree?'][1 + floor({_u(PAIR, 'question')} * 2)::INT] AS question, 'Sentence A: ' || a || chr(10) || 'Sentence B: ' || b AS context, (length(reply) > length(prompt))::INT AS label FROM {_CHAT}""")
def convert_pair(t):
    return convert(PAIR, _chat(t, (F.length("reply") > F.length("prompt")).cast("int").alias("label"))).select("id", "question", "context", "label")


@query(f"""SELECT {_id(NLI)}, CASE WHEN score THEN 'score' WHEN split = 'test' OR u < 0.7 THEN 'choice' ELSE 'noul' END AS type, CASE WHEN score THEN 2 - y WHEN split = 'test' OR u < 0.7 THEN y ELSE (y = 0)::INT END AS label FROM
(SELECT *, split <> 'test' AND u >= 0.7 - 0.15 AND u < 0.7 AS score FROM (SELECT *, {_u(NLI, 'form')} AS u, length(reply) % 4 AS y FROM {_CHAT})) WHERE y < 3""")
def convert_nli(t):
    return convert(NLI, _chat(t, (F.length("reply") % 4).alias("label"))).select("id", "type", "label")


_HIGH = "list_transform(list_filter(list_transform(l.name, lambda x, i: {'n': x, 'v': l.value[i], 'c': l.count[i]}), lambda x: x.{0}), lambda x: x.n)"


@query(f"""SELECT id, CASE WHEN form IS NULL THEN 'noul' ELSE 'choice' END AS type, context, options, CASE form WHEN 1 THEN list_position(options, domains[1]) - 1 WHEN 2 THEN list_position(options, slots[1]) - 1 ELSE (len(slots) > 0)::INT END AS label FROM (SELECT {_id(DIALOGUE)}, *, CASE WHEN a = '' THEN b ELSE 'System: ' || a || chr(10) || 'User: ' || b END AS context,
CASE form WHEN 1 THEN {_order(ATTRIBUTES, 'order')} WHEN 2 THEN {_some(ATTRIBUTES, 'slots[1]', 3, 6, 'uk')} END AS options FROM (SELECT *, CASE WHEN len(domains) = 1 AND u < 0.5 THEN 1 WHEN len(slots) = 1 AND u < 0.75 THEN 2 END AS form FROM
(SELECT *, {_HIGH.replace('{0}', 'v >= 0.6')} AS domains, {_HIGH.replace('{0}', 'c >= 4')} AS slots, {_u(DIALOGUE, 'form')} AS u, {_u(DIALOGUE, 'k')} AS uk, {_n(DIALOGUE)} AS num FROM {_REPLIES} WHERE l IS NOT NULL)))""")
def convert_dialogue(t):
    high = lambda test: F.transform(F.filter(F.arrays_zip("labels.name", "labels.value", "labels.count"), test), lambda x: x["name"])
    rows = _chat(t, high(lambda x: x["value"] >= 0.6).alias("domains"), high(lambda x: x["count"] >= 4).alias("slots"))
    return convert(DIALOGUE, rows).select("id", "type", "context", "options", "label")


@query(f"""WITH r AS MATERIALIZED (SELECT *, CASE WHEN length(reply) > 80 THEN 'long' ELSE 'short' END AS kind, keywords[1] AS disc, {_u(PAPER, 'form')} AS u, {_u(PAPER, 'positive')} < 0.5 AS yes, {_u(PAPER, 'k')} AS uk, {_n(PAPER)} AS num FROM {_CHAT}),
_r AS (SELECT split || '/' || row AS id, kind AS grp, keywords AS own, a || chr(10) || b AS txt FROM r), {sql_negatives("_r", "(SELECT grp, unnest(own) AS entry FROM _r)", "'13', 'messages_paper'")},
f AS (SELECT *, CASE WHEN split = 'test' OR u < 0.5 THEN 1 WHEN u < 0.75 AND disc IS NOT NULL THEN 2 END AS form, CASE WHEN yes THEN keywords[1 + floor({_u(PAPER, 'keyword')} * len(keywords))::INT] ELSE negative END AS asked FROM r LEFT JOIN negative ON id = split || '/' || row)
SELECT id, type, asked, CASE type WHEN 'noul' THEN yes::INT ELSE list_position(options, CASE form WHEN 1 THEN kind ELSE disc END) - 1 END AS label FROM (SELECT {_id(PAPER)}, * EXCLUDE (id), CASE WHEN form IS NULL THEN 'noul' ELSE 'choice' END AS type,
CASE form WHEN 1 THEN {_order(PAPER.names, 'order')} WHEN 2 THEN {_some(ATTRIBUTES, 'disc', 4, 10, 'uk')} END AS options FROM (SELECT * REPLACE (CASE WHEN form IS NULL THEN asked END AS asked) FROM f)) WHERE type = 'choice' OR asked IS NOT NULL""")
def convert_paper(t):
    rows = _chat(t, F.when(F.length("reply") > 80, "long").otherwise("short").alias("kind"), F.get("keywords", F.lit(0)).alias("second"))
    return convert(PAPER, rows).select("id", "type", F.col("view.arg").alias("asked"), "label")


@query(f"""SELECT id, CASE WHEN f THEN 'choice' ELSE 'noul' END AS type, asked, CASE WHEN f THEN list_position({_order(ATTRIBUTES, 'order')}, keywords[1]) - 1 ELSE yes::INT END AS label FROM (SELECT {_id(EMOTIONS)}, *, CASE WHEN NOT f THEN any_ END AS asked FROM
(SELECT *, len(keywords) = 1 AND (split = 'test' OR {_u(EMOTIONS, 'form')} < 0.6) AS f, CASE WHEN yes THEN keywords[1 + floor({_u(EMOTIONS, 'which')} * len(keywords))::INT] ELSE list_filter({_order(ATTRIBUTES, 'negative')}, lambda x: NOT list_contains(keywords, x))[1] END AS any_
FROM (SELECT *, {_n(EMOTIONS)} AS num, {_u(EMOTIONS, 'positive')} < 0.5 AS yes FROM {_REPLIES} WHERE len(keywords) > 0)) WHERE any_ IS NOT NULL)""")
def convert_emotions(t):
    return convert(EMOTIONS, _chat(t)).select("id", "type", F.col("view.arg").alias("asked"), "label")


@query(f"""SELECT id, type, CASE type WHEN 'score' THEN y ELSE list_position({_order(VALENCE.questions, 'order')}, ['bad', 'neither', 'good'][y + 1]) - 1 END AS label FROM (SELECT {_id(VALENCE)}, *, {_n(VALENCE)} AS num, CASE WHEN {_u(VALENCE, 'form')} < 0.5 THEN 'choice' ELSE 'score' END AS type,
1 + list_contains(keywords, 'quality')::INT - list_contains(keywords, 'humor')::INT AS y FROM {_REPLIES} WHERE len(keywords) > 0 AND NOT (list_contains(keywords, 'quality') AND list_contains(keywords, 'humor')))""")
def convert_valence(t):
    return convert(VALENCE, _chat(t)).select("id", "type", "label")


@query(f"""SELECT 'probe_choice/test/' || item_id AS id, question, options, context, pos - 1 AS label FROM (SELECT item_id, {X.sql_clean('q_native.question.instructions')} AS question, {X.sql_clean('q_native.state')} AS context, list_transform(q_native.question.criteria, lambda c: c.key) AS options,
list_position(list_transform(q_native.question.criteria, lambda c: c.key), gold_native) AS pos FROM probe_items WHERE qtype = 'choice') WHERE question <> '' AND pos > 0 AND len(list_distinct(options)) = len(options)""")
def convert_multiple_choice(t):
    q = t.probe_items.where("qtype = 'choice'").select(F.col("item_id").alias("row"), F.lit("test").alias("split"), F.col("q_native.question.instructions").alias("question"), F.col("q_native.state").alias("passage"), F.col("q_native.question.criteria.key").alias("options"), F.col("gold_native").alias("answer"))
    return convert(CHOICE, q).select("id", "question", "options", "context", "label")


@query(f"""SELECT 'probe_number/test/' || item_id AS id, [k[1], k[2]] AS options, answer AS label FROM (SELECT item_id, {X.sql_clean('q_native.question.instructions')} AS question, list_transform(q_native.question.criteria, lambda c: c.key) AS k, (item_id % 3)::INT AS answer FROM probe_items) WHERE question <> '' AND len(k) > 1 AND k[1] <> k[2] AND answer < 2""")
def convert_numbered(t):
    """Two options in columns of their own and the answer as a number from zero; a number beyond them is no answer."""
    k = F.col("q_native.question.criteria.key")
    q = t.probe_items.select(F.col("item_id").alias("row"), F.lit("test").alias("split"), F.col("q_native.question.instructions").alias("question"), F.col("q_native.state").alias("passage"), F.get(k, F.lit(0)).alias("choice1"), F.get(k, F.lit(1)).alias("choice2"), (F.col("item_id") % 3).cast("int").alias("answer"))
    return convert(NUMBERED, q).select("id", "options", "label")


@query(f"""SELECT source, label, ord, 'probe' AS family, {{'state': context, 'type': type, 'instructions': question, 'criteria': options}} AS q FROM records WHERE type = 'score' AND split = 'test' AND context IS NOT NULL AND label IS NOT NULL AND (source, label) IN
(SELECT (source, label) FROM records WHERE type = 'score' AND split = 'test' AND context IS NOT NULL AND label IS NOT NULL GROUP BY source, label HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY source, label ORDER BY {sql_digest("'13'", "'probe'", "ord::VARCHAR")}, ord) <= 3""")
def build_probes(t):
    """Items of the score questions, as many of each level, which is what a family of ratings is made of."""
    from sievemill.operators.sampling import balanced

    r = t.records.where("type = 'score' AND split = 'test' AND context IS NOT NULL AND label IS NOT NULL")
    q = F.struct(F.col("context").alias("state"), F.col("type").alias("type"), F.col("question").alias("instructions"), F.col("options").alias("criteria"))
    return balanced(r, 3, ["source", "label"], F.col("ord"), "13", "probe").select("source", "label", "ord", F.lit("probe").alias("family"), q.alias("q"))
