"""Renderings and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions.hashing import sql_uniform, uniform
from sievemill.operators import rendering as R
from sievemill.plans.registry import query
from sievemill.plans.wording import ROWS


def _first(t):
    """Each record once: the first delivery by ord."""
    first = t.records.groupBy("id").agg(F.min("ord").alias("ord"))
    return t.records.join(first.select("ord"), "ord", "left_semi")


def _u(*purpose: str) -> str:
    return sql_uniform("'13'", *(f"'{p}'" for p in purpose), "id")


def _list(x) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, list) else f"'{v}'" for v in x) + "]"


W = R.Wording.of(ROWS)
_NAMES = "CASE " + " ".join(f"WHEN kind = '{k}' AND to_lang = '{lg}' THEN {_list(v)}" for (k, lg), v in W.fields.items()) + " END"
_SAID = "CASE " + " ".join(f"WHEN task = '{k}' AND to_lang = '{lg}' THEN {_list(v)}" for (k, lg), v in W.tasks.items()) + " END"
_TO = "CASE " + " ".join(f"WHEN o = '{x}' AND to_lang = '{lg}' THEN '{y}'" for x, lg, y in W.moves) + " END"


def _pick(options: str, *purpose: str) -> str:
    return f"({options})[1 + floor({_u(*purpose)} * len({options}))::INT]"


def _rendered(rows: str, share: float, cross: float) -> str:
    return f"""r0 AS MATERIALIZED (SELECT *, view.kind AS kind, view.task AS task FROM {rows} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1),
r1 AS (SELECT *, coalesce(kind IN ({", ".join(f"'{k}'" for k in W.kinds)}) AND task IN ({", ".join(f"'{k}'" for k in W.asked)}) AND lang IN ('zh', 'en') AND len(view.text) > 0 AND {_u('aug')} < {share}, false) AS rendered FROM r0),
r2 AS (SELECT *, CASE WHEN rendered THEN CASE WHEN {_u('cross')} < {cross} THEN CASE lang WHEN 'zh' THEN 'en' ELSE 'zh' END ELSE lang END END AS to_lang FROM r1),
r3 AS (SELECT *, CASE WHEN rendered THEN {_pick(_NAMES, 'fields')}[1:len(view.text)] END AS fields FROM r2),
r4 AS (SELECT *, CASE WHEN rendered THEN view.text[1:len(fields)] END AS texts, CASE WHEN rendered THEN replace(replace(replace({_pick(_SAID, 'template')}, '{{0}}', '`' || fields[1] || '`'), '{{last}}', '`' || fields[-1] || '`'), '{{arg}}', coalesce(view.arg, '')) END AS instruction,
list_transform(options, lambda o: {_TO}) AS moved FROM r3),
r AS MATERIALIZED (SELECT *, CASE WHEN rendered THEN CASE WHEN len(list_filter(moved, lambda x: x IS NULL)) = 0 AND len(list_distinct(moved)) = len(moved) THEN moved ELSE options END END AS written_options FROM r4)"""


@query(f"WITH {_rendered('records', 0.5, 0.3)} SELECT id, rendered, to_lang, fields, texts, instruction, written_options FROM r")
def render_views(t):
    return R.render(_first(t), W).select("id", "rendered", "to_lang", "fields", "texts", "instruction", "written_options")


_ON = f"(rendered AND {_u('variant')} < 0.25 AND label IS NOT NULL)"


@query(f"""WITH {_rendered('records', 0.5, 0.3)} SELECT id, shape, CASE WHEN shape = 'keyed' THEN list_transform(options, lambda o, i: chr(64 + i::INT)) END AS shape_keys,
CASE shape WHEN 'yes_no' THEN CASE WHEN flip THEN list_reverse(a) ELSE a END WHEN 'named' THEN a WHEN 'merged' THEN CASE to_lang WHEN 'en' THEN {_list(W.levels['en'])} ELSE {_list(W.levels['zh'])} END ELSE coalesce(written_options, options) END AS shape_options,
CASE WHEN shape = 'yes_no' AND flip THEN 1 - label WHEN shape = 'merged' THEN CASE WHEN 2 * label < len(options) - 1 THEN 0 WHEN 2 * label = len(options) - 1 THEN 1 ELSE 2 END ELSE label END AS shape_label
FROM (SELECT *, {_u('order')} < 0.5 AS flip, CASE to_lang WHEN 'en' THEN {_list(W.answers['en'])} ELSE {_list(W.answers['zh'])} END AS a,
CASE WHEN {_ON} AND type = 'noul' THEN CASE WHEN {_u('named')} < 0.5 THEN 'named' ELSE 'yes_no' END WHEN {_ON} AND type = 'score' AND len(options) > 3 AND len(options) % 2 = 1 THEN 'merged' WHEN {_ON} AND type = 'choice' AND len(options) <= 26 THEN 'keyed' ELSE 'plain' END AS shape FROM r)""")
def render_variants(t):
    return R.variants(R.render(_first(t), W), W).select("id", "shape", "shape_keys", "shape_options", "shape_label")


@query(f"""SELECT ord, CASE WHEN x THEN o ELSE options END AS options, CASE WHEN x THEN list_position(o, options[label + 1]) - 1 ELSE label END AS label FROM
(SELECT ord, options, label, coalesce(type = 'choice' AND label IS NOT NULL AND {_u('shuffle?')} < 0.5, false) AS x, list_transform(list_sort(list_transform(options, lambda o: sha256(concat_ws(':', '13', 'shuffle', id, o)) || o)), lambda x: substr(x, 65)) AS o FROM records)""")
def render_shuffled(t):
    return R.shuffle(t.records).select("ord", "options", "label")


_CALIB = f"{sql_uniform(chr(39) + '13' + chr(39), chr(39) + 'calib' + chr(39), 'id')} < 0.02"


@query(f"SELECT id, epoch, {sql_uniform(chr(39) + '13' + chr(39), chr(39) + 'ep' + chr(39) + ' || epoch', 'id')} < 0.5 AS rendered FROM (SELECT DISTINCT id FROM records WHERE split = 'train'), range(3) e(epoch) WHERE NOT {_CALIB}")
def render_epochs(t):
    ids = t.records.where("split = 'train'").select("id").distinct()
    return R.epochs(ids, 3, without=ids.where(uniform("13", "calib", F.col("id")) < 0.02))


@query(f"""WITH {_rendered("(SELECT * FROM records WHERE split = 'test')", 1.0, 0.0)} SELECT id || '#fixed' AS id, source, type, label AS gold,
left(sha256(concat_ws(chr(10), instruction, array_to_string(fields, chr(9)), array_to_string(texts, chr(9)), coalesce(array_to_string(written_options, chr(9)), ''))), 12) AS render FROM r WHERE rendered""")
def render_fixed(t):
    return R.fixed(_first(t), W)


# Tasks that a configuration asks for, with the number of records whose view has them.
_TASKS_ON = "SELECT unnest(['choice', 'noul']) AS task"


@query(f"SELECT task, count(r.ord) AS n FROM ({_TASKS_ON}) LEFT JOIN records r ON r.view.task = task GROUP BY task")
def render_tasks(t):
    from sievemill.config import tasks_for

    on = t.spark.createDataFrame([(k,) for k in tasks_for(W.asked, {"aug.scores": ["score"]}, {"aug": {"scores": False}})], "task string")
    return on.join(t.records.select(F.col("view.task").alias("task"), "ord"), "task", "left").groupBy("task").agg(F.count("ord").alias("n"))


@query("SELECT id, label IS NULL AS unlabelled FROM (SELECT id, label FROM records QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)")
def render_keeps_ids(t):
    """What is left of the records after all rewriting: each id once, with a label where it had one."""
    return R.shuffle(R.variants(R.render(_first(t), W), W)).select("id", F.coalesce("shape_label", "label").isNull().alias("unlabelled"))


# The instructions of the probes, half of them written into records as questions, and some templates.
_ASKED = "SELECT unnest([q_native.question.instructions, q_en.question.instructions]) AS instructions FROM probe_items"


@query(rf"SELECT DISTINCT instructions FROM ({_ASKED}) WHERE regexp_full_match(regexp_replace(instructions, '`[^`]*`', '`*`', 'g'), 'Does .+|Which .+ `\*`.*|.+吗？')")
def collide_templates(t):
    found = t.probe_items.select(F.explode(F.array("q_native.question.instructions", "q_en.question.instructions")).alias("instructions"))
    return R.collisions(found, ["Does .+", r"Which .+ `\*`.*", ".+吗？", *R.patterns(W)])
