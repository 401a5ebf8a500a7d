"""De-duplication, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import hashing as H
from sievemill.operators import leakage as L
from sievemill.operators import sampling as S
from sievemill.plans.registry import query

@query("""SELECT ord FROM records QUALIFY row_number() OVER (PARTITION BY source, split, question, coalesce(context, ''), options ORDER BY ord) = 1""")
def dedup_exact(t):
    return L.dedup_hashed(t.records).select("ord")


@query("SELECT id, count(*) AS n FROM records GROUP BY id HAVING count(*) > 1")
def dedup_ids(t):
    return L.duplicate_ids(t.records)


@query(f"SELECT ord, round({H.sql_uniform(chr(39) + '13' + chr(39), 'id')}, 12) AS u FROM records")
def hash_uniform(t):
    return t.records.select("ord", F.round(H.uniform("13", F.col("id")), 12).alias("u"))


SPLIT_U = H.sql_uniform("'split'", "doc_id::VARCHAR")


@query(f"SELECT doc_id, CASE WHEN {SPLIT_U} < 0.02 THEN 'test' WHEN {SPLIT_U} < 0.04 THEN 'dev' ELSE 'train' END AS split FROM documents")
def hash_split(t):
    return t.documents.select("doc_id", H.hash_split(F.col("doc_id")).alias("split"))


@query(f"""SELECT split, count(*) AS n FROM (SELECT CASE WHEN u < 0.004 THEN 'test' WHEN u < 0.0065 THEN 'dev' WHEN u < 0.0365 THEN 'train' END AS split
FROM (SELECT {H.sql_uniform("'bucket'", "event_id::VARCHAR")} AS u FROM events)) WHERE split IS NOT NULL GROUP BY split""")
def hash_bucket_sample(t):
    u = H.uniform("bucket", F.col("event_id"))
    s = F.when(u < 0.004, "test").when(u < 0.0065, "dev").when(u < 0.0365, "train").alias("split")
    return t.events.select(s).where("split IS NOT NULL").groupBy("split").agg(F.count("*").alias("n"))


@query(f"SELECT ord, id FROM records ORDER BY {H.sql_digest(chr(39) + '13' + chr(39), 'ord::VARCHAR')} LIMIT 500")
def sample_total(t):
    return S.sample(t.records.select("ord", "id"), 500, F.col("ord"), "13")


@query(f"SELECT ord FROM (SELECT ord FROM records ORDER BY {H.sql_digest(chr(39) + '13' + chr(39), chr(39) + 'total' + chr(39), 'ord::VARCHAR')} LIMIT 2000)")
def cap_total(t):
    return S.sample(t.records.select("ord"), 2000, F.col("ord"), "13", "total")


@query(f"""SELECT ord, source FROM records QUALIFY row_number() OVER (PARTITION BY source ORDER BY {H.sql_digest("'13'", "'cap'", "ord::VARCHAR")}, ord) <= 100""")
def cap_per_source(t):
    return S.sample_per(t.records.select("ord", "source"), 100, ["source"], F.col("ord"), "13", "cap")


@query(f"""SELECT ord, source, label FROM (SELECT *, count(*) OVER (PARTITION BY source, label) AS n FROM records WHERE type = 'choice' AND label IS NOT NULL) WHERE n >= 5
QUALIFY row_number() OVER (PARTITION BY source, label ORDER BY {H.sql_digest("'13'", "'bal'", "ord::VARCHAR")}, ord) <= 5""")
def sample_balanced(t):
    r = t.records.where("type = 'choice' AND label IS NOT NULL").select("ord", "source", "label")
    return S.balanced(r, 5, ["source", "label"], F.col("ord"), "13", "bal")


@query(f"""SELECT event_id, bin FROM (SELECT event_id, floor(value / 20)::BIGINT AS bin FROM events WHERE value IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY bin ORDER BY {H.sql_digest("'strata'", "event_id::VARCHAR")}, event_id) <= 40""")
def sample_stratified(t):
    e = t.events.where("value IS NOT NULL").select("event_id", F.floor(F.col("value") / 20).alias("bin"))
    return S.sample_per(e, 40, ["bin"], F.col("event_id"), "strata")


GROUPS = "(SELECT coalesce('g:' || grp, 'o:' || ord) AS key, count(*) AS size FROM records WHERE split = 'train' GROUP BY 1)"


@query(f"""SELECT ord, held FROM (SELECT ord, coalesce('g:' || grp, 'o:' || ord) AS key FROM records WHERE split = 'train') JOIN (
SELECT key, coalesce(sum(size) OVER (ORDER BY u, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < n AS held
FROM (SELECT key, size, {H.sql_uniform("'13'", "'calib'", 'key')} AS u FROM {GROUPS}),
(SELECT least(4000, greatest(50, round_even(0.02 * count(*), 0)), count(*) // 2) AS n FROM records WHERE split = 'train')) USING (key)""")
def calibration_hold_out(t):
    return S.calibration(t.records.where("split = 'train'")).select("ord", "held")


TAG = "lambda o: sha256(concat_ws(':', {0}, o)) || o"


def _sql_shuffled(options: str, *parts: str) -> str:
    return f"list_transform(list_sort(list_transform({options}, {TAG.format(', '.join(parts))})), lambda x: substr(x, 65))"


@query(f"""SELECT ord, o AS options, list_position(o, gold) - 1 AS label FROM (SELECT ord, options[label + 1] AS gold, {_sql_shuffled('options', "'13'", "'shuffle'", 'id')} AS o
FROM records WHERE type = 'choice' AND label IS NOT NULL)""")
def shuffle_options(t):
    r = t.records.where("type = 'choice' AND label IS NOT NULL")
    o = S.shuffled(F.col("options"), "13", "shuffle", F.col("id"))
    return r.select("ord", o.alias("options"), F.get("options", F.col("label")).alias("g")).select("ord", "options", (F.array_position("options", F.col("g")) - 1).cast("int").alias("label"))


_K = H.sql_uniform("'k'", "'13'", "id")
_OTHERS = _sql_shuffled("list_filter(list_distinct(options), lambda o: o <> gold)", "'pick'", "'13'", "id")
_BOTH = _sql_shuffled("list_append(others[1:k - 1], gold)", "'order'", "'13'", "id")


@query(f"""SELECT ord, {_BOTH} AS options FROM (SELECT ord, id, gold, {_OTHERS} AS others, least(len(options), 4 + floor({_K} * 9)::INT) AS k
FROM (SELECT ord, id, options, options[label + 1] AS gold FROM records WHERE type = 'choice' AND label IS NOT NULL AND len(list_distinct(options)) = len(options)))""")
def choice_subset(t):
    r = t.records.where("type = 'choice' AND label IS NOT NULL AND size(array_distinct(options)) = size(options)")
    return r.select("ord", S.choice_subset(F.col("options"), F.get("options", F.col("label")), 4, 12, "13", F.col("id")).alias("options"))


_PAPERS = """(SELECT id, source, context, list_transform((context::JSON->'keywords')::JSON[], lambda k: k->>'$') AS own
FROM records WHERE context LIKE '{%' AND json_valid(context) AND json_exists(context, '$.keywords') QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)"""


@query(f"""WITH _r AS MATERIALIZED (SELECT id, source AS grp, own, context AS txt FROM {_PAPERS}), {S.sql_negatives("_r", "(SELECT grp, unnest(own) AS entry FROM _r)", "'neg'")} SELECT id, negative FROM negative""")
def negative_keyword(t):
    own = F.from_json(F.get_json_object("context", "$.keywords"), "array<string>")
    p = t.records.where("context LIKE '{%'").withColumn("own", own).where("own IS NOT NULL").select("id", "source", "context", "own").dropDuplicates(["id"])
    pool = p.select("source", F.explode("own").alias("entry")).distinct()
    return S.negatives(p, pool, "source", "own", "context", "neg")


@query("""SELECT ord, ('0x' || right(sha256(id), 1))::INT % 2 AS fold FROM records""")
def crossfit_fold(t):
    return t.records.select("ord", H.fold(F.col("id")))


_TEMPLATES = ["Which label fits best?", "Choose the right label.", "What is this about?"]


@query(f"""SELECT ord, {_TEMPLATES}[1 + floor({H.sql_uniform("'13'", "'template'", 'id')} * 3)::INT] AS question FROM records WHERE type = 'choice'""")
def template_choice(t):
    q = H.pick(F.array(*map(F.lit, _TEMPLATES)), H.uniform("13", "template", F.col("id")))
    return t.records.where("type = 'choice'").select("ord", q.alias("question"))
