"""Profiles, checks and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.operators import governance as V
from sievemill.operators import profile as P
from sievemill.operators.validate import count_differences
from sievemill.plans.registry import SQL, query


@query("SELECT lang, split, type, count(*) AS n FROM records GROUP BY GROUPING SETS ((lang, split, type), (lang, split), (split))")
def counts_by_sets(t):
    r = t.records.select("lang", "split", "type")
    c = [F.col(x) for x in r.columns]
    return r.groupingSets([c, c[:2], c[1:2]], *c).agg(F.count("*").alias("n")).select("lang", "split", "type", "n")


@query("SELECT source, split, count(*) AS n FROM records GROUP BY ALL")
def counts_by_source(t):
    return t.records.groupBy("source", "split").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (type = 'choice') AS choice, count(*) FILTER (type = 'score') AS score, count(*) FILTER (type = 'noul') AS noul FROM records GROUP BY source")
def type_counts(t):
    return t.records.groupBy("source").agg(*(F.count_if(F.col("type") == k).alias(k) for k in ("choice", "score", "noul")))


@query("SELECT source, split, round(avg(label), 10) AS true_rate FROM records WHERE type = 'noul' AND label IS NOT NULL GROUP BY ALL")
def noul_true_rate(t):
    return t.records.where("type = 'noul' AND label IS NOT NULL").groupBy("source", "split").agg(F.round(F.avg("label"), 10).alias("true_rate"))


@query("SELECT source, options[label + 1] AS level, count(*) AS n FROM records WHERE type = 'score' AND split = 'train' AND label IS NOT NULL GROUP BY ALL")
def level_distribution(t):
    r = t.records.where("type = 'score' AND split = 'train' AND label IS NOT NULL")
    return r.groupBy("source", F.get("options", F.col("label")).alias("level")).agg(F.count("*").alias("n"))


@query("SELECT source, round(max(n) / sum(n), 10) AS share FROM (SELECT source, label, count(*) AS n FROM records WHERE type = 'choice' AND split = 'train' AND label IS NOT NULL GROUP BY ALL) GROUP BY source")
def max_index_share(t):
    return P.mode_share(t.records.where("type = 'choice' AND split = 'train' AND label IS NOT NULL"), ["source"], "label").select("source", F.round("share", 10).alias("share"))


_RANKED = "(SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT lang, length(question) + coalesce(length(context), 0) AS v FROM records WHERE question IS NOT NULL))"


@query(f"SELECT lang, q, v AS value FROM {_RANKED}, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) s(q) WHERE i = least(n - 1, floor(q * n))")
def length_percentiles(t):
    r = t.records.where("question IS NOT NULL").select("lang", (F.length("question") + F.coalesce(F.length("context"), F.lit(0))).alias("v"))
    return P.nearest_rank(r, "v", [0.5, 0.9, 0.99], "lang")


@query("""SELECT source, count(*) AS n, count(*) FILTER (options IS NOT NULL) AS with_options, max(len(options)) AS max_options, min(len(options)) AS min_options, coalesce(sum(len(options)), 0) AS n_options,
coalesce(sum(len(list_filter(options, lambda o: length(o) > 12))), 0) AS options_cut, count(*) FILTER (len(list_distinct(list_transform(options, lambda o: left(o, 12)))) < len(options)) AS records_colliding FROM records GROUP BY source""")
def option_fit(t):
    o = F.col("options")
    cut = F.transform(o, lambda x: F.substring(x, 1, 12))
    n = F.when(o.isNotNull(), F.size(o))
    return t.records.groupBy("source").agg(F.count("*").alias("n"), F.count(o).alias("with_options"), F.max(n).alias("max_options"), F.min(n).alias("min_options"), F.coalesce(F.sum(n), F.lit(0)).alias("n_options"), F.coalesce(F.sum(F.when(o.isNotNull(), F.size(F.filter(o, lambda x: F.length(x) > 12)))), F.lit(0)).alias("options_cut"), F.count_if(F.size(F.array_distinct(cut)) < n).alias("records_colliding"))


_OK = "coalesce(lang IN ('zh', 'en') AND type IN ('choice', 'score', 'noul') AND split IN ('train', 'dev', 'test') AND trim(question) <> '' AND CASE type WHEN 'noul' THEN label IN (0, 1) AND options IS NULL ELSE label >= 0 AND label < len(options) AND len(options) >= 2 AND len(list_distinct(options)) = len(options) END, false)"
_VIEW = "(view IS NULL OR coalesce(view.kind <> '' AND view.task <> '' AND len(view.text) > 0 AND len(list_filter(view.text, lambda x: x IS NULL OR trim(x) = '')) = 0, false))"


@query(f"""SELECT 'schema' AS "check", count(*) FILTER (NOT {_OK}) AS n_bad FROM records UNION ALL SELECT 'view', count(*) FILTER (NOT {_VIEW}) FROM records
UNION ALL SELECT 'group_outside_train', count(*) FILTER (grp IS NOT NULL AND split <> 'train') FROM records UNION ALL SELECT 'options_twice', count(*) FILTER (len(list_distinct(options)) < len(options)) FROM records
UNION ALL SELECT 'id_prefix', count(*) FILTER (NOT starts_with(id, source || '/' || split)) FROM records UNION ALL SELECT 'unique_ids', count(*) FROM (SELECT id FROM records GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'licensed_sources', count(DISTINCT source) FROM records WHERE source NOT IN (SELECT d.key FROM datasets d JOIN licenses l ON l.key = d.license WHERE d.enabled AND l.class IN ('ALLOW', 'CONDITIONAL'))""")
def validation(t):
    return P.checks(t.records, t.datasets, t.licenses, ["ALLOW", "CONDITIONAL"])


# Counts pinned before the last day's deliveries came.
_BEFORE = "loaded_at < TIMESTAMP '2026-01-03'"


@query(f"""WITH now AS (SELECT source, split, count(*) AS n FROM records WHERE split <> 'train' GROUP BY ALL), ref AS (SELECT source, split, count(*) AS n FROM records WHERE split <> 'train' AND {_BEFORE} GROUP BY ALL)
SELECT source, split, coalesce(r.n, 0) AS expected, coalesce(n.n, 0) AS found FROM ref r FULL JOIN now n USING (source, split) WHERE coalesce(r.n, 0) <> coalesce(n.n, 0)""")
def reference_counts(t):
    held = t.records.where("split <> 'train'")
    n = lambda df: df.groupBy("source", "split").agg(F.count("*").alias("n"))
    return count_differences(n(held.where(_BEFORE)), n(held))


def _licence_sql(classes: str, drop: str) -> str:
    return f"""SELECT d.key, l.class IS NOT NULL AND l.class IN ({classes}) AND NOT ({drop}) AS keep, CASE WHEN l.class IS NULL THEN d.key || ': no licence entry' WHEN l.class NOT IN ({classes}) THEN d.key || ': licence class ' || l.class || ' is not allowed' END AS problem
FROM datasets d LEFT JOIN licenses l ON l.key = d.license"""


_STRICT = _licence_sql("'ALLOW'", "coalesce(l.share_alike, false) AND d.role IS DISTINCT FROM 'eval_only'")


@query(_licence_sql("'ALLOW', 'CONDITIONAL'", "false"))
def licence_default(t):
    return V.licence_check(t.datasets, t.licenses)


@query(_STRICT)
def licence_strict(t):
    return V.licence_check(t.datasets, t.licenses, "strict")


@query(f"SELECT key, converter FROM datasets WHERE enabled AND converter IS NOT NULL AND key IN (SELECT key FROM ({_STRICT}) WHERE keep)")
def select_sources(t):
    return V.selected(t.datasets, t.licenses, "strict")


@query(f"SELECT key, converter FROM datasets WHERE enabled AND converter IS NOT NULL AND role IS DISTINCT FROM 'eval_only' AND key IN (SELECT key FROM ({_STRICT}) WHERE keep)")
def trainable_sources(t):
    return V.trainable(t.datasets, t.licenses, "strict")


@query("SELECT DISTINCT source FROM records WHERE split = 'train' AND source IN (SELECT d.key FROM datasets d JOIN licenses l ON l.key = d.license WHERE l.share_alike)")
def share_alike(t):
    return V.share_alike_sources(t.records, t.datasets, t.licenses)


@query("SELECT r.source, any_value(d.license) AS license, coalesce(any_value(l.duties), 'none') AS duties, count(*) AS n_train FROM records r JOIN datasets d ON d.key = r.source LEFT JOIN licenses l ON l.key = d.license WHERE r.split = 'train' GROUP BY r.source")
def attribution(t):
    return V.attribution(t.records, t.datasets, t.licenses)


_FIELDS = ", ".join(f"coalesce({c}, chr(9216))" for c in ("id", "lang", "type", "question", "array_to_string(list_transform(options, lambda o: coalesce(o, chr(9216))), chr(30))", "context", "label::VARCHAR"))
_WORDS = ", ".join(f"(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) % 4294967296)::VARCHAR" for i in range(4))
_MANIFEST = f"SELECT source, split, count(*) AS n, sha256(concat_ws(',', {_WORDS})) AS sha256 FROM (SELECT source, split, sha256(concat_ws(chr(31), {_FIELDS})) AS h FROM records) GROUP BY source, split"


@query(_MANIFEST)
def manifest(t):
    return V.manifest(t.records)


@query(f"SELECT sha256(string_agg(line, '' ORDER BY line)) AS corpus_sha256 FROM (SELECT sha256 || '  ' || split || '/' || source || chr(10) AS line FROM ({_MANIFEST}))")
def corpus_hash(t):
    return V.corpus_hash(V.manifest(t.records))


@query(f"""SELECT source, CASE WHEN d.key IS NULL THEN source || ': not listed' ELSE coalesce(problem, source || ': left out by the profile') END AS problem FROM (SELECT DISTINCT source FROM records WHERE split = 'train') LEFT JOIN ({_STRICT}) d ON d.key = source WHERE NOT coalesce(keep, false)
UNION ALL SELECT NULL, 'trial run' FROM (SELECT count(*) AS n FROM records WHERE split = 'train') WHERE n < 1000000000""")
def publish_gate(t):
    """Asked for more training records than there are, so that both kinds of problem show."""
    return V.publish_problems(t.records, t.datasets, t.licenses, "strict", 1_000_000_000)


@query("""SELECT name, CASE WHEN f.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'extra' ELSE 'is ' || coalesce(f.kind, 'null') || ', not ' || coalesce(e.kind, 'null') END AS problem FROM (SELECT key AS name, lang AS kind FROM datasets) e
FULL JOIN (SELECT source AS name, mode(lang) AS kind FROM (SELECT source, lang FROM records WHERE lang IN ('zh', 'en')) GROUP BY source) f USING (name) WHERE e.name IS NULL OR f.name IS NULL OR e.kind IS DISTINCT FROM f.kind""")
def structural_check(t):
    """The sources with their language against the list of data sets."""
    found = t.records.where("lang IN ('zh', 'en')").groupBy(F.col("source").alias("name")).agg(F.mode("lang").alias("kind"))
    return V.structure(t.datasets.select(F.col("key").alias("name"), F.col("lang").alias("kind")), found)


@query("SELECT sha256(string_agg(line, '' ORDER BY line)) AS sha256 FROM (SELECT sha256(source || split) || '  ' || split || '/' || source || chr(10) AS line FROM (SELECT DISTINCT source, split FROM records))")
def listing_hash(t):
    parts = t.records.select("source", "split").distinct().withColumn("sha256", F.sha2(F.concat("source", "split"), 256))
    return V.corpus_hash(parts).withColumnRenamed("corpus_sha256", "sha256")


@query("SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, max(length(text)) AS max_chars, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty, count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS stale FROM documents GROUP BY source")
def document_profile(t):
    n = F.length("text")
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_chars"), F.max(n).alias("max_chars"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), F.count_if(~F.col("n_chars").eqNullSafe(n)).alias("stale"))


_PARTS = "SELECT source FROM records WHERE split = 'dev' GROUP BY source"
_ASKED = "SELECT q_native.question.instructions AS i FROM probe_items UNION SELECT q_en.question.instructions FROM probe_items"


def _whole_sql() -> str:
    from sievemill.functions import text as X
    from sievemill.plans import leak_queries as K

    base = SQL["validation"]
    masked = lambda c: f"regexp_replace({c}, '`[^`]*`', '`*`', 'g')"
    return f"""WITH {K._U}, {K._P}, {K._T}, {K._GRAM}, {K._IN} SELECT * FROM ({base}) UNION ALL SELECT 'checksums', count(*) FROM ({_PARTS})
UNION ALL SELECT 'train_in_held_out', count(DISTINCT ord) FROM u WHERE split = 'train' AND unit IN (SELECT unit FROM u WHERE split <> 'train') UNION ALL SELECT 'train_inside_eval_only', count(*) FROM inside
UNION ALL SELECT 'held_out_in_probes', count(DISTINCT ord) FROM u WHERE split <> 'train' AND unit IN (SELECT unit FROM p) UNION ALL SELECT 'train_in_probes', count(DISTINCT ord) FROM u WHERE split = 'train' AND unit IN (SELECT unit FROM p)
UNION ALL SELECT 'instructions_of_probes', count(*) FROM ({_ASKED}) WHERE {masked('i')} IN (SELECT {masked('question')} FROM records WHERE split = 'train' AND question IS NOT NULL)
UNION ALL SELECT 'options_of_probes', count(*) FROM (SELECT DISTINCT unnest(options) AS o FROM records WHERE split = 'train') WHERE {X.sql_norm_key('o')} IN (SELECT {X.sql_norm_key('c.key')} FROM (SELECT unnest(q_native.question.criteria) AS c FROM probe_items))
UNION ALL SELECT 'held_out_ids', count(*) FROM (SELECT id FROM (SELECT DISTINCT id, question, context, options, label FROM records WHERE split <> 'train') GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'pinned_counts', count(*) FROM ({_PARTS})"""


@query(_whole_sql)
def validation_whole(t):
    """The whole battery, against a manifest that was sealed without the dev split."""
    from sievemill.operators.validate import checks

    return checks(t.records, t.probe_items, t.datasets, t.licenses, ["ALLOW", "CONDITIONAL"], V.manifest(t.records.where("split <> 'dev'")))
