"""Metrics, intervals, comparisons and temperatures over stored predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import arrays as A
from sievemill.functions.hashing import fold, uniform
from sievemill.operators import calibrate as C
from sievemill.operators import metrics as M
from sievemill.plans.registry import query
from sievemill.session import stored

Z = M.Z95
# The names of slices and how ids lead to them.
RULES = [
    M.SliceRule(r"^([a-z0-9_]+)/(?:train|dev|test)/[^#]*#fixed$", ("test:fixed:ALL", "test:fixed:lang:{lang}", "test:fixed:source:{1}", "test:fixed:qtype:{qtype}")),
    M.SliceRule(r"^([a-z0-9_]+)/(?:train|dev|test)/", ("test:ALL", "test:lang:{lang}", "test:source:{1}", "test:qtype:{qtype}", "test:lang:{lang}/qtype:{qtype}")),
    M.SliceRule(r"^probe-([a-z]+)-", ("probe:{1}", "probe:{1}/qtype:{qtype}")),
    M.SliceRule(r"", ("probe:other", "probe:other/qtype:{qtype}")),
]
ORDER = [("test:fixed:", 2), ("test:source:", 4), ("test:src:", 4), ("test:", 1), ("probe:", 3)]
_D = """d AS MATERIALIZED (SELECT * FROM predictions WHERE probs IS NOT NULL AND len(probs) > 0 AND len(list_filter(probs, lambda x: x IS NULL)) = 0 AND gold >= 0 AND gold < len(probs)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY scored_at NULLS LAST, probs) = 1)"""


def _scored(name: str, source: str) -> str:
    return f"""{name}0 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN list_sum(probs) > 0 THEN list_transform(probs, lambda x: x / list_sum(probs)) ELSE list_transform(probs, lambda x: 1.0::DOUBLE / len(probs)) END AS probs) FROM {source}),
{name} AS MATERIALIZED (SELECT *, probs AS p, len(probs) AS k, list_max(probs) AS conf, pred, (pred = gold)::INT AS correct,
list_sum(list_transform(probs, lambda x, i: (x - (i = gold + 1)::INT::DOUBLE) ** 2)) AS brier, -ln(greatest(probs[gold + 1], 1e-6)) AS nll, greatest(0, ceil(list_max(probs) * 15)::INT - 1) AS bin
FROM (SELECT *, CASE WHEN qtype = 'noul' THEN (probs[2] >= 0.5)::INT ELSE list_position(probs, list_max(probs)) - 1 END AS pred FROM {name}0))"""


_S = f"{_D}, {_scored('s', 'd')}"
# The other side of a comparison: the same items answered by chance, drawn from a digest of id and option.
_B = f"""b_raw AS MATERIALIZED (SELECT * REPLACE (list_transform(range(len(probs)), lambda i: ('0x' || substr(sha256(concat_ws(':', 'other', id, i::VARCHAR)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0) AS probs) FROM d), {_scored('o', 'b_raw')}"""
_SUM = """count(*) AS n, round(avg(correct), 10) AS acc, round(avg(brier), 10) AS brier, round(avg(nll), 10) AS nll, round(avg(conf), 10) AS mean_conf, round(avg(1 / k), 10) AS uni_acc, round(avg(1 - 1 / k), 10) AS uni_brier,
round(avg(CASE WHEN qtype = 'score' THEN abs(list_sum(list_transform(p, lambda x, i: x * (i - 1))) - coalesce(gold_score, gold)) END), 10) AS score_mae,
round(avg(CASE WHEN gold_soft IS NOT NULL AND qtype IN ('choice', 'noul') THEN list_sum(list_transform(list_zip(p, gold_soft), lambda z: (z[1] - z[2]) ** 2)) END), 10) AS soft_brier"""


def _summary_sql(by: str, rows: str) -> str:
    return f"""SELECT * FROM (SELECT {by}, {_SUM} FROM {rows} GROUP BY {by}) JOIN
(SELECT {by}, round(sum(gap) / sum(n), 10) AS ece15 FROM (SELECT {by}, bin, count(*) AS n, abs(sum(conf) - sum(correct)) AS gap FROM {rows} GROUP BY ALL) GROUP BY {by}) USING ({by})"""


def _round(df, places=10):
    return df.select(*(F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _rows(t):
    return M.scored(M.unique_ids(t.predictions))


def _other(t):
    u = F.transform(F.sequence(F.lit(0), F.size("probs") - 1), lambda i: uniform("other", F.col("id"), i))
    return M.scored(M.unique_ids(t.predictions).withColumn("probs", u))


@query(f"WITH {_S} SELECT id, pred, correct, k, round(conf, 6) AS conf, round(brier, 6) AS brier, round(nll, 6) AS nll FROM s")
def item_scores(t):
    return _round(_rows(t).select("id", "pred", "correct", "k", "conf", "brier", "nll"), 6)


@query(f"WITH {_S} {_summary_sql('qtype', 's')}")
def metrics_by_type(t):
    return _round(M.summary(_rows(t), "qtype"))


@query(f"WITH {_S}, e AS (SELECT s.* , unnest(list_distinct(slices)) AS slice FROM s) {_summary_sql('slice', 'e')}")
def metrics_by_slice(t):
    return _round(M.summary(M.by_slice(_rows(t), RULES), "slice"))


@query(f"""WITH {_S}, e AS (SELECT s.*, unnest(['ALL', 'type:' || qtype, 'source:' || split_part(id, '/', 1), 'k:' || k]) AS slice FROM s WHERE id LIKE '%/dev/%') {_summary_sql('slice', 'e')}""")
def dev_metrics(t):
    keys = F.array(F.lit("ALL"), F.concat(F.lit("type:"), "qtype"), F.concat(F.lit("source:"), F.split_part("id", F.lit("/"), F.lit(1))), F.concat(F.lit("k:"), F.col("k").cast("string")))
    return _round(M.summary(_rows(t).where("id LIKE '%/dev/%'").withColumn("slice", F.explode(keys)), "slice"))


@query(f"WITH {_S} SELECT bin, count(*) AS n, round(avg(conf), 10) AS conf, round(avg(correct), 10) AS acc FROM s GROUP BY bin")
def reliability_bins(t):
    r = _rows(t).withColumn("bin", M.ece_bin(F.col("conf")))
    return _round(r.groupBy("bin").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("correct").alias("acc")))


@query(f"""WITH {_S}, e AS (SELECT s.*, unnest(list_distinct(slices)) AS slice FROM s), c AS (SELECT slice, count(*) AS n, sum(correct) AS k, {Z} AS z FROM e GROUP BY slice),
m AS (SELECT *, (k / n + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half FROM c)
SELECT slice, n, round(greatest(0, mid - half), 10) AS lo, round(least(1, mid + half), 10) AS hi FROM m""")
def wilson_by_slice(t):
    g = M.by_slice(_rows(t), RULES).groupBy("slice").agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return _round(g.select("slice", "n", lo.alias("lo"), hi.alias("hi")))


@query("""SELECT DISTINCT id, CASE WHEN contains(id, '#') OR NOT contains(id, '/') OR regexp_matches(id, '^[a-z0-9_]+/(train|dev|test)/') THEN id ELSE regexp_replace(id, '/[^/]*$', '') END AS cluster FROM
(SELECT id FROM predictions UNION ALL SELECT id || '#native' FROM probe_items UNION ALL SELECT 'case-' || item_id || '/q1' FROM probe_items)""")
def cluster_keys(t):
    i = t.probe_items
    ids = t.predictions.select("id").union(i.select(F.concat("id", F.lit("#native")))).union(i.select(F.concat(F.lit("case-"), F.col("item_id").cast("string"), F.lit("/q1"))))
    return ids.distinct().select("id", M.cluster_of(F.col("id")).alias("cluster"))


_G = "(SELECT split_part(id, '/', 1) AS source, coalesce('case-' || (('0x' || left(sha256(id), 4))::INT % 40), id) AS c, brier::DOUBLE AS v FROM s)"


@query(f"""WITH {_S}, x AS MATERIALIZED (SELECT * FROM {_G}), m AS (SELECT source, count(*) AS n, count(DISTINCT c) AS g, avg(v) AS mean, stddev_samp(v) AS sd FROM x GROUP BY source),
q AS (SELECT source, sum(d * d) AS ss FROM (SELECT x.source, x.c, sum(v - mean) AS d FROM x JOIN m USING (source) GROUP BY ALL) GROUP BY source),
r AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN g = n THEN sd / sqrt(n) WHEN g >= 2 THEN sqrt(g / (g - 1) * ss) / n END AS se FROM m JOIN q USING (source))
SELECT source, n, g AS clusters, round(mean, 10) AS mean, round(mean - {Z} * se, 10) AS lo, round(mean + {Z} * se, 10) AS hi FROM r""")
def clustered_intervals(t):
    case = F.concat(F.lit("case-"), (F.conv(F.substring(F.sha2("id", 256), 1, 4), 16, 10).cast("int") % 40).cast("string"))
    r = _rows(t).withColumn("source", F.split_part("id", F.lit("/"), F.lit(1)))
    return _round(M.mean_ci(r, F.col("brier"), case, "source"))


_MC = "least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))))"


@query(f"SELECT b, c, round({_MC}, 8) AS p FROM (SELECT b::BIGINT AS b, unnest(range(0, 60, 4)) AS c FROM range(0, 60, 3) t(b)) WHERE b + c > 0")
def mcnemar_table(t):
    r = t.spark.range(0, 60, 3).select(F.col("id").alias("b"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(56), F.lit(4)), lambda x: x.cast("long"))).alias("c")).where("b + c > 0")
    return r.select("b", "c", F.round(M.mcnemar(F.col("b"), F.col("c")), 8).alias("p"))


_PAIR = f"""WITH {_S}, {_B}, j AS MATERIALIZED (SELECT split_part(id, '/', 1) AS source, s.correct AS ca, o.correct AS cb, s.brier - o.brier AS db, s.nll - o.nll AS dn FROM s JOIN o USING (id)),
c AS (SELECT source, count(*) AS n, avg(ca) AS acc_a, avg(cb) AS acc_b, count(*) FILTER (ca = 1 AND cb = 0) AS b, count(*) FILTER (ca = 0 AND cb = 1) AS c,
avg(ca - cb) AS d_acc, {Z} * stddev_samp((ca - cb)::DOUBLE) / sqrt(count(*)) AS h_acc, avg(db) AS d_brier, {Z} * stddev_samp(db) / sqrt(count(*)) AS h_brier, avg(dn) AS d_nll, {Z} * stddev_samp(dn) / sqrt(count(*)) AS h_nll FROM j GROUP BY source)"""


@query(f"""{_PAIR} SELECT source, n, 0 AS only_a, 0 AS only_b, 0 AS gold_mismatch, 0 AS input_mismatch, n AS clusters, round(acc_a, 10) AS acc_a, round(acc_b, 10) AS acc_b, b AS a_right_b_wrong, c AS a_wrong_b_right,
round(d_acc, 10) AS d_acc, round(d_acc - h_acc, 10) AS d_acc_lo, round(d_acc + h_acc, 10) AS d_acc_hi, round(d_brier, 10) AS d_brier, round(d_brier - h_brier, 10) AS d_brier_lo, round(d_brier + h_brier, 10) AS d_brier_hi,
round(d_nll, 10) AS d_nll, round(d_nll - h_nll, 10) AS d_nll_lo, round(d_nll + h_nll, 10) AS d_nll_hi, round(CASE WHEN b + c = 0 THEN 1.0 ELSE {_MC} END, 10) AS mcnemar_p FROM c""")
def paired_by_source(t):
    src = F.split_part("id", F.lit("/"), F.lit(1))
    return _round(M.paired(_rows(t).withColumn("source", src), _other(t).withColumn("source", src), "source"))


@query(f"""{_PAIR} SELECT source, CASE WHEN n < 2 THEN 'no clear difference' WHEN round(d_acc - h_acc, 9) > 0 THEN 'better' WHEN round(d_acc + h_acc, 9) < 0 THEN 'worse' ELSE 'no clear difference' END AS verdict FROM c""")
def verdict_by_source(t):
    src = F.split_part("id", F.lit("/"), F.lit(1))
    p = M.paired(_rows(t).withColumn("source", src), _other(t).withColumn("source", src), "source")
    return p.select("source", M.verdict(F.round("d_acc_lo", 9), F.round("d_acc_hi", 9)).alias("verdict"))


@query(f"""{_PAIR} SELECT source, CASE WHEN n < 2 THEN '-' ELSE format('{{:+.1f}} [{{:+.1f}}, {{:+.1f}}]{{}}', round(100 * round(d_acc, 9), 1), round(100 * round(d_acc - h_acc, 9), 1), round(100 * round(d_acc + h_acc, 9), 1),
CASE WHEN round(d_acc - h_acc, 9) > 0 OR round(d_acc + h_acc, 9) < 0 THEN '*' ELSE '' END) END AS shown FROM c""")
def points_by_source(t):
    src = F.split_part("id", F.lit("/"), F.lit(1))
    p = M.paired(_rows(t).withColumn("source", src), _other(t).withColumn("source", src), "source")
    return p.select("source", M.points(*(F.round(c, 9) for c in ("d_acc", "d_acc_lo", "d_acc_hi"))).alias("shown"))


_W = ", ".join(f"(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) % 4294967296)::VARCHAR" for i in range(4))


@query(f"WITH {_D} SELECT source, left(sha256(concat_ws(',', {_W})), 16) AS fingerprint FROM (SELECT split_part(id, '/', 1) AS source, sha256(id || chr(9) || gold || chr(9) || coalesce(render, '')) AS h FROM d) GROUP BY source")
def fingerprints(t):
    return M.fingerprint_sum(M.unique_ids(t.predictions).withColumn("source", F.split_part("id", F.lit("/"), F.lit(1))), "source")


@query(f"WITH {_D} SELECT gold, left(sha256(string_agg(line, '' ORDER BY line)), 16) AS fingerprint FROM (SELECT gold, id || chr(9) || gold || chr(9) || coalesce(render, '') || chr(10) AS line FROM d WHERE qtype = 'choice' AND gold > 3) GROUP BY gold")
def fingerprints_of_lists(t):
    """Of small sets: the digest of their sorted lines."""
    return M.fingerprint(M.unique_ids(t.predictions).where("qtype = 'choice' AND gold > 3"), "gold")


@query(f"WITH {_D} SELECT slice, left(sha256(concat_ws(',', {_W})), 16) AS fingerprint FROM (SELECT unnest(list_distinct(slices)) AS slice, sha256(id || chr(9) || gold || chr(9) || coalesce(render, '')) AS h FROM d) GROUP BY slice")
def fingerprints_of_slices(t):
    return M.fingerprint_sum(M.by_slice(M.unique_ids(t.predictions), RULES), "slice")


@query("""SELECT ord, CASE WHEN split = 'dev' THEN ['probe:' || family, 'probe:' || family || '/qtype:' || type] WHEN split = 'test' THEN ['test:fixed:ALL', 'test:fixed:lang:' || l, 'test:fixed:source:' || source, 'test:fixed:qtype:' || type]
ELSE ['test:ALL', 'test:lang:' || l, 'test:source:' || source, 'test:qtype:' || type, 'test:lang:' || l || '/qtype:' || type] END AS slices
FROM (SELECT ord, type, split, split_part(id, '/', 1) AS source, CASE WHEN regexp_matches(id, '^[^/]*_zh(_|/)') THEN 'zh' ELSE 'en' END AS l, CASE WHEN ord % 2 = 0 THEN 'even' ELSE 'other' END AS family FROM records)""")
def slices_from_ids(t):
    """Training ids plain, test ids as marked variants, dev ids as those of probes of a named family and of none."""
    r = t.records.select("ord", "type", F.when(F.col("split") == "test", F.concat("id", F.lit("#fixed"))).when((F.col("split") == "dev") & (F.col("ord") % 2 == 0), F.concat(F.lit("probe-even-"), "id")).when(F.col("split") == "dev", F.concat(F.lit("item "), "id")).otherwise(F.col("id")).alias("i"))
    return r.select("ord", M.slices_from_id(F.col("i"), F.col("type"), RULES).alias("slices"))


@query(f"""WITH {_S} SELECT slice, count(*) AS n, count(DISTINCT id) AS clusters FROM (SELECT id, unnest(list_distinct(slices)) AS slice FROM s) GROUP BY slice""")
def slice_counts(t):
    return M.by_slice(_rows(t), RULES).groupBy("slice").agg(F.count("*").alias("n"), F.countDistinct("id").alias("clusters"))


@query(f"""WITH {_S}, {_B}, ea AS (SELECT unnest(list_distinct(slices)) AS slice, id FROM s WHERE ('0x' || right(sha256(id), 1))::INT % 8 > 0 OR slices[1] LIKE '%pinecrest%'),
eb AS (SELECT unnest(list_distinct(slices)) AS slice, id FROM o), a AS (SELECT slice, list_sort(list(id)) AS ids FROM ea GROUP BY slice), b AS (SELECT slice, list_sort(list(id)) AS ids FROM eb GROUP BY slice)
SELECT slice, CASE WHEN b.ids IS NULL THEN 'only in A' WHEN a.ids IS NULL THEN 'only in B' WHEN a.ids = b.ids THEN 'same items' ELSE 'items differ' END AS status, len(list_intersect(coalesce(a.ids, []), coalesce(b.ids, []))) AS n FROM a FULL JOIN b USING (slice)""")
def compare_slices(t):
    a = _rows(t).where((F.conv(F.substring(F.sha2("id", 256), 64, 1), 16, 10).cast("int") % 8 > 0) | F.get("slices", F.lit(0)).contains("pinecrest"))
    return M.compared(a, _other(t), RULES).select("slice", "status", "n")


@query(f"""WITH {_S}, {_B} SELECT s.id, round(s.brier - o.brier, 6) AS d_brier FROM s JOIN o USING (id)""")
def paired_items(t):
    a, b = _rows(t).select("id", "brier"), _other(t).select("id", F.col("brier").alias("other"))
    return a.join(b, "id").select("id", F.round(F.col("brier") - F.col("other"), 6).alias("d_brier"))


@query(f"""WITH {_S} SELECT id, list_transform(q, lambda x: round(x / list_sum(q), 6)) AS probs FROM (SELECT id, list_transform(p, lambda x: x ** (CASE qtype WHEN 'choice' THEN 1.3 WHEN 'score' THEN 0.8 ELSE 1.1 END)::DOUBLE) AS q FROM s)""")
def untemper(t):
    temp = F.when(F.col("qtype") == "choice", 1.3).when(F.col("qtype") == "score", 0.8).otherwise(1.1)
    r = _rows(t)
    return r.select("id", F.transform(A.untempered(F.col("p"), temp), lambda x: F.round(x, 6)).alias("probs"))


@query(f"""WITH {_S}, q AS MATERIALIZED (SELECT id, p, pred, list_transform(p, lambda x: round(x, 3)) AS r FROM s) SELECT count(*) AS n, round(max(list_max(list_transform(list_zip(p, r), lambda z: abs(z[1] - z[2])))), 10) AS max_gap,
round(avg((list_position(r, list_max(r)) = list_position(p, list_max(p)))::INT), 10) AS agreement FROM q""")
def parity_of_runs(t):
    a = _rows(t).withColumn("pred", F.array_position("p", F.array_max("p")))
    b = a.withColumn("p", F.transform("p", lambda x: F.round(x, 3)))
    return _round(M.parity(a, b.withColumn("pred", F.array_position("p", F.array_max("p")))))


@query(f"""WITH {_S}, g AS (SELECT split_part(id, '/', 1) AS source, count(*) AS n, avg(correct) AS acc FROM s WHERE id LIKE '%/test/%' GROUP BY 1)
SELECT 'sources' AS average, count(*) AS parts, round(avg(acc), 10) AS acc, round(greatest(0, avg(acc) - {Z} * sqrt(sum(acc * (1 - acc) / n)) / count(*)), 10) AS lo, round(least(1, avg(acc) + {Z} * sqrt(sum(acc * (1 - acc) / n)) / count(*)), 10) AS hi FROM g""")
def macro_average(t):
    g = _rows(t).where("id LIKE '%/test/%'").groupBy(F.split_part("id", F.lit("/"), F.lit(1)).alias("source")).agg(F.count("*").alias("n"), F.avg("correct").alias("acc"))
    return _round(M.macro(g, "sources"))


@query()
def bootstrap_intervals(t):
    return M.bootstrap(M.by_slice(_rows(t), RULES), "slice")


@query(f"WITH {_S}, e AS (SELECT s.*, unnest(list_distinct(slices)) AS slice FROM s) SELECT slice, count(*) AS n, round(avg(correct), 10) AS acc, true AS inside FROM e GROUP BY slice HAVING count(*) >= 20")
def bootstrap_covers(t):
    """Per slice of at least twenty decisions the accuracy, and whether the resampled interval holds it."""
    b = M.bootstrap(M.by_slice(_rows(t), RULES), "slice")
    return b.select("slice", "n", F.round(F.col("k") / F.col("n"), 10).alias("acc"), (F.col("lo") <= F.col("k") / F.col("n")).__and__(F.col("hi") >= F.col("k") / F.col("n")).alias("inside"))


@query()
def calibration_floor(t):
    return M.ece_floor(M.by_slice(_rows(t), RULES), "slice")


def _logits(t):
    z = F.transform("p", lambda x: F.round(F.ln(F.greatest(x, F.lit(1e-6))), 9))
    return stored(_rows(t).select("id", "qtype", "gold", z.alias("z")), "logits")


_Z = f"{_S}, z AS MATERIALIZED (SELECT id, qtype, gold, list_transform(p, lambda x: round(ln(greatest(x, 1e-6)), 9)) AS z, list_max(list_transform(p, lambda x: round(ln(greatest(x, 1e-6)), 9))) AS top, qtype || '/' || CASE WHEN k <= 2 THEN '2' WHEN k <= 5 THEN '3-5' WHEN k <= 10 THEN '6-10' ELSE '11+' END AS bucket FROM s)"


def _best(name: str, candidates: str, key: str) -> str:
    loss = "ln(list_sum(list_transform(z, lambda x: exp((x - top) / t)))) - (z[gold + 1] - top) / t"
    return f"{name} AS MATERIALIZED (SELECT {key}, arg_min(t, (loss, t)) AS best FROM (SELECT {key}, t, avg({loss}) AS loss FROM z JOIN ({candidates}) c USING ({key}) GROUP BY {key}, t) GROUP BY {key})"


def _fit_sql(key: str) -> str:
    """Relations z and, after all rounds, t3 with the best temperature per key."""
    return ", ".join(
        [
            _Z,
            _best("t0", f"SELECT {key}, exp(ln({C.LO}) + i * (ln({C.HI}) - ln({C.LO})) / {C.GRID - 1}) AS t FROM (SELECT DISTINCT {key} FROM z), range({C.GRID}) r(i)", key),
            *(_best(f"t{k + 1}", f"SELECT {key}, best / {C.NEAR} + (best * {C.NEAR} - best / {C.NEAR}) * i / {C.FINE - 1} AS t FROM t{k}, range({C.FINE}) r(i)", key) for k in range(C.ROUNDS)),
        ]
    )


_FIT = _fit_sql("qtype")


@query(f"WITH {_FIT} SELECT qtype, count(*) AS n, round(CASE WHEN count(*) < 10 THEN 1 ELSE greatest({C.LO}, least({C.HI}, any_value(best))) END, 4) AS t FROM z JOIN t{C.ROUNDS} USING (qtype) GROUP BY qtype")
def fit_temperature(t):
    return C.fit(_logits(t), "qtype").withColumn("t", F.round("t", 4))


@query(f"WITH {_fit_sql('bucket')} SELECT bucket, count(*) AS n, round(greatest({C.LO}, least({C.HI}, any_value(best))), 4) AS t FROM z JOIN t{C.ROUNDS} USING (bucket) GROUP BY bucket HAVING count(*) >= 200")
def fit_temperature_buckets(t):
    return C.fit_both(_logits(t), 200)[1]


@query(f"""WITH {_FIT}, w AS (SELECT id, z, top, round(best, 4) AS t FROM z JOIN t{C.ROUNDS} USING (qtype)), e AS (SELECT id, list_transform(z, lambda x: exp((x - top) / t)) AS e FROM w)
SELECT id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS probs FROM e""")
def apply_temperature(t):
    z = _logits(t)
    by_type, by_bucket = C.fit_both(z, 1 << 40)
    return C.apply(z, by_type, by_bucket).select("id", F.transform("probs", lambda x: F.round(x, 6)).alias("probs"))


@query()
def crossfit_report(t):
    z = _logits(t)
    none = [F.lit(None).cast("double").alias("gold_score"), F.lit(None).cast("array<double>").alias("gold_soft")]
    before = z.withColumn("probs", A.softmax(F.col("z"))).withColumn("when", F.lit("before"))
    after = C.crossfit(z, fold(F.col("id"))).drop("fold").withColumn("when", F.lit("after"))
    return M.summary(M.scored(before.unionByName(after).select("id", "qtype", "gold", "probs", "when", *none)), "when")


@query(f"WITH {_Z} SELECT id, list_transform(z, lambda x: round(exp(x - top) / list_sum(list_transform(z, lambda y: exp(y - top))), 6)) AS probs FROM z")
def softmax_of_logits(t):
    return _logits(t).select("id", F.transform(A.softmax(F.col("z")), lambda x: F.round(x, 6)).alias("probs"))


_RANK = "CASE WHEN slice LIKE 'test:fixed:%' THEN 2 WHEN slice LIKE 'test:source:%' OR slice LIKE 'test:src:%' THEN 4 WHEN slice LIKE 'test:%' THEN 1 WHEN slice LIKE 'probe:%' THEN 3 ELSE 99 END"


@query(f"SELECT slice, {_RANK} AS rank, (row_number() OVER (ORDER BY {_RANK}, len(regexp_split_to_array(slice, '[:/]')), slice))::INT AS place FROM (SELECT DISTINCT unnest(slices) AS slice FROM predictions)")
def slice_order(t):
    s = t.predictions.select(F.explode("slices").alias("slice")).distinct()
    rank = M.slice_rank(F.col("slice"), ORDER)
    return M.in_order(s, rank).select("slice", rank.alias("rank"), "place")


@query(f"""WITH {_S}, e AS (SELECT s.*, unnest(list_distinct(slices)) AS slice FROM s), c AS (SELECT slice, count(*) AS n, sum(correct) AS k, {Z} AS z FROM e GROUP BY slice)
SELECT slice, n, round(greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) * n + z * z / 4)) / (1 + z * z / n)) , 6) AS lo, true AS floor_fits FROM (SELECT slice, n, k, z FROM c)""".replace("z * sqrt(k / n * (1 - k / n) * n + z * z / 4))", "z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)))"))
def interval_table(t):
    """Per slice the number of decisions, the Wilson interval of the accuracy and the calibration error that perfect calibration would show, which is
    above zero and falls short of what random confidences show."""
    rows = M.by_slice(_rows(t), RULES)
    g = rows.groupBy("slice").agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    lo, _ = M.wilson(F.col("k"), F.col("n"))
    floor = M.ece_floor(rows, "slice")
    return g.join(floor, "slice", "left").select("slice", "n", F.round(lo, 6).alias("lo"), F.col("ece15_floor").between(0, 1).alias("floor_fits"))


@query("""SELECT r.id, left(sha256(r.question || chr(10) || coalesce(r.context, '')), 12) AS render FROM records r WHERE r.split = 'test' QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY ord) = 1""")
def render_hash(t):
    first = t.records.where("split = 'test'").groupBy("id").agg(F.min("ord").alias("ord"))
    r = t.records.join(first.select("ord"), "ord", "left_semi")
    return r.select("id", F.substring(F.sha2(F.concat("question", F.lit("\n"), F.coalesce("context", F.lit(""))), 256), 1, 12).alias("render"))


@query(f"""WITH {_S}, f AS (SELECT * REPLACE (list_reverse_sort(probs) AS probs) FROM d WHERE id LIKE '%/test/%'), {_scored("l", "f")} SELECT 'test:fixed:' || s.qtype AS slice, count(*) AS n, round(avg(l.correct - s.correct), 10) AS d_acc FROM l JOIN s USING (id) GROUP BY s.qtype""")
def rendering_against_plain(t):
    """The same items under the fixed rendering and plain, matched by the id without its mark."""
    plain = _rows(t)
    marked = M.scored(M.unique_ids(t.predictions).where("id LIKE '%/test/%'").withColumn("probs", F.reverse(F.array_sort("probs"))).withColumn("id", F.concat("id", F.lit("#fixed"))))
    both = marked.withColumn("id", F.regexp_replace("id", "#fixed$", "")).select("id", F.col("correct").alias("fixed")).join(plain.select("id", "qtype", "correct"), "id")
    return both.groupBy(F.concat(F.lit("test:fixed:"), "qtype").alias("slice")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("fixed") - F.col("correct")), 10).alias("d_acc"))


@query(f"""WITH {_S}, e AS (SELECT s.*, unnest(list_distinct(slices)) AS slice FROM s) SELECT slice, count(*) AS n, round(avg(k), 10) AS mean_options, round(sum(conf) / sum(1.0::DOUBLE / k), 8) AS lift FROM e GROUP BY slice""")
def slice_options(t):
    return M.by_slice(_rows(t), RULES).groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("k"), 10).alias("mean_options"), F.round(F.sum("conf") / F.sum(1 / F.col("k")), 8).alias("lift"))
