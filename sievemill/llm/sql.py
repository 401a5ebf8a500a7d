"""SQL for the queries of this subpackage that SQL can express over whole tables: by brute force, without the operators."""

from __future__ import annotations

from sievemill.functions.text import SPACE
from sievemill.llm.lookalike import form


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _visible(x: str) -> str:
    """What shows of a text: every code point of the first plane by a rule, then composed."""
    one, many, gone = [], [], []
    for c in (c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000):
        v = form(chr(c))
        if v == "":
            gone.append(chr(c))
        elif v != chr(c) and len(v) == 1:
            one.append((chr(c), v))
        elif v != chr(c) and not any(0x300 <= ord(y) < 0x370 for y in v):
            many.append((chr(c), v))
    # Of several plain characters only these forms are in use; all others would make the text very long.
    many = [(a, b) for a, b in many if a in "ﬀﬁﬂﬃﬄﬅﬆ…‥"]
    t = f"translate(replace({x}, chr(9), ' '), {_quoted(''.join(a for a, _ in one))} || {_quoted(''.join(gone))}, {_quoted(''.join(b for _, b in one))})"
    for a, b in many:
        t = f"replace({t}, '{a}', '{b}')"
    return f"nfc_normalize({t})"


_LETTERS = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

_FORMS = f"""WITH r AS (SELECT DISTINCT id, source, split, question, options, context FROM records WHERE context IS NOT NULL),
j AS (SELECT id, string_agg(path || '=' || v, chr(1) ORDER BY path) AS form FROM (SELECT r.id, t.fullkey AS path, CASE t.type WHEN 'VARCHAR' THEN 's' || {_LETTERS.format("t.atom->>'$'")} ELSE coalesce(TRY_CAST(t.atom AS DOUBLE)::VARCHAR, t.atom::VARCHAR) END AS v
FROM r, json_tree(r.context) t WHERE r.context LIKE '{{%}}' AND json_valid(r.context) AND t.atom IS NOT NULL) GROUP BY id),
k AS (SELECT r.*, coalesce('{{' || j.form, {_LETTERS.format("context")}) AS form FROM r LEFT JOIN j USING (id)),
g AS (SELECT id, min(id) OVER w AS keep_id, count(*) OVER w AS n FROM k WHERE length({_LETTERS.format("context")}) >= 40 WINDOW w AS (PARTITION BY source, split, question, options, form))"""

_WINDOWS = """WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200), g AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d))"""
_SHARED = "s AS MATERIALIZED (SELECT doc_id, i, doc_id > lo AS later FROM g JOIN (SELECT h, min(doc_id) AS lo FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h))"


def _cover(name: str, places: str) -> str:
    return f"{name} AS (SELECT doc_id, sum(least(200, coalesce(after - i, 200)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM {places}) GROUP BY doc_id)"




def _bytes(x: str, prime: int) -> str:
    """One byte per code point, so that a distance of bytes is one of code points, unless two differ by a multiple of the prime."""
    return f"list_aggregate(list_transform(string_split({x}, ''), lambda c: chr(33 + unicode(c) % {prime})), 'string_agg', '')"


_PRIMES = (89, 83, 79)
_NEAR = f"""WITH l AS MATERIALIZED (SELECT DISTINCT id, split, source, {_LETTERS.format("context")} AS t FROM records WHERE id IS NOT NULL AND context IS NOT NULL AND split IN ('train', 'dev', 'test')),
x AS MATERIALIZED (SELECT *, length(t) AS n, {", ".join(f"{_bytes('t', k)} AS c{i}" for i, k in enumerate(_PRIMES))} FROM (SELECT DISTINCT t, split = 'train' AS train FROM l) WHERE length(t) >= 40),
y AS MATERIALIZED (SELECT a.t AS ta, b.t AS tb, greatest(a.n, b.n) // 10 AS most, {", ".join(f"a.c{i} AS a{i}, b.c{i} AS b{i}" for i in range(3))} FROM (FROM x WHERE NOT train) a JOIN (FROM x WHERE train) b ON a.n <= b.n + b.n // 9 + 1 AND b.n <= a.n + a.n // 9 + 1
WHERE levenshtein(a.c0, b.c0) <= greatest(a.n, b.n) // 10), near AS MATERIALIZED (SELECT ta, tb FROM y WHERE {" AND ".join(f"levenshtein(a{i}, b{i}) <= most" for i in range(3))}),
links AS (SELECT a.id AS id_eval, a.split, a.source, b.id AS id_train FROM near JOIN l a ON a.t = ta AND a.split <> 'train' JOIN l b ON b.t = tb AND b.split = 'train')"""



def _full_forms() -> str:
    """Code points of the first plane whose consistent form is another one, as rows."""
    rows = ((c, form(chr(c), False)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000)
    return ", ".join(f"({c}, {_quoted(f)})" for c, f in rows if f != chr(c))


def _consistent_sql() -> str:
    return f"""WITH r AS MATERIALIZED (SELECT DISTINCT id, context, options FROM records WHERE id IS NOT NULL), m(c, f) AS MATERIALIZED (VALUES {_full_forms()}),
t AS MATERIALIZED (SELECT row_number() OVER () AS k, x FROM (SELECT DISTINCT x FROM (SELECT context AS x FROM r UNION ALL SELECT unnest(options) FROM r) WHERE x IS NOT NULL)),
p AS (SELECT k, unnest(l) AS ch, generate_subscripts(l, 1) AS i FROM (SELECT k, string_split(replace(x, chr(13) || chr(10), chr(10)), '') AS l FROM t WHERE x <> '')),
g AS (SELECT k, lower(nfc_normalize(string_agg(CASE WHEN ch = chr(9) THEN ' ' ELSE coalesce(f, ch) END, '' ORDER BY i))) AS y FROM p LEFT JOIN m ON m.c = unicode(ch) GROUP BY k), v AS MATERIALIZED (SELECT x, coalesce(y, '') AS y FROM t LEFT JOIN g USING (k)),
o AS (SELECT id, list(v.y ORDER BY i) AS y FROM (SELECT id, unnest(options) AS x, generate_subscripts(options, 1) AS i FROM r) LEFT JOIN v USING (x) GROUP BY id)
SELECT r.id, v.y AS context_form, CASE WHEN len(r.options) = 0 THEN [] ELSE o.y END AS options_form FROM r LEFT JOIN v ON v.x = r.context LEFT JOIN o ON o.id = r.id"""


# Tokens by applying the merges in their order to all words at once: pieces stand in angle brackets. A merge's parts come from merges before it.
_TOKENS = f"""WITH RECURSIVE rows_ AS MATERIALIZED (SELECT DISTINCT ON (id) 'record' AS kind, id, source, lang, NULL::VARCHAR AS domain, context AS text FROM records WHERE id IS NOT NULL UNION ALL SELECT 'document', doc_id::VARCHAR, source, lang, domain, text FROM documents),
texts AS MATERIALIZED (SELECT DISTINCT text FROM rows_ WHERE text <> ''), found AS MATERIALIZED (SELECT text, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM texts),
merges_ AS MATERIALIZED (SELECT left_piece AS l, right_piece AS r, row_number() OVER (ORDER BY merge_rank) AS n FROM tok_merges),
b AS (SELECT word, regexp_replace(word, '(.)', '<\\1>', 'g') AS s, 0::BIGINT AS step FROM (SELECT DISTINCT word FROM found) UNION ALL SELECT word, replace(s, '<' || l || '><' || r || '>', '<' || l || r || '>'), step + 1 FROM b JOIN merges_ ON n = step + 1),
w AS (SELECT word, length(s) - length(replace(s, '<', '')) AS n FROM b WHERE step = (SELECT max(n) FROM merges_)),
tokens AS MATERIALIZED (SELECT text, length(regexp_replace(text, '[A-Za-z{SPACE}]', '', 'g')) + coalesce(n, 0) AS n FROM texts LEFT JOIN (SELECT text, sum(w.n) AS n FROM found JOIN w USING (word) GROUP BY text) USING (text)),
slices AS (SELECT kind, r.source, coalesce(CASE WHEN length(regexp_extract(r.lang, '^[A-Za-z]+')) >= 2 THEN lower(left(regexp_extract(r.lang, '^[A-Za-z]+'), 2)) END, lower(d.lang)) AS lang, coalesce(r.domain, CASE WHEN kind = 'record' THEN d.domain END) AS domain, coalesce(n, 0) AS n
FROM rows_ r LEFT JOIN (SELECT DISTINCT ON (key) * FROM datasets WHERE key IS NOT NULL) d ON d.key = r.source LEFT JOIN tokens USING (text))"""
_BUDGET = f"{_TOKENS} SELECT kind, source, lang, domain, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM slices GROUP BY kind, source, lang, domain"

SQL: dict[str, str] = {
    "p2_consistent_form": _consistent_sql(),
    "p4_token_budget": _BUDGET,
    "p4_updated_budget": _BUDGET,
    "p1_found": f"{_NEAR} SELECT DISTINCT least(id_eval, id_train) AS id_a, greatest(id_eval, id_train) AS id_b FROM links",
    "p1_overlap_counts": f"{_NEAR} SELECT split, source, count(DISTINCT id_eval) AS n_records, count(*) AS n_pairs FROM (SELECT DISTINCT id_eval, id_train, split, source FROM links) GROUP BY ALL",
    "p1_record_links": f"""{_NEAR}, n AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id_eval, id_train, unnest([id_eval, id_train]) AS id FROM links) GROUP BY id)
SELECT id, min(id) OVER (PARTITION BY t, split = 'train') AS class_id, coalesce(n, 0) AS n_links FROM (SELECT DISTINCT id, split, t FROM l WHERE length(t) >= 40) LEFT JOIN n USING (id)""",
    "p3_sources": f"""WITH t AS (SELECT DISTINCT ON (source, lang) source, lang, target_share FROM mix_targets WHERE source IS NOT NULL AND target_share IS NOT NULL), own AS (SELECT source, any_value(lang) AS own FROM t GROUP BY source),
r AS (SELECT DISTINCT id, source, CASE WHEN length(regexp_extract(lang, '^[A-Za-z]+')) >= 2 THEN lower(left(regexp_extract(lang, '^[A-Za-z]+'), 2)) ELSE own END AS lang FROM records JOIN own USING (source) WHERE id IS NOT NULL AND regexp_matches(context, '[^{SPACE}]')),
n AS (SELECT source, lang, count(*) AS n FROM r GROUP BY ALL) SELECT source, lang, target_share, coalesce(n, 0) AS n_records, true AS within, true AS shared FROM t LEFT JOIN n USING (source, lang)""",
    "p6_pieces": "SELECT spec_name, doc_id, n_tokens, greatest(1, ceil(n_tokens / capacity_tokens))::BIGINT AS n_pieces, 0 AS n_over FROM token_counts, pack_sizes",
    "p4_counted_documents": "SELECT doc_id, n_tokens FROM token_counts",
    "p5_found": f"{_FORMS} SELECT keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p5_copy_counts": f"{_FORMS} SELECT DISTINCT keep_id, n AS n_copies FROM g WHERE n > 1",
    "p2_found": f"""WITH r AS (SELECT DISTINCT id, split, source, context, options FROM records WHERE context IS NOT NULL OR options IS NOT NULL),
t AS (SELECT DISTINCT x FROM (SELECT context AS x FROM r UNION ALL SELECT unnest(options) FROM r) WHERE x IS NOT NULL), v AS MATERIALIZED (SELECT x, {_visible("x")} AS y FROM t),
o AS (SELECT id, string_agg(coalesce(v.y, chr(1)), chr(2) ORDER BY i) AS look FROM (SELECT id, unnest(options) AS x, generate_subscripts(options, 1) AS i FROM r) LEFT JOIN v USING (x) GROUP BY id),
k AS MATERIALIZED (SELECT r.*, v.y AS c, o.look AS p FROM r LEFT JOIN v ON v.x = r.context LEFT JOIN o USING (id))
SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM k a JOIN k b ON a.split = b.split AND a.id < b.id AND a.source <> b.source AND a.c IS NOT DISTINCT FROM b.c AND a.p IS NOT DISTINCT FROM b.p AND (a.options IS NULL) = (b.options IS NULL)
AND (a.context IS DISTINCT FROM b.context OR a.options IS DISTINCT FROM b.options)""",
    "p7_found": f"""WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, {_LETTERS.format("text")} AS t FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_LETTERS.format("q_native.state")} AS p FROM probe_items WHERE q_native.state IS NOT NULL),
w AS (SELECT DISTINCT item_id, substr(p, j, length(p) // 2 + 1) AS piece FROM (SELECT item_id, p, unnest(range(1, length(p) - length(p) // 2 + 1)) AS j FROM i WHERE p <> ''))
SELECT DISTINCT item_id, doc_id FROM w JOIN d ON contains(d.t, w.piece)""",
    "p7_removal_spans": f"""WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, {_LETTERS.format("text")} AS t FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT {_LETTERS.format("q_native.state")} AS p FROM probe_items WHERE q_native.state IS NOT NULL),
w AS (SELECT DISTINCT substr(p, j, length(p) // 2 + 1) AS piece FROM (SELECT p, unnest(range(1, length(p) - length(p) // 2 + 1)) AS j FROM i WHERE p <> '')), m AS MATERIALIZED (SELECT doc_id, t, piece FROM w JOIN d ON contains(d.t, w.piece)),
o AS (SELECT DISTINCT doc_id, j - 1 AS start, j - 1 + length(piece) AS stop FROM (SELECT doc_id, t, piece, unnest(range(1, length(t) - length(piece) + 2)) AS j FROM m) WHERE substr(t, j, length(piece)) = piece),
s AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o), c AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS part FROM s)
SELECT doc_id, min(start) AS start, max(stop) AS stop FROM c GROUP BY doc_id, part""",
    "p8_found": f"""{_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b USING (h) WHERE a.doc_id < b.doc_id""",
    "p8_document_links": f"""{_WINDOWS}, p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b USING (h) WHERE a.doc_id <> b.doc_id), n AS (SELECT x AS doc_id, count(*) AS n FROM p GROUP BY x)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, coalesce(n, 0) AS n_links FROM d LEFT JOIN n USING (doc_id)""",
    "p8_spans": f"""{_WINDOWS}, {_SHARED}, c AS (SELECT *, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s))
SELECT doc_id, (min(i) - 1)::INT AS start, (max(i) + 199)::INT AS stop FROM c GROUP BY doc_id, part""",
    "p8_document_share": f"""{_WINDOWS}, {_SHARED}, {_cover("a", "s")}, {_cover("b", "(SELECT * FROM s WHERE later)")}
SELECT doc_id, length(text)::INT AS n_chars, a.n AS n_shared, coalesce(b.n, 0) AS n_removed FROM d JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""",
}
