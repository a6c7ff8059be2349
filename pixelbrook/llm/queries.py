"""The queries of this subpackage, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bm25, chat, decontaminate, pieces, quality, secrets, simhash, suffix_dedup, token_counts, toxicity
from .arrow import read


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality(spark, sf_dir):
    return quality.report(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))


def op4_bm25(spark, sf_dir):
    """Every document whose id is divisible by 20 is a query, with its whole text, against all documents."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bm25.search(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), "text"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.report(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op6_chat(spark, sf_dir):
    return chat.repaired(read(spark, sf_dir, "conversations"))


def op7_toxicity(spark, sf_dir):
    return toxicity.report(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))


def op8_secrets(spark, sf_dir):
    return secrets.report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_pieces(spark, sf_dir):
    return pieces.report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_token_counts(spark, sf_dir):
    return token_counts.suffix_sums(token_counts.histogram(read(spark, sf_dir, "documents", "text")))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_simhash, op3_quality, op4_bm25, op5_decontaminate, op6_chat, op7_toxicity, op8_secrets, op9_pieces, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {}

#: The words of a text, as decontamination and search take them.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL["op1_suffix_dedup"] = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, md5_number(b[i:i + 199]) AS g FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
m AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM s WHERE g IN (SELECT g FROM m)),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
p AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM p),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(hex(b[before:a - 1]) || CASE WHEN last THEN hex(b[z:octet_length(b)]) ELSE '' END, '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""

ORACLE_SQL["op4_bm25"] = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
tf AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT q.doc_id AS query_id, x.doc_id, round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * x.c * 2.2 / (x.c + 1.2 * (0.25 + 0.75 * len(d.w) / n.mean))), 6) AS score
 FROM tf q JOIN tf x USING (t) JOIN df USING (t) JOIN d ON d.doc_id = x.doc_id CROSS JOIN n WHERE q.doc_id % 20 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

ORACLE_SQL["op5_decontaminate"] = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT DISTINCT n, split_part(g, ' ', 1) AS f FROM g),
p AS (SELECT doc_id, w, unnest(w) AS f, generate_subscripts(w, 1) AS i FROM d),
c AS (SELECT p.doc_id, p.i, v.n, array_to_string(list_slice(p.w, p.i, p.i + v.n - 1), ' ') AS g FROM p JOIN v ON v.f = p.f WHERE p.i + v.n - 1 <= len(p.w)),
h AS (SELECT DISTINCT c.doc_id, c.i, g.n, g.item FROM c JOIN g ON g.n = c.n AND g.g = c.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

#: Rules as (kind, pattern, group, least length, base); letters of either case are spelled out, as only ASCII ones count.
_RULES = ", ".join(
    f"({k}, '{r.kind}', '{p}', {r.group}, {r.least}, {str(r.base).upper()})"
    for k, (r, p) in enumerate(
        (r, ("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""") if r.kind == "assign" else r.pattern) for r in secrets.RULES
    )
)

# between the matches lie what splitting by the pattern gives, so lengths of both add up to places
ORACLE_SQL["op8_secrets"] = f"""WITH r(k, kind, pattern, grp, least, base) AS (VALUES {_RULES}), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, regexp_extract_all(text, (SELECT pattern FROM r WHERE k = {k})) AS m, regexp_extract_all(text, (SELECT pattern FROM r WHERE k = {k}), {r.group}) AS g, string_split_regex(text, (SELECT pattern FROM r WHERE k = {k})) AS s FROM d" for k, r in enumerate(secrets.RULES)
) + """), y AS (SELECT doc_id, k, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM x),
z AS (SELECT y.doc_id, r.k, r.kind, r.base, coalesce(list_sum(list_transform(s[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS a, length(m[i]) AS n FROM y JOIN r USING (k) WHERE length(g[i]) >= r.least),
o AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, k) FILTER (base) AS b,
 string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, k) AS spans FROM z GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)"""

# states: 0 start, 1 system, 2 user, 3 assistant; a role outside the three is ''
ORACLE_SQL["op6_chat"] = r"""WITH RECURSIVE legal(b, a) AS (VALUES (0, 1), (0, 2), (1, 2), (2, 3), (3, 2)), names(a, name) AS (VALUES (1, 'system'), (2, 'user'), (3, 'assistant')), roles(r) AS (VALUES ('system'), ('user'), ('assistant'), ('')),
change AS (SELECT r, a, CASE WHEN r = name THEN 0 WHEN r = '' THEN 1 ELSE 3 END AS x, CASE WHEN r = name THEN '' ELSE 'relabel' END AS how FROM roles CROSS JOIN names),
moves AS (SELECT r, b, a, x AS c, CASE how WHEN '' THEN 'keep' ELSE how END AS act, 0 AS m FROM change JOIN legal USING (a)
 UNION ALL SELECT r, a, a, x + 1, CASE how WHEN '' THEN 'merge' ELSE how || '+merge' END, 0 FROM change
 UNION ALL SELECT r, p.b, q.a, x + 2, 'insert+' || CASE how WHEN '' THEN 'keep' ELSE how END, p.a FROM change JOIN legal q ON q.a = change.a JOIN legal p ON p.a = q.b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c, length(act), b, a, m) AS k FROM moves),
t AS (SELECT conv_id, turn, role, text, CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE '' END AS r,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 32) NULLS FIRST, left(text, 64) NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) - 1 AS n FROM conversations),
f(conv_id, n, s, cost, k) AS (SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), 0, 0, CAST(0 AS BIGINT) FROM t
 UNION ALL SELECT f.conv_id, f.n + 1, v.a, CAST(min(f.cost + v.c) AS INTEGER), arg_min(v.k, (f.cost + v.c) * 1000 + v.k) FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.n = f.n + 1 JOIN ranked v ON v.r = t.r AND v.b = f.s GROUP BY f.conv_id, f.n, v.a),
e AS (SELECT conv_id, max(n) AS n FROM t GROUP BY conv_id),
w(conv_id, n, s) AS (SELECT f.conv_id, f.n, arg_min(f.s, f.cost * 10 + f.s) FROM f JOIN e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.n = f.n GROUP BY f.conv_id, f.n
 UNION ALL SELECT w.conv_id, w.n - 1, v.b FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n AND f.s = w.s JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n JOIN ranked v ON v.r = t.r AND v.k = f.k WHERE w.n > 0),
o AS (SELECT t.*, v.a, v.c, v.act, v.m FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n AND f.s = w.s JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n JOIN ranked v ON v.r = t.r AND v.k = f.k)
SELECT conv_id, 2 * n AS piece, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS role_in, name AS role_out, 'insert' AS action, 2 AS cost, '<|' || name || '|>' || chr(10) || chr(10) AS rendered FROM o JOIN names ON names.a = o.m
UNION ALL SELECT conv_id, 2 * n + 1, turn, role, name, replace(act, 'insert+', ''), CASE WHEN m > 0 THEN c - 2 ELSE c END,
 CASE WHEN act LIKE '%merge' THEN '' ELSE '<|' || name || '|>' || chr(10) END || replace(coalesce(text, ''), '<|', '< |') || chr(10) FROM o JOIN names USING (a)"""
