"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from tessella.llm.licenses import PHRASES, SLACK, TEMPLATES
from tessella.llm.secrets import KINDS, OWNERS, REPOS

_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _texts(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


OP10 = rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_APART}'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_APART}'), lambda w: w <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d),
bw AS (SELECT item_id, least(5, len(w)) AS k, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM b),
dg AS (SELECT doc_id, p, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s, lead(x, 4) OVER o AS last FROM dw WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
bg AS (SELECT item_id, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s, lead(x, 4) OVER o AS last FROM bw WHERE k = 5 WINDOW o AS (PARTITION BY item_id ORDER BY p)),
u AS (SELECT DISTINCT item_id, s FROM bg WHERE last IS NOT NULL), n AS (SELECT item_id, count(*) AS n FROM u GROUP BY 1),
m AS (SELECT doc_id, item_id, count(DISTINCT dg.s) AS c, min(p) AS a, max(p) + 4 AS z FROM dg JOIN u ON dg.s = u.s WHERE dg.last IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, c AS n_matched, c / n AS containment, a AS first_word, z AS last_word FROM m JOIN n USING (item_id) WHERE c >= 0.8 * n - 1e-9"""

def _op9(most: int = 20_480) -> str:
    """Words go by windows of 20; a longer window is told by the numbers of its two halves, up to `most` words."""
    length, levels = 20, []
    while 2 * length <= most:
        n = 2 * length
        levels.append(f"""e{n} AS (SELECT a.doc_id, a.p, a.g AS x, b.g AS y FROM f{length} a JOIN f{length} b ON a.doc_id = b.doc_id AND b.p = a.p + {length} WHERE a.n > 1 AND b.n > 1),
f{n} AS (SELECT doc_id, p, dense_rank() OVER (ORDER BY x, y) AS g, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, p) AS r, count(*) OVER (PARTITION BY x, y) AS n FROM e{n}),""")
        length = n
    reach = " UNION ALL ".join(f"SELECT doc_id, {20 << k} AS length FROM f{20 << k} WHERE r > 1" for k in range(len(levels) + 1))
    return rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d),
k AS (SELECT doc_id, p, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k, lead(p, 19) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM p),
f20 AS (SELECT doc_id, p, dense_rank() OVER (ORDER BY k) AS g, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r, count(*) OVER (PARTITION BY k) AS n FROM k WHERE last IS NOT NULL),
{"".join(levels)}
l AS (SELECT doc_id, max(length) AS longest FROM ({reach}) u GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM f20 WHERE r > 1),
s AS (SELECT p.doc_id, count(g.p) AS n, string_agg(x, ' ' ORDER BY p.p) FILTER (WHERE g.p IS NULL) AS t FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, CAST(coalesce(longest, 0) AS BIGINT) AS longest, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)"""


def _op4() -> str:
    phrases = [(label, p.split()) for p, label in PHRASES.items()]
    at = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, i FROM (SELECT doc_id, w, unnest(range(len(w) - {len(p) - 1})) AS i FROM d WHERE list_contains(w, '{p[0]}') AND list_contains(w, '{p[-1]}')) u WHERE w[i + 1:i + {len(p)}] = {_texts(p)}" for label, p in phrases)
    shares = []
    for label, must, t in TEMPLATES:
        own, span = sorted(set(t.split())), math.ceil(SLACK * len(t.split()))
        least, must = -(-8 * len(own) // 10), f" AND list_has_all(b, {_texts(must.split())})" if must else ""
        blocks = f"SELECT doc_id, w[i + 1:i + {span}] AS b FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d WHERE len(list_intersect(w, {_texts(own)})) >= {least}) u"
        shares.append(f"SELECT doc_id, '{label}' AS label, max(len(list_intersect(b, {_texts(own)}))) / {len(own)} AS share FROM ({blocks}) v WHERE TRUE{must} GROUP BY 1")
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_APART}'), lambda w: w <> '') AS w FROM documents),
a AS ({at}), b AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM a GROUP BY 1),
s AS ({' UNION ALL '.join(shares)}), c AS (SELECT doc_id, label, share FROM s WHERE share >= 0.8 - 1e-9),
e AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM a UNION ALL SELECT doc_id, label FROM c) u GROUP BY 1), x AS (SELECT doc_id, max(share) AS share FROM c GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.f AS first_word, b.l AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
CASE WHEN b.n > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(coalesce(x.share, 0) AS DOUBLE) END AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN x USING (doc_id)"""


def _op8() -> str:
    kinds = [*((k, p, n, g) for k, p, n, g in KINDS), ("opaque", "[A-Za-z0-9+/_-]+", 20, 0)]
    found = []
    for rank, (kind, pattern, least, group) in enumerate(kinds):
        q = pattern.replace("'", "''")
        found.append(f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(string_split_regex(t, '{q}')) AS gap, unnest(regexp_extract_all(t, '{q}', 0)) AS m, unnest(regexp_extract_all(t, '{q}', {group})) AS v, generate_subscripts(string_split_regex(t, '{q}'), 1) AS k, {least} AS least FROM d WHERE regexp_matches(t, '{q}')")
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
r AS ({' UNION ALL '.join(found)}), e AS (SELECT *, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, rank ORDER BY k) AS z FROM r),
s AS (SELECT doc_id, rank, kind, CAST(z - length(m) AS BIGINT) AS a, CAST(z AS BIGINT) AS z, v FROM e WHERE m IS NOT NULL AND length(v) >= least AND (kind <> 'opaque' OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))),
own AS (SELECT v, count(DISTINCT owner) <= {OWNERS} AND count(DISTINCT concat(owner, chr(1), repo)) <= {REPOS} AS live FROM s JOIN d USING (doc_id) GROUP BY v),
al AS (SELECT o.*, live FROM s o JOIN own USING (v) WHERE kind <> 'opaque' OR (live AND NOT EXISTS (SELECT 1 FROM s b WHERE b.kind <> 'opaque' AND b.doc_id = o.doc_id AND b.a <= o.a AND b.z >= o.z))),
b AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n0, count(*) FILTER (WHERE rank = 1) AS n1, count(*) FILTER (WHERE rank = 2) AS n2, string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, rank) FILTER (WHERE kind <> 'opaque') AS x,
string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, rank) AS y, string_agg(CASE WHEN live THEN 'live' ELSE 'copied' END, ',' ORDER BY a, rank) AS c, count(*) FILTER (WHERE live) AS nl, count(*) FILTER (WHERE NOT live) AS nc FROM al GROUP BY 1)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(x, '')) AS base_sha256, coalesce(y, '') AS spans, coalesce(c, '') AS classes, coalesce(nl, 0) AS n_live, coalesce(nc, 0) AS n_copied FROM d LEFT JOIN b USING (doc_id)"""


ORACLE = {"op4_licenses": _op4(), "op8_secrets": _op8(), "op9_substrings": _op9(), "op10_decontamination": OP10}
