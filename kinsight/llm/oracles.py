"""DuckDB SQL for those contract queries that SQL can express."""

from __future__ import annotations

from kinsight.llm.common import LOWER, UPPER
from kinsight.llm.secret_scan import BASE_RULES, MORE_RULES

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{_WORDS}')"


# The oracle's own list of public suffixes of two labels.
_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp com.br com.cn com.mx co.in co.za com.tr"


def _two_labels() -> str:
    return "(" + ", ".join(f"'{s}'" for s in _SUFFIXES.split()) + ")"


def _moments() -> str:
    excess = "(sum(pow(bad - n * m, 2) / (n * m * (1 - m))) - count(*))"
    return f"coalesce(CASE WHEN {excess} > 0 THEN least(greatest(sum(n - 1) / {excess} - 1, 1.0), 1000.0) END, 1000.0)"


OP3 = f"""WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  TRY_CAST(regexp_extract(url, '^.*?://[^/?#]*/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id FROM pages),
o AS (SELECT host, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM p JOIN labels USING (doc_id) GROUP BY host),
h AS (SELECT x.host, string_split(x.host, '.') AS parts, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM (SELECT DISTINCT host FROM p WHERE host <> '') x LEFT JOIN o USING (host)),
c AS (SELECT host, n, bad, array_to_string(parts[-2:], '.') IN {_two_labels()} AS two, array_to_string(parts[-2:], '.') AS d2, array_to_string(parts[-3:], '.') AS d3, parts[-1] AS s1 FROM h),
k AS (SELECT host, n, bad, CASE WHEN two THEN d3 ELSE d2 END AS domain, CASE WHEN two THEN d2 ELSE s1 END AS suffix FROM c),
t AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS rate FROM k),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS m FROM k, t GROUP BY suffix), sk AS (SELECT {_moments()} AS kappa FROM s0 WHERE n > 0),
sr AS (SELECT suffix, (bad + kappa * m) / (n + kappa) AS srate FROM s0, sk),
d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(srate) AS m FROM k JOIN sr USING (suffix) GROUP BY domain), dk AS (SELECT {_moments()} AS kappa FROM d0 WHERE n > 0),
dr AS (SELECT domain, (bad + kappa * m) / (n + kappa) AS drate FROM d0, dk),
h0 AS (SELECT host, n, bad, drate AS m FROM k JOIN dr USING (domain)), hk AS (SELECT {_moments()} AS kappa FROM h0 WHERE n > 0),
hr AS (SELECT host, n, kappa, (bad + kappa * m) / (n + kappa) AS m FROM h0, hk),
b AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (n + kappa + 1)) > rate AS blocked FROM hr, t),
r AS (SELECT page_id, host, path, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict FROM r LEFT JOIN b USING (host)"""

OP5 = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words('text')} AS w FROM benchmark),
w AS (SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda k: w[k : k + 9]) END) AS win FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents), ls AS (SELECT DISTINCT len(win) AS l FROM w),
places AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS k, w FROM d, ls WHERE len(w) >= l),
hit AS (SELECT DISTINCT doc_id, k, l, item_id FROM places JOIN w ON w.win = places.w[k : k + l - 1]),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP6 = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, list_transform(x, lambda y: floor(64 * y)) AS f FROM e WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.f, c.f) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _op7() -> str:
    parts = []
    for k, r in enumerate(BASE_RULES + MORE_RULES):
        rx = r.regex.replace("'", "''")
        parts.append(f"""SELECT row, {k} AS rule, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(p[:len(m)], lambda x: length(x))) AS gap, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(g, lambda x: length(x) >= {r.least})) AS counts
  FROM (SELECT row, regexp_split_to_array(text, '{rx}') AS p, regexp_extract_all(text, '{rx}', 0) AS m, regexp_extract_all(text, '{rx}', {r.group}) AS g FROM d)""")
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, sum(gap + n) OVER (PARTITION BY row, rule ORDER BY i) AS stop FROM f),
s AS (SELECT row, rule, stop - n AS start, kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM e WHERE counts),
a AS (SELECT row, count(CASE WHEN rule = 0 THEN 1 END) AS n_assign, count(CASE WHEN rule = 1 THEN 1 END) AS n_access, count(CASE WHEN rule = 2 THEN 1 END) AS n_hex, string_agg(span, ',' ORDER BY start, rule) AS spans, string_agg(span, ',' ORDER BY start, rule) FILTER (WHERE rule < {len(BASE_RULES)}) AS base FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)"""


ORACLES = {"op3_host_reputation": OP3, "op5_decontaminate": OP5, "op6_exact_topk": OP6, "op7_secret_scan": _op7()}
