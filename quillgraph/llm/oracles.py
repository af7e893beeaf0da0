"""DuckDB SQL for the queries that SQL can express.

The others need a tokenizer, XXH64 or a trained model, which SQL lacks; tests hold those against brute force.
"""

from __future__ import annotations

from .quality import DEPLETED_PERCENT, LINE_DOCS, LINE_PERCENT, MIN_WORDS, REPEAT_PERCENT
from .urls import ALIKE, BLOCK_ABOVE, CROWDED, NAME, NEUTRAL, REPEATS, RULES, SEGMENTS, SMOOTH, WILD

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT r, dw.k, i, item_id FROM dw JOIN bw ON bw.s = dw.s AND bw.k = dw.k),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""

_BLANK = "translate({}, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')"

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
x AS (SELECT r, doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w, list_filter(string_split(t, chr(10)), lambda v: length({_BLANK.format('v')}) > 0) AS ls FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM x WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g), (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY r),
base AS (SELECT x.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM x LEFT JOIN rep USING (r)),
ln AS (SELECT r, host, t, length({_BLANK.format('v')}) AS size, trim(regexp_replace(lower(v), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM (SELECT r, host, t, unnest(ls) AS v FROM x)),
fr AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM ln GROUP BY 1, 2) JOIN (SELECT host, count(DISTINCT t) AS a FROM d WHERE t <> '' GROUP BY 1) USING (host) WHERE n > {LINE_DOCS} AND 100 * n > {LINE_PERCENT} * a),
lost AS (SELECT r, sum(size) AS lost FROM ln JOIN fr USING (host, line) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f AS base_failed, NOT f AND NOT (100 * coalesce(lost, 0) > {DEPLETED_PERCENT} * word_chars) AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS f FROM base) LEFT JOIN lost USING (r)
"""

OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS low FROM w) WHERE doc_id > low),
isl AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(CASE WHEN p IS NULL OR i - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY r, k),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM isl),
kept AS (SELECT r, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, sum(b - a) AS gone, count(*) AS spans FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def _rule(column: str) -> str:
    cases = []
    for text, says in sorted(RULES, key=lambda r: -len(r[0])):
        name, _, rest = text.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{text if column == 'rule' else says}'")
    return f"CASE {' '.join(cases)} END"


def _shape(s: str) -> str:
    stem, end = rf"regexp_replace({s}, '\.[A-Za-z]{{2,5}}$', '')", rf"regexp_extract({s}, '(\.[A-Za-z]{{2,5}})$', 1)"
    return f"CASE WHEN regexp_matches({stem}, '^[0-9]+$') THEN '{{n}}' || {end} WHEN regexp_matches({stem}, '^[0-9A-Fa-f-]{{8,}}$') AND regexp_matches({stem}, '[0-9]') THEN '{{x}}' || {end} WHEN length({stem}) > 24 OR regexp_matches({stem}, '[0-9].*[0-9]') THEN '{{s}}' || {end} ELSE {s} END"


_LAST = f"array_to_string(list_slice(raw, {SEGMENTS}, len(raw)), '/')"
_SKELETON = rf"CASE WHEN regexp_matches(v, '{WILD}') THEN v ELSE '{NAME}' || regexp_extract(v, '(\.[A-Za-z]{{2,5}})$', 1) END"

OP3 = f"""
WITH RECURSIVE u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT r, page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM u),
ru AS (SELECT r, page_id, host, path, {_rule('rule')} AS rule, {_rule('says')} AS says, list_filter(string_split(path, '/'), lambda v: v <> '') AS raw FROM hp),
gs AS (SELECT r, page_id, host, path, rule, says, list_transform(CASE WHEN len(raw) > {SEGMENTS} THEN list_append(list_slice(raw, 1, {SEGMENTS - 1}), {_LAST}) ELSE raw END, lambda v: {_shape('v')}) AS seg FROM ru),
c AS (SELECT host, seg, count(*) AS n, count(*) FILTER (says = 'block') AS b, count(says) AS l FROM gs GROUP BY 1, 2),
tree AS (
    SELECT 0 AS k, host, seg, CAST([] AS VARCHAR[]) AS t, n, b, l FROM c
    UNION ALL
    SELECT k + 1, host, seg, list_append(t, CASE WHEN fan > {CROWDED} AND al < {REPEATS} * fan THEN '{{*}}' ELSE seg[k + 1] END), n, b, l
    FROM (SELECT *, count(DISTINCT seg[k + 1]) OVER (PARTITION BY host, t) AS fan, sum(n) OVER (PARTITION BY host, t) AS al FROM tree WHERE len(seg) > k)
),
te AS (SELECT host, seg, t, b, l FROM tree WHERE k = len(seg)),
lf AS (SELECT host, t, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(l) AS DOUBLE) AS l FROM te GROUP BY 1, 2),
lv AS (SELECT host, t, m, b, l, '/' || array_to_string(list_concat(list_slice(t, 1, m), list_slice(list_transform(t, lambda v: {_SKELETON}), m + 1, len(t))), '/') AS branch
    FROM (SELECT *, unnest(range(0, len(t) + 1)) AS m FROM lf) WHERE m = len(t) OR NOT regexp_matches(t[m + 1], '{WILD}')),
su AS (SELECT host, m, branch, sum(b) AS b, sum(l) AS l FROM lv GROUP BY 1, 2, 3),
ch AS (SELECT lv.host, lv.t, m, branch, su.l, (su.b + {SMOOTH * NEUTRAL}::DOUBLE) / (su.l + {SMOOTH}::DOUBLE) AS p, lag(su.b) OVER w AS b0, lag(su.l) OVER w AS l0
    FROM lv JOIN su USING (host, m, branch) WINDOW w AS (PARTITION BY lv.host, lv.t ORDER BY m DESC)),
ap AS (SELECT *, sum(CASE WHEN abs(b0 - p * l0) > {ALIKE}::DOUBLE * sqrt(p * (1 - p) * l0) THEN 1 ELSE 0 END) OVER (PARTITION BY host, t ORDER BY m DESC) AS apart FROM ch),
wi AS (SELECT host, t, arg_min(branch, m) AS branch, arg_min(p, m) AS p, arg_min(l, m) AS l FROM ap WHERE apart = 0 GROUP BY 1, 2)
SELECT page_id, gs.host, path, rule, coalesce(says, CASE WHEN p > {BLOCK_ABOVE} AND wi.l > 0 THEN 'block' ELSE 'allow' END) AS verdict, branch AS template, round(p, 6) AS purity
FROM gs JOIN te ON te.host = gs.host AND te.seg = gs.seg JOIN wi ON wi.host = te.host AND wi.t = te.t
"""

SQL: dict[str, str] = {"op3_url_filters": OP3, "op5_decontamination": OP5, "op7_quality_rules": OP7, "op9_suffix_dedup": OP9}
