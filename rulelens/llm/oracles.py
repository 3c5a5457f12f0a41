"""The operators that SQL can express, as DuckDB SQL over whole tables."""

from __future__ import annotations

from rulelens.llm import lexical_search as ls
from rulelens.llm import line_quality as lq
from rulelens.llm.secret_ledger import BASE, RULES
from rulelens.llm.url_lists import ENTRY_RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


UPPER, TERM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANK, NOT_BLANK = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"

LINE_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT r, [x for x in regexp_split_to_array(t, '{BLANK}') if x <> ''] AS ws FROM d),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
split AS (SELECT r, host, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, host, string_split(t, chr(10)) AS ls FROM d)),
lines AS (SELECT r, host, i, ls[i] AS line FROM split WHERE regexp_matches(ls[i], '{NOT_BLANK}')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
folded AS (SELECT r, host, i, trim(regexp_replace(translate(line, '{lq._UPPER_DIGITS}', '{lq._LOWER_NOUGHTS}'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), ' ') AS x FROM lines),
counted AS (SELECT r, host, i, x, length(x) - length(replace(x, ' ', '')) + 1 AS n FROM folded WHERE x <> ''),
owns AS (SELECT r, md5(string_agg(x, chr(10) ORDER BY i)) AS own FROM counted GROUP BY r),
told AS (SELECT counted.r, host, x, n, own FROM counted JOIN owns USING (r)),
sizes AS (SELECT host, count(DISTINCT own) AS total FROM told GROUP BY host),
common AS (
  SELECT host, x FROM (SELECT host, x, count(DISTINCT own) AS c FROM told GROUP BY host, x) JOIN sizes USING (host)
  WHERE c > {lq.MAX_DOCUMENTS} AND c > {lq.MAX_SHARE} * total
),
removed AS (SELECT r, sum(n) AS n FROM told JOIN common USING (host, x) GROUP BY r),
base AS (
  SELECT d.r, doc_id, len(ws) AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{lq.SYMBOLS}', '')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
  FROM d JOIN w ON d.r = w.r LEFT JOIN dups ON d.r = dups.r LEFT JOIN covered ON d.r = covered.r LEFT JOIN removed ON d.r = removed.r
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words,
  (n_words < {lq.LEAST_WORDS} OR 100 * n_repeat_words > {lq.MOST_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {lq.LEAST_WORDS} OR 100 * n_repeat_words > {lq.MOST_REPEATED} * n_words) AND 100 * n_removed_words <= {lq.MAX_REMOVED} * n_words AS kept
FROM base
"""


def _url_lists() -> str:
    picks = " UNION ".join(
        f"SELECT '{name}' AS list, {str(allows).lower()} AS allows, '{kind}' AS kind, {value} AS value, '{action}' AS action, DATE '2024-01-01' + CAST({days} AS INTEGER) AS dated FROM named WHERE {chosen}"
        for name, allows, kind, value, chosen, action, days in ENTRY_RULES
    )
    return f"""
WITH pages_at AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched FROM pages),
plain AS (SELECT DISTINCT url, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS p FROM pages_at WHERE url IS NOT NULL),
places AS (
  SELECT url, lower(regexp_replace(regexp_extract(p, '^(?:[^/]*@)?([^/:]*)', 1), '\\.+$', ''))
    || regexp_replace(regexp_extract(p, '^[^/]*(/.*)$', 1), '/+$', '') AS place FROM plain
),
cut AS (SELECT url, string_split(place, '/') AS parts, string_split(string_split(place, '/')[1], '.') AS labels FROM places),
named AS (
  SELECT DISTINCT parts[1] AS host, regexp_replace(parts[1], '^[^.]*\\.', '') AS parent, array_to_string(parts[1:2], '/') AS section,
    CAST('0x' || substr(md5(parts[1]), 1, 6) AS BIGINT) AS n FROM cut
),
entries AS ({picks}),
daily AS (SELECT list, allows, kind, value, dated, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS gone FROM entries GROUP BY ALL),
changed AS (SELECT * FROM (SELECT *, lag(gone) OVER (PARTITION BY list, allows, kind, value ORDER BY dated) AS before FROM daily) WHERE before IS NULL OR before <> gone),
valid AS (SELECT * FROM (SELECT *, lead(dated) OVER (PARTITION BY list, allows, kind, value ORDER BY dated) AS until FROM changed) WHERE gone = 0),
asked AS (
  SELECT DISTINCT url, kind, value FROM (
    SELECT url, 'domain' AS kind, array_to_string(labels[i:], '.') AS value FROM (SELECT url, labels, unnest(range(1, len(labels) + 1)) AS i FROM cut)
    UNION ALL SELECT url, 'prefix' AS kind, array_to_string(parts[1:i], '/') AS value FROM (SELECT url, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)
  )
),
active AS (
  SELECT DISTINCT c.url, c.fetched, v.list, v.allows, v.kind, v.value FROM (SELECT DISTINCT url, fetched FROM pages_at) c JOIN asked a ON c.url = a.url
  JOIN valid v ON a.kind = v.kind AND a.value = v.value AND c.fetched >= v.dated AND (v.until IS NULL OR c.fetched < v.until)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY url, fetched ORDER BY length(value) DESC, allows, value DESC) AS k FROM active),
verdicts AS (
  SELECT url, fetched, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
    max(CASE WHEN k = 1 THEN value END) AS decided_by, bool_or(k = 1 AND allows) AS allowed FROM ranked GROUP BY url, fetched
)
SELECT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists,
  coalesce(decided_by, '') AS decided_by, coalesce(allowed, true) AS kept
FROM pages_at p LEFT JOIN verdicts v ON p.url = v.url AND p.fetched = v.fetched
"""


def _secrets() -> str:
    found = " UNION ALL ".join(
        f"""SELECT r, {order} AS o, '{rule.kind}' AS kind, {rule.least} AS least, regexp_split_to_array(t, {_text(rule.pattern)}) AS gaps,
      regexp_extract_all(t, {_text(rule.pattern)}) AS ms, regexp_extract_all(t, {_text(rule.pattern)}, {rule.group}) AS gs FROM d WHERE regexp_matches(t, {_text(rule.pattern)})"""
        for order, rule in enumerate(RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    spans = "kind || ':' || s || ':' || e, ',' ORDER BY s, o"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
numbered AS (SELECT r, o, kind, least, i, length(gaps[i]) AS gap, length(ms[i]) AS size, length(gs[i]) AS secret FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found)),
ended AS (SELECT *, CAST(sum(gap + size) OVER (PARTITION BY r, o ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM numbered),
spans AS (SELECT r, o, kind, e - size AS s, e FROM ended WHERE secret >= least),
joined AS (
  SELECT r, count(*) AS n, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg({spans}) AS every, string_agg({spans}) FILTER (WHERE kind IN ({base})) AS base FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(n, 0) AS n_spans
FROM d LEFT JOIN joined USING (r)
"""


def _search() -> str:
    terms = rf"[x for x in regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}') if x <> '']"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM documents),
sizes AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
asked AS (SELECT q, item_id, unnest(list_distinct(ts)) AS t FROM (SELECT row_number() OVER () AS q, item_id, {terms} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark))),
counts AS (SELECT r, n, t, count(*) AS tf FROM (SELECT r, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT n FROM sizes) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts GROUP BY t),
gains AS (
  SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * counts.n * sizes.n) // sizes.l))) AS g
  FROM counts JOIN weights USING (t) CROSS JOIN sizes
),
scores AS (SELECT q, item_id, r, CAST(sum(g) AS BIGINT) AS score FROM asked JOIN gains USING (t) GROUP BY ALL HAVING sum(g) > 0),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores JOIN d USING (r))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {ls.TOP}
"""


def _trie() -> str:
    """CRC-32 bit by bit (its reversed polynomial is 3988292384); nodes are compared as lists of turns."""
    step = "list_reduce([xor(a, b)] || [CAST(0 AS BIGINT) for i in range(8)], lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    return f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'role': role, 'x': x}} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || x)) AS ts FROM t GROUP BY c),
bytes AS (SELECT c, ts, [CAST(4294967295 AS BIGINT)] || [CAST(ascii(d) AS BIGINT) for d in string_split(CAST(c AS VARCHAR), '')] AS b FROM own),
n AS (SELECT c, ts, c - c % 100 AS base, xor(list_reduce(b, lambda a, b: {step}), 4294967295) % 6 AS h FROM bytes),
rebuilt AS (SELECT n.c, coalesce(own.ts[1:h], []) || n.ts[h + 1:] AS ts FROM n LEFT JOIN own ON n.base = own.c),
prefixes AS (SELECT c, d, ts[1:d] AS p, len(ts) = d AS ends FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d
),
edges AS (SELECT child.p, child.conv_id, parent.p AS above, parent.conv_id AS parent_conv_id FROM nodes child JOIN nodes parent ON child.d > 0 AND parent.d = child.d - 1 AND child.p[1:child.d - 1] = parent.p),
children AS (SELECT above AS p, count(*) AS n_children FROM edges GROUP BY above),
measured AS (SELECT nodes.p, d, (n_convs - 1) * coalesce(length(nodes.p[d].x), 0) AS saving, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes LEFT JOIN children ON nodes.p = children.p),
sums AS (SELECT p, sum(leaf) AS n_leaves, sum(saving) AS saved_tokens FROM (SELECT m.p[1:k] AS p, leaf, saving FROM (SELECT *, unnest(range(d + 1)) AS k FROM measured) m) GROUP BY p)
SELECT nodes.conv_id, nodes.d AS depth, edges.parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes JOIN sums ON nodes.p = sums.p LEFT JOIN children ON nodes.p = children.p LEFT JOIN edges ON nodes.p = edges.p
"""


ORACLES = {"op2_url_lists": _url_lists(), "op3_line_quality": LINE_QUALITY, "op8_secret_ledger": _secrets(), "op12_hybrid_search": _search(), "op13_conversation_trie": _trie()}
