"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from frailscope.llm import line_dedup
from frailscope.llm import quality_rules as rules
from frailscope.llm import secret_scan as secrets
from frailscope.llm import url_filters as urls

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quality_rules() -> str:
    common = ", ".join(f"'{w}'" for w in sorted({w for words in rules.COMMON_WORDS.values() for w in words}))
    languages = ", ".join(f"'{x}'" for x in rules.COMMON_WORDS)
    counts = ", ".join(
        f"length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS {c}" for c, p in rules.CLASSES.items()
    )
    total = " + ".join(rules.CLASSES)
    classes = [*rules.CLASSES, "other"]
    shares = ", ".join(f"{c} / word_chars::DOUBLE AS p_{c}" for c in classes)
    sums = ", ".join(f"sum({c})::DOUBLE / sum(word_chars) AS q_{c}" for c in classes)

    def part(x: str, m: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0 END / 2"

    def halved(p: str, q: str) -> str:
        return f"{part(p, f'({p} + {q}) / 2')} + {part(q, f'({p} + {q}) / 2')}"

    divergence = " + ".join(halved(f"p_{c}", f"q_{c}") for c in classes)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i + 4]) AS n FROM p),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY r),
h AS (SELECT r, lang, x, count(*) AS n FROM (SELECT r, lang, lower(unnest(ws)) AS x FROM w) WHERE x IN ({common}) GROUP BY ALL),
hn AS (SELECT r, sum(n) AS n_common FROM h GROUP BY r),
f AS (
  SELECT w.r, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(n_common, 0) AS n_common, {counts}
  FROM w LEFT JOIN rep USING (r) LEFT JOIN hn USING (r)),
f2 AS (SELECT *, word_chars - ({total}) AS other FROM f),
f3 AS (SELECT *, {shares} FROM f2),
cref AS (SELECT lang AS l, {sums} FROM f2 WHERE lang IN ({languages}) GROUP BY lang HAVING sum(word_chars) > 0),
cdist AS (SELECT r, min(round(sqrt(greatest({divergence}, 0)), 6)) AS class_distance
  FROM f3, cref WHERE n_words >= {rules.CLASS_WORDS} GROUP BY r),
langs AS (SELECT lang AS l, sum(n_words) AS total FROM f WHERE lang IN ({languages}) GROUP BY lang HAVING sum(word_chars) > 0),
wref AS (SELECT lang AS l, x, sum(n)::DOUBLE / any_value(total) AS q FROM h JOIN langs ON l = lang GROUP BY ALL),
known AS (SELECT l, coalesce(sum(q), 0) AS q FROM langs LEFT JOIN wref USING (l) GROUP BY l),
base AS (SELECT r, l, 1 - n_common / n_words::DOUBLE AS p, 1 - known.q AS q, known.q / 2 AS lacking
  FROM f, known WHERE n_words >= {rules.COMMON_WORDS_FROM}),
hp AS (SELECT b.r, b.l, h.n / n_words::DOUBLE AS p, coalesce(wref.q, 0) AS q
  FROM base b JOIN f USING (r) JOIN h USING (r) LEFT JOIN wref ON wref.l = b.l AND wref.x = h.x),
hs AS (SELECT r, l, sum({halved("p", "q")} - q / 2) AS js FROM hp GROUP BY ALL),
wl AS (SELECT r, l, lacking + {halved("p", "q")} + coalesce(js, 0) AS js FROM base LEFT JOIN hs USING (r, l)),
wdist AS (SELECT r, min(round(sqrt(greatest(js, 0)), 6)) AS word_distance FROM wl GROUP BY r),
j AS (SELECT f3.*, class_distance, word_distance,
    n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM f3 LEFT JOIN cdist USING (r) LEFT JOIN wdist USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, class_distance, word_distance,
  base_failed, NOT base_failed AND NOT coalesce(class_distance > {rules.CLASS_DISTANCE}, false)
    AND NOT coalesce(word_distance > {rules.WORD_DISTANCE}, false) AS kept
FROM j"""


def _line_dedup() -> str:
    least = line_dedup.MIN_WORDS
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
a AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY pos) AS i,
    len(regexp_extract_all(line, '[^ 	-
]+')) AS words
  FROM a WHERE regexp_matches(line, '[^ 	-
]')),
c AS (SELECT *, sum(words) OVER (PARTITION BY r ORDER BY i) AS stop FROM l),
s AS (SELECT x.r, x.i AS first, min(y.i) AS last FROM c x JOIN c y ON x.r = y.r AND y.i BETWEEN x.i AND x.i + {least} - 1
    AND y.stop - x.stop + x.words >= {least} GROUP BY ALL
  UNION
  SELECT y.r, max(x.i) AS first, y.i AS last FROM c x JOIN c y ON x.r = y.r AND x.i BETWEEN y.i - {least} + 1 AND y.i
    AND y.stop - x.stop + x.words >= {least} GROUP BY ALL),
n AS (SELECT s.r, s.first, s.last, any_value(c.doc_id) AS doc_id, string_agg(line, chr(10) ORDER BY i) AS run
  FROM s JOIN c ON c.r = s.r AND c.i BETWEEN s.first AND s.last GROUP BY s.r, s.first, s.last),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS copy FROM n),
g AS (SELECT DISTINCT c.r, c.pos FROM f JOIN c ON c.r = f.r AND c.i BETWEEN f.first AND f.last WHERE copy > 1),
k AS (SELECT a.r, string_agg(line, chr(10) ORDER BY a.pos) FILTER (WHERE g.r IS NULL) AS kept, count(g.r) AS n_deleted,
    count(*) FILTER (WHERE regexp_matches(line, '[^ 	-
]')) AS n_lines
  FROM a LEFT JOIN g ON g.r = a.r AND g.pos = a.pos GROUP BY a.r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
  sha256(coalesce(kept, '')) AS text_sha256
FROM d LEFT JOIN k USING (r)"""


def _secret_scan() -> str:
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.LONG_HEX, "token": secrets.TOKEN}
    parts = []
    for order, (kind, pattern) in enumerate(patterns.items()):
        quoted = pattern.replace("'", "''")
        value = f"regexp_extract(m, '^(?:{quoted})$', 2)" if kind == "assign" else "m"
        parts.append(
            f"SELECT r, '{kind}' AS kind, {order} AS o, s AS start, s + length(m) AS stop, {value} AS value FROM ("
            "SELECT r, m, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS s FROM ("
            f"SELECT r, unnest(ms) AS m, unnest(gaps) AS gap, unnest(range(len(ms))) AS i FROM ("
            f"SELECT r, regexp_extract_all(t, '{quoted}') AS ms,"
            f" regexp_split_to_array(t, '{quoted}')[1:len(regexp_extract_all(t, '{quoted}'))] AS gaps FROM d)))"
            f" WHERE length({value}) >= {secrets.LEAST[kind]}"
        )
    union = " UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
a AS ({union}),
base AS (SELECT * FROM a WHERE kind <> 'token'),
tok AS (SELECT * FROM a WHERE kind = 'token' AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
  AND regexp_matches(value, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.start < a.stop AND a.start < b.stop)),
c AS (SELECT x.*, coalesce(d.source, '') AS owner, coalesce(d.doc_id::VARCHAR, '') AS repository FROM (SELECT * FROM base UNION ALL SELECT * FROM tok) x JOIN d USING (r)),
counts AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM c GROUP BY value),
own AS (SELECT *, owners <= {secrets.MAX_OWNERS} AND repositories <= {secrets.MAX_REPOSITORIES} * owners AS live FROM counts),
k AS (SELECT c.*, live, owners, repositories, kind || ':' || start || ':' || stop AS shown FROM c JOIN own USING (value)),
s AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(shown, ',' ORDER BY start, o, stop) FILTER (WHERE kind <> 'token') AS base,
    string_agg(shown, ',' ORDER BY start, o, stop) FILTER (WHERE kind <> 'token' OR live) AS spans,
    count(*) FILTER (WHERE kind = 'token' AND live) AS n_added, count(*) FILTER (WHERE live) AS n_live,
    count(*) FILTER (WHERE NOT live) AS n_examples, max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_added, 0)::BIGINT AS n_added, coalesce(n_live, 0)::BIGINT AS n_live,
  coalesce(n_examples, 0)::BIGINT AS n_examples, coalesce(most_owners, 0)::BIGINT AS most_owners,
  coalesce(most_repositories, 0)::BIGINT AS most_repositories
FROM d LEFT JOIN s USING (r)"""


_SQL_ROUNDS = 160


def _spread(name: str, links: str, seeds: str) -> str:
    """The ranks ``name`` (host, rank) after so many rounds that they do not change any more; host * restarts."""
    damping = urls.DAMPING
    return f"""
{name}_s AS (SELECT host, count(*)::DOUBLE / sum(count(*)) OVER () AS start FROM p WHERE own = '{seeds}' AND host <> '' GROUP BY host),
{name}_w AS (SELECT source, target, {damping} * links::DOUBLE / sum(links) OVER (PARTITION BY source) AS w FROM ({links})
  UNION ALL SELECT '*', host, (1 - {damping}) * start FROM {name}_s UNION ALL SELECT '*', '*', 1.0::DOUBLE),
{name}_r(round, host, rank) AS (
  (SELECT 0, host, start FROM {name}_s UNION ALL SELECT 0, '*', 1.0::DOUBLE)
  UNION ALL
  SELECT round + 1, target, sum(rank * w) FROM {name}_r JOIN {name}_w ON host = source WHERE round < {_SQL_ROUNDS} GROUP BY round, target),
{name} AS (SELECT host, rank / sum(rank) OVER () AS rank FROM {name}_r WHERE round = {_SQL_ROUNDS} AND host <> '*')"""


def _url_filter() -> str:
    fits = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN "
        for r in sorted(urls.RULES, key=lambda r: (-len(r.name), r.name))
    ]
    rules = sorted(urls.RULES, key=lambda r: (-len(r.name), r.name))
    name = " ".join(f"{f}'{r.name}'" for f, r in zip(fits, rules, strict=True))
    own = " ".join(f"{f}'{r.verdict}'" for f, r in zip(fits, rules, strict=True))
    lower = f"translate({{}}, '{urls._LETTERS[0]}', '{urls._LETTERS[1]}')"
    host = "coalesce(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), '')"
    href = urls._HREF.replace("'", "''")
    forward, back = "SELECT source, target, links FROM links", "SELECT target AS source, source AS target, links FROM links"
    suffixes = ", ".join(f"'{x}'" for x in urls.PUBLIC_SUFFIXES)
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, html, {lower.format(host.format("url"))} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT *, CASE {name} END AS rule, CASE {own} END AS own FROM u),
hosts AS (SELECT DISTINCT host FROM p WHERE host <> ''),
h AS (SELECT host AS source, {lower.format(host.format("x"))} AS target
  FROM (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS x FROM p WHERE host <> '')),
chains AS (SELECT list_filter(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')),
    lambda x: contains(x, '.') AND x NOT IN ({suffixes})) AS names
  FROM (SELECT string_split(host, '.') AS labels FROM hosts WHERE NOT regexp_full_match(host, '[0-9.]+(:[0-9]*)?'))),
steps AS (SELECT names[i] AS child, names[i + 1] AS parent FROM (SELECT names, unnest(range(1, len(names))) AS i FROM chains)),
parents AS (SELECT DISTINCT child AS source, parent AS target FROM steps UNION SELECT parent, child FROM steps),
links AS (SELECT source, target, sum(n) AS links FROM (
    SELECT source, target, count(*) AS n FROM h WHERE target <> '' AND source <> target GROUP BY ALL
    UNION ALL SELECT source, target, 1 FROM parents) GROUP BY ALL),
{_spread("trust", forward, "allow")},
{_spread("distrust", back, "block")},
seeds AS (SELECT count(DISTINCT host) AS n FROM p WHERE own = 'block' AND host <> ''),
j AS (SELECT p.*, coalesce(t.rank, 0) AS trust, coalesce(d.rank, 0) AS distrust
  FROM p LEFT JOIN trust t USING (host) LEFT JOIN distrust d USING (host))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN distrust * n > {urls.MIN_DISTRUST}
    AND distrust > trust * (1 + {urls._EQUAL}) THEN 'block' ELSE 'allow' END) AS verdict,
  round(trust, 6) AS trust, round(distrust, 6) AS distrust
FROM j, seeds"""


def _prefix_trie() -> str:
    return r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
o AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, ts, conv_id - ((conv_id % 20) + 20) % 20 AS base,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM o, crc),
b AS (
  SELECT h.conv_id, list_concat(CASE WHEN f.ts IS NULL OR h = 0 THEN [] ELSE f.ts[1:h] END, h.ts[h + 1:]) AS ts
  FROM h LEFT JOIN o f ON f.conv_id = h.base),
p AS (SELECT conv_id, ts, len(ts) AS n, unnest(generate_series(0, len(ts))) AS depth FROM b),
v AS (
  SELECT depth, ts[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY ALL),
c AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
k AS (
  SELECT v.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].x, '[^\x20\x09-\x0D]+')) END AS words
  FROM v LEFT JOIN c USING (depth, path)),
up AS (
  SELECT path[1:d] AS path, d AS depth, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM k) GROUP BY ALL)
SELECT k.conv_id, k.depth, a.conv_id AS parent_conv_id, k.n_convs, k.n_children, up.n_leaves::BIGINT AS n_leaves,
  up.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN up ON up.depth = k.depth AND up.path = k.path
LEFT JOIN k a ON a.depth = k.depth - 1 AND a.path = k.path[1:k.depth - 1]"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_divergence_quality_rules": _quality_rules(),
        "op7_suffix_array_line_dedup": _line_dedup(),
        "op8_link_graph_url_filter": _url_filter(),
        "op9_ownership_secret_scan": _secret_scan(),
        "op11_conversation_prefix_trie": _prefix_trie(),
    }
