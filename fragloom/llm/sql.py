"""SQL of those queries of this package that SQL can express, for an engine that has the tables as views."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def url_filter(rules: list[tuple[str, str, str]], sites: list[str]) -> str:
    """The rules that fit are found by comparing hosts and paths; the canonical form is worked out step by step."""
    shown = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    unreserved = "^(?:2[DEde]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])"
    decoded = lambda c: f"""array_to_string(list_transform(string_split({c}, '%'), lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '{unreserved}') THEN chr(CAST('0x' || x[1:2] AS INTEGER)) || x[3:]
    WHEN regexp_matches(x, '^[0-9A-Fa-f]{{2}}') THEN '%' || upper(x[1:2]) || x[3:] ELSE '%' || x END), '')"""  # noqa: E731
    return f"""WITH rules(host, path, verdict) AS (VALUES {shown}),
r0 AS (SELECT page_id, row_number() OVER () AS rid, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r1 AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM r0),
u AS (SELECT page_id, rid, scheme, raw, {lowered("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
  list_filter(string_split(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[A-Za-z]+|gclid|fbclid|msclkid)(?:=|$)')) AS params FROM r1),
c0 AS (SELECT rid, scheme, {lowered("regexp_replace(raw, '^.*@', '')")} AS server, {decoded("CASE WHEN path = '' THEN '/' ELSE path END")} AS path, {decoded("array_to_string(params, '&')")} AS query FROM u),
c1 AS (SELECT *, regexp_replace(regexp_extract(server, '^(\\[[^\\]]*\\]|[^:]*)', 1), '\\.+$', '') AS name, regexp_replace(regexp_extract(server, ':([0-9]*)$', 1), '^0+', '') AS port, string_split(substr(path || CASE WHEN regexp_matches(path, '/\\.{{1,2}}$') THEN '/' ELSE '' END, 2), '/') AS steps FROM c0),
c2 AS (SELECT rid, name, name || CASE WHEN port = '' OR port = CASE scheme WHEN 'http' THEN '80' WHEN 'https' THEN '443' ELSE '' END THEN '' ELSE ':' || port END
  || CASE WHEN contains(path, '/.') THEN array_to_string(list_reduce(list_prepend([''], list_transform(steps, lambda x: [x])), lambda a, x: CASE x[1] WHEN '.' THEN a WHEN '..' THEN a[1:greatest(1, len(a) - 1)] ELSE list_concat(a, x) END), '/') ELSE path END
  || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM c1 WHERE name <> ''),
listing AS (SELECT DISTINCT canonical FROM c2 WHERE list_has_any(string_split(name, '.'), {sites!r})),
b AS (SELECT u.rid, arg_max(struct_pack(key := r.host || r.path, verdict := r.verdict), length(r.host || r.path) * 1000 + length(r.host)) AS hit
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) WHERE u.host <> '' GROUP BY u.rid),
l AS (SELECT rid, canonical FROM c2 JOIN listing USING (canonical))
SELECT page_id, host, path, b.hit.key AS rule, coalesce(b.hit.verdict, CASE WHEN l.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN b.hit IS NULL THEN l.canonical END AS listed
FROM u LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)"""


def decontaminate(window: int = 10) -> str:
    def words(table: str, key: str) -> str:
        return f"SELECT row_number() OVER () AS rid, {key}, coalesce(regexp_extract_all({lowered('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM {table}"

    return f"""WITH d AS ({words("documents", "doc_id")}), i AS ({words("benchmark", "item_id")}),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS t FROM (SELECT item_id, w, least({window}, len(w)) AS n FROM i WHERE len(w) > 0), unnest(range(len(w) - n + 1)) u(s)),
dw AS (SELECT rid, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS t FROM d, (SELECT DISTINCT n FROM iw), unnest(range(len(w) - n + 1)) u(s) WHERE len(w) >= n),
hit AS (SELECT DISTINCT rid, s, n, item_id FROM dw JOIN iw USING (n, t)),
pos AS (SELECT rid, count(DISTINCT s + k) AS n_hit FROM hit, unnest(range(n)) u(k) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""


def near_duplicates(width: int = 3, percent: int = 85) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({lowered("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s + 1, s + n), ' ') AS t FROM (SELECT *, least({width}, len(w)) AS n FROM d WHERE len(w) > 0), unnest(range(len(w) - n + 1)) u(s)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * m >= {percent} * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN sz USING (doc_id)"""


def quality_rules() -> str:
    word = "'[^\\x20\\x09-\\x0D]+'"
    count = lambda what: f"(length(line) - length(replace(line, '{what}', ''))) // {len(what)}"
    symbols = lambda column: f"length({column}) - length(regexp_replace({column}, '[#*$%&|<>]', '', 'g'))"
    phrases = "(?i)\\b(?:cookie policy|use cookies|terms of (?:use|service)|privacy policy|all rights reserved|click here|read more|sign (?:in|up)|log ?in|subscribe|enable javascript|share this|skip to content|lorem ipsum)\\b"
    upper = "[\\p{Lu}\\x{2160}-\\x{216F}\\x{24B6}-\\x{24CF}\\x{1F130}-\\x{1F149}\\x{1F150}-\\x{1F169}\\x{1F170}-\\x{1F189}]"
    fault = f"""again OR {count("|")} >= 3 OR {count(">")} >= 3 OR {count(" » ")} >= 2 OR ({symbols("line")}) * 10 > length(line) OR {count("!!")} >= 3 OR {count("??")} >= 3
    OR (n >= 8 AND len(list_distinct(w)) * 4 < n)
    OR (length(line) >= 20 AND (length(line) - length(regexp_replace(line, '{upper}', '', 'g'))) * 2 > length(line))
    OR (n <= 20 AND regexp_matches(line, '{phrases}'))
    OR (n < 4 AND NOT regexp_matches(line, '[.!?:;,"'')…”»][\\x20\\x09-\\x0D]*$'))"""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, {word}), []) AS w FROM documents),
l0 AS (SELECT rid, k, lines[k + 1] AS line FROM (SELECT rid, string_split(text, chr(10)) AS lines FROM d), unnest(range(len(lines))) u(k)),
l1 AS (SELECT rid, line, regexp_extract_all(line, {word}) AS w, row_number() OVER (PARTITION BY rid, line ORDER BY k) > 1 AS again FROM l0),
l2 AS (SELECT *, len(w) AS n FROM l1 WHERE len(w) > 0),
l3 AS (SELECT rid, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER ({fault}), 0) AS lost_words FROM l2 GROUP BY rid),
wins AS (SELECT rid, s, array_to_string(list_slice(w, s + 1, s + 5), ' ') AS t FROM d, unnest(range(greatest(0, len(w) - 4))) u(s)),
twice AS (SELECT rid, s FROM (SELECT *, count(*) OVER (PARTITION BY rid, t) AS c FROM wins) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT s + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY rid),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({symbols("text")} AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words FROM d LEFT JOIN l3 USING (rid) LEFT JOIN rep USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words < n_words AND lost_words <= 0.5 * n_words AS kept FROM r"""


def fill_in_middle() -> str:
    space, word = "\\x20\\x09-\\x0D", "[^\\x20\\x09-\\x0D]"
    number = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    join = lambda a, b: f"array_to_string(list_slice(u, {a}, {b}), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[{space}]*{word}+|[{space}]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, least({number(0)} % (len(u) + 1), {number(1)} % (len(u) + 1)) AS a, greatest({number(0)} % (len(u) + 1), {number(1)} % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number(2)} % 100 >= 50 THEN 'plain' WHEN {number(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, {join("1", "a")} AS pre, {join("a + 1", "b")} AS mid, {join("b + 1", "len(u)")} AS suf FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def source_divergence(least: int = 3, most: int = 200) -> str:
    """Every (group, kept term) is a row, with 0 where the term doesn't occur; all integers are 128 bits wide."""
    share = "1 + (1000000000 * (CAST({c} AS HUGEINT) + 1)) // ({n} + {v})"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lowered("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= {least}),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(c) AS n FROM occ GROUP BY 1, 2),
dense AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, {share.format(c="coalesce(o.c, 0)", n="coalesce(gn.n, 0)", v="v.v")} AS p, {share.format(c="k.total", n="v.n", v="v.v")} AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {most}"""
