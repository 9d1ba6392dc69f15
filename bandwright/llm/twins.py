"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH doc AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
item AS (SELECT DISTINCT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_window AS (
    SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(
        range(1, greatest(len(w) - 13, 0) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS words
    FROM item WHERE len(w) > 0),
width AS (SELECT DISTINCT n FROM item_window),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, width WHERE len(w) >= n),
hit AS (
    SELECT doc_id, item_id, i, p.n
    FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM place) p
    JOIN item_window USING (n, words)),
word AS (SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + n)) FROM hit) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN met USING (doc_id)
"""

# Kind, pattern, and the pattern whose length must be at least the number (of the whole match
# where it is empty); the same rules as in secrets.py, written for RE2.
_SECRETS = [
    ("assign", """(?i:password|passwd|secret|token|api_?key)["\']?\\x20*[:=]\\x20*["\']?[A-Za-z0-9+/_.=-]+""",
     """^(?i:password|passwd|secret|token|api_?key)["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)$""", 12),
    ("access", "AKIA[A-Z0-9]+", "", 18),
    ("hex", "[0-9a-f]+", "", 16),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "", 0),
    ("code_host", "gh[pousr]_[A-Za-z0-9]{36,}", "", 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", "", 0),
    ("cloud_key", "AIza[A-Za-z0-9_-]{35}", "", 0),
    ("payment", "[rs]k_live_[A-Za-z0-9]{16,}", "", 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "", 0),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20:/@]{1,100}:[^\x00-\x20:/@]{1,100}@", "", 0),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: str, place: int, pattern: str, part: str, least: int) -> str:
    """Matches with their starts: lengths of the pieces between the matches, summed up."""
    size = f"length(regexp_extract(m, {_quoted(part)}, 1))" if part else "length(m)"
    return f"""
    SELECT doc_id, '{kind}' AS kind, {place} AS place, start, start + length(m) AS stop FROM (
        SELECT doc_id, m, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS start
        FROM (
            SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(pattern)}, 0)) AS m,
                unnest(regexp_split_to_array(text, {_quoted(pattern)})[:-2]) AS g,
                unnest(range(len(regexp_extract_all(text, {_quoted(pattern)}, 0)))) AS i
            FROM documents))
    WHERE {size} >= {least}"""


OP1 = f"""
WITH span AS ({" UNION ALL ".join(_matches(k, i, p, q, n) for i, (k, p, q, n) in enumerate(_SECRETS))}),
joined AS (
    SELECT doc_id,
        count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
        count(*) FILTER (place = 2) AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
    FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined USING (doc_id)
"""

OP2 = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM doc),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
    SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
    WHERE 100 * c >= 75 * (p.n + q.n - c)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM way UNION SELECT reach.a, way.b FROM reach JOIN way ON way.a = reach.b)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(doc_id, min(b)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN reach ON reach.a = doc_id GROUP BY doc_id
"""

# Base 32 of a SHA-1 digest: five hexadecimal digits make four characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha, {i}, 5))::INT // {d}) % 32 + 1, 1)"
    for i in range(1, 41, 5) for d in (32768, 1024, 32, 1)
)
OP5 = f"""
WITH page AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha
    FROM pages),
digest AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM page),
last AS (SELECT payload_digest, payload_bytes, max(page_id) AS response FROM digest GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < response THEN response END AS refers_to
FROM digest JOIN last USING (payload_digest, payload_bytes)
"""

_STRICT = ["porn", "xxx", "hentai", "escort", "camgirl", "warez", "viagra", "cialis"]
_SOFT = [
    "adult", "sex", "nude", "dating", "casino", "poker", "bet", "betting", "slots", "jackpot",
    "loan", "payday", "pills", "pharmacy", "crack", "keygen", "torrent", "replica", "cheap", "free",
]


def _terms(terms: list[str]) -> str:
    return " + ".join(f"regexp_matches(lower(url), '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)


OP6 = rf"""
WITH part AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') AS path,
        coalesce({_terms(_STRICT)}, 0)::INT AS strict_hits, coalesce({_terms(_SOFT)}, 0)::INT AS soft_hits
    FROM pages),
ruled AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM part)
SELECT *, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

# The notices of licenses.py.
_NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
    ),
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at"
    ),
}
_NOTICE_ROWS = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in _NOTICES.items())


def _words(text: str) -> str:
    return f"string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"


_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP7 = f"""
WITH template AS (
    SELECT name, {_PAIRS} AS b FROM (SELECT name, {_words("body")} AS w FROM (VALUES {_NOTICE_ROWS}) t(name, body))),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents),
unit AS (
    SELECT doc_id, unit FROM line
    UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10))),
paired AS (SELECT doc_id, {_PAIRS} AS a FROM (SELECT doc_id, {_words("unit")} AS w FROM unit)),
compared AS (
    SELECT doc_id, row_number() OVER () AS u, a FROM paired WHERE len(a) > 0),
best AS (
    SELECT doc_id, u, name, 2 * len(list_intersect(a, b))::DOUBLE / (len(a) + len(b)) AS dice
    FROM compared, template
    WHERE 2 * least(len(a), len(b)) >= 0.8 * (len(a) + len(b))
    QUALIFY row_number() OVER (PARTITION BY u ORDER BY dice DESC, name) = 1),
found AS (
    SELECT doc_id, count(*) AS n_matches, arg_min(name, (-dice, name)) AS license, max(dice) AS dice
    FROM best WHERE dice >= 0.8 GROUP BY doc_id)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, license, dice FROM documents LEFT JOIN found USING (doc_id)
"""

# CRC-32 of a text: the table of one byte, then a fold over the bytes of the text.
_CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc(text: str) -> str:
    """CRC-32 of `text`; `t` of `crc_table` must be at hand."""
    code = f"hex(encode({text}))"
    data = f"list_transform(range(0, length({code}) // 2), lambda i: ('0x' || substr({code}, (2 * i + 1)::BIGINT, 2))::BIGINT)"
    fold = f"list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))"
    return f"xor({fold}, 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, leaves: str) -> str:
    """Levels of the trees over `leaves` (g, i, digest)."""
    return f"""{name} AS (
    SELECT 0 AS level, g, i, digest FROM {leaves}
    UNION ALL
    SELECT level + 1, g, i // 3, sha256(string_agg(digest, '' ORDER BY i))
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY level, g, i // 3)"""


def _beside(name: str, leaves: str, tree: str) -> str:
    """For each leaf and level what stands left and right of its branch."""
    return f"""{name} AS (
    SELECT g, i, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM (
        SELECT x.g, x.i, level, coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i < x.i // power(3, level)::BIGINT), '') AS l,
            coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i > x.i // power(3, level)::BIGINT), '') AS r
        FROM {leaves} x JOIN {tree} n ON n.g IS NOT DISTINCT FROM x.g AND n.i // 3 = x.i // power(3, level + 1)::BIGINT
        WHERE (n.g, n.level) IN (SELECT (g, level) FROM {tree} GROUP BY g, level HAVING count(*) > 1)
        GROUP BY x.g, x.i, level) GROUP BY g, i)"""


OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
leaf AS (
    SELECT doc_id, coalesce(source, chr(0)) AS g, {_leaf("text")} AS digest,
        {_leaf("changed")} AS tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i
    FROM (SELECT *, CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
        FROM documents, crc_table)),
{_tree("node", "leaf")},
{_beside("below", "leaf", "node")},
top AS (SELECT g AS source, digest, 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM node
    WHERE (g, level) IN (SELECT (g, max(level)) FROM node GROUP BY g)),
{_tree("high", "top")},
{_beside("above", "top", "high")},
root AS (SELECT digest AS root FROM high ORDER BY level DESC LIMIT 1),
proved AS (
    SELECT doc_id, x.digest AS leaf, tampered, t.digest AS subroot, root,
        list_concat(coalesce(b.path, []), coalesce(a.path, [])) AS path
    FROM leaf x JOIN top t ON t.source = x.g LEFT JOIN below b ON b.g = x.g AND b.i = x.i
    LEFT JOIN above a ON a.i = t.i, root),
folded AS (
    SELECT *, list_reduce(list_prepend({{'l': tampered, 'r': ''}}, path),
        lambda acc, s: {{'l': sha256(s.l || acc.l || s.r), 'r': ''}}).l AS folded_root FROM proved)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified
FROM folded
"""

OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
run AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS k,
        translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
once AS (SELECT k, r, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY k, r),
marked AS (SELECT r, n, {_crc("k || ':' || r")} AS h FROM once, crc_table),
word AS (
    SELECT w, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % 31 = 0 THEN r[:(h % length(r))::BIGINT] || r[(h % length(r))::BIGINT + 2:] ELSE r END AS w FROM marked)
    WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
place AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM word),
cut AS (SELECT w, i, w[:i - 1] AS a, w[i + 1:] AS b FROM place),
pair AS (
    SELECT x.w, y.w AS v FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
    UNION SELECT x.w, y.w FROM cut x JOIN word y ON y.w = x.a || x.b
    UNION SELECT y.w, x.w FROM cut x JOIN word y ON y.w = x.a || x.b),
best AS (
    SELECT p.w, count(*) AS n_near, max(y.n) AS most, arg_min(p.v, (-y.n, encode(p.v))) AS v
    FROM pair p JOIN word y ON y.w = p.v GROUP BY p.w),
form AS (
    SELECT w AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN v END AS form,
        CASE WHEN most >= 10 * n THEN most END AS form_n
    FROM word LEFT JOIN best USING (w)),
chain AS (
    SELECT word, word AS at FROM form
    UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM form f JOIN chain c ON c.word = f.word JOIN form l ON l.word = c.at AND l.form IS NULL
"""

SQL: dict[str, str] = {
    "op1_secrets": OP1,
    "op2_jaccard_join": OP2,
    "op4_decontamination": OP4,
    "op5_warc": OP5,
    "op6_urls": OP6,
    "op7_licenses": OP7,
    "op11_merkle": OP11,
    "op13_spelling": OP13,
}
