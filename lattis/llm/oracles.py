"""SQL for the queries that it can express, for DuckDB over the same tables."""

from __future__ import annotations

from .chat import CLOSE, CONTROLS, OPEN, OTHER_CLOSE, OTHER_OPEN

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP2 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item, 10 AS m, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
    UNION SELECT item, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dw.m, item FROM dw JOIN win ON dw.m = win.m AND dw.s = win.s),
covered AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, COUNT(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(covered.n, 0) AS n_hit, COALESCE(found.n, 0) AS n_items,
    sha256(COALESCE(items, '')) AS items_sha256, COALESCE(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT html, MAX(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
    CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, COUNT(*) AS n_links FROM links GROUP BY 1)
SELECT v.vec_id, COALESCE(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def _regex(s: str) -> str:
    return "".join("\\" + c if c in "[]" else c for c in s)


_GUARDED = "|".join(_regex(c[0]) + "\\\\*" + _regex(c[1:]) for c in CONTROLS)
_AROUND = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(OPEN[r]) + len(CLOSE[r])}" for r in OPEN) + f" ELSE {len(OTHER_OPEN) + 1 + len(OTHER_CLOSE)} + length(role) END"
_CONFLICT = "</s>[INST] ok [/INST]"

OP5 = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{_CONFLICT}' UNION ALL SELECT -1, 1, 'assistant', '{_CONFLICT}')
SELECT conv_id, COUNT(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(SUM({_AROUND} + length(text) + len(regexp_extract_all(text, '{_GUARDED}'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY 1
"""



def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    values = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {values}), lambda c, b: {byte}), 4294967295)"


def _jump(shards: int) -> str:
    """Last landing below ``shards`` of every hash of ``keys``."""
    return f"""
    j{shards} AS (
        SELECT h, CAST(h AS HUGEINT) AS state, CAST(0 AS BIGINT) AS spot, CAST(0 AS BIGINT) AS ahead FROM keys
        UNION ALL
        SELECT h, s, ahead, CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / CAST((s // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
        FROM (SELECT h, ahead, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM j{shards} WHERE ahead < {shards})),
    s{shards} AS (SELECT h, MAX(spot) AS shard FROM j{shards} GROUP BY 1)"""


OP11 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc32("coalesce(text, '')")} AS text_crc32,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
keys AS (SELECT DISTINCT h FROM d),{_jump(16)},{_jump(17)}
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(s16.shard AS INT) AS shard, CAST(s17.shard AS INT) AS grown_shard,
    ROW_NUMBER() OVER (PARTITION BY s16.shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM d JOIN s16 ON s16.h = d.h JOIN s17 ON s17.h = d.h
"""

OP12 = f"""
WITH RECURSIVE r AS (
    SELECT doc_id, run, COUNT(*) AS k FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
    GROUP BY 1, 2),
c AS (SELECT run, k, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r),
o AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM c),
v AS (SELECT word, CAST(SUM(k) AS BIGINT) AS n FROM o WHERE length(word) >= 5 GROUP BY 1 HAVING SUM(k) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
dels AS (SELECT DISTINCT word, n, head || tail AS rest FROM cuts),
near AS (
    SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION ALL SELECT d.word, v.word, v.n FROM dels d JOIN v ON v.word = d.rest
    UNION ALL SELECT v.word, d.word, d.n FROM dels d JOIN v ON v.word = d.rest),
best AS (SELECT word, COUNT(*) OVER (PARTITION BY word) AS n_near, other, n AS form_n, ROW_NUMBER() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM near),
f AS (
    SELECT v.word, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN other END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n
    FROM v LEFT JOIN best ON best.word = v.word AND place = 1),
up AS (SELECT word, form AS spot, 1 AS steps FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN f ON f.word = up.spot WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(spot, steps) AS root FROM up GROUP BY 1)
SELECT f.word, form, COALESCE(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends ON ends.word = f.word
"""

OP13 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM k),
c AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
    SELECT c.conv_id, 0 AS part, pos, key, words FROM c JOIN p ON p.conv_id = base WHERE pos < h
    UNION ALL SELECT c.conv_id, 1, pos, key, words FROM c JOIN p ON p.conv_id = c.conv_id WHERE pos >= h),
b AS (SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, key, words FROM r),
path AS (
    SELECT conv_id, depth, words, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM b
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT conv_id, depth, words, MIN(conv_id) OVER (PARTITION BY depth, path) AS node, depth = MAX(depth) OVER (PARTITION BY conv_id) AS last FROM path),
n AS (SELECT node, depth, COUNT(*) AS n_convs, MIN(words) AS words, sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
par AS (SELECT n.node, n.depth, m.node AS parent FROM n JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, COUNT(*) AS n_children FROM par GROUP BY 1, 2),
under AS (
    SELECT m.node, m.depth, n.n_convs, n.words, n_children FROM n JOIN m ON m.conv_id = n.node AND m.depth <= n.depth
    LEFT JOIN kids ON kids.node = n.node AND kids.depth = n.depth),
up AS (SELECT node, depth, COUNT(*) FILTER (WHERE n_children IS NULL) AS n_leaves, CAST(SUM((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM under GROUP BY 1, 2)
SELECT n.node AS conv_id, n.depth, parent AS parent_conv_id, n_convs, COALESCE(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM n JOIN up ON up.node = n.node AND up.depth = n.depth LEFT JOIN par ON par.node = n.node AND par.depth = n.depth LEFT JOIN kids ON kids.node = n.node AND kids.depth = n.depth
"""

SQL = {"op2_decontaminate": OP2, "op3_warc": OP3, "op4_multiindex": OP4, "op5_chat": OP5, "op11_shards": OP11, "op12_spelling": OP12, "op13_prefixes": OP13}
