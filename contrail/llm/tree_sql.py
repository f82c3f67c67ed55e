"""DuckDB SQL for the rows of the manifest and of the conversation trie."""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters, bit by bit, as DuckDB has no such function."""
    step = "lambda d, z: CASE WHEN d % 2 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END"
    codes = f"list_transform(str_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295::BIGINT)"


def _value(c: str) -> str:
    return f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(map(_value, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_leaf('text')} AS leaf,
        CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END AS shown FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
lower AS (
    SELECT lang, 0 AS level, i, n, leaf AS digest FROM placed
    UNION ALL
    SELECT lang, min(level) + 1, i // 8, min((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY i)) FROM lower WHERE n > 1 GROUP BY lang, i // 8),
tops AS (SELECT lang, digest AS subroot, max(level) OVER (PARTITION BY lang) AS height FROM lower WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM tops),
upper AS (
    SELECT 0 AS level, g AS i, n, subroot AS digest FROM ranked
    UNION ALL
    SELECT min(level) + 1, i // 8, min((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY i // 8),
nodes AS (
    SELECT g, level, lower.i, digest FROM lower JOIN ranked ON lower.lang IS NOT DISTINCT FROM ranked.lang WHERE lower.n > 1
    UNION ALL
    SELECT -1, level, i, digest FROM upper WHERE n > 1),
climb AS (
    SELECT p.doc_id, p.leaf, r.subroot, r.g AS home, r.height, p.i AS first, CASE WHEN r.height > 0 THEN r.g ELSE -1 END AS g, 0 AS level, 0 AS step,
        CASE WHEN r.height > 0 THEN p.i ELSE r.g END AS i, '' AS proof, p.shown AS folded
    FROM placed p JOIN ranked r ON p.lang IS NOT DISTINCT FROM r.lang
    UNION ALL
    SELECT c.doc_id, c.leaf, c.subroot, c.home, c.height, c.first, CASE WHEN c.level + 1 = c.height THEN -1 ELSE c.g END AS g,
        CASE WHEN c.level + 1 = c.height AND c.g >= 0 THEN 0 ELSE c.level + 1 END, c.step + 1,
        CASE WHEN c.level + 1 = c.height AND c.g >= 0 THEN c.home ELSE c.i // 8 END,
        concat(c.proof, s.before, s.after), sha256(concat(s.before, c.folded, s.after))
    FROM climb c JOIN LATERAL (
        SELECT count(*) AS found, coalesce(string_agg(digest, '' ORDER BY n.i) FILTER (WHERE n.i < c.i), '') AS before,
            coalesce(string_agg(digest, '' ORDER BY n.i) FILTER (WHERE n.i > c.i), '') AS after
        FROM nodes n WHERE n.g = c.g AND n.level = c.level AND n.i // 8 = c.i // 8) s ON s.found > 0),
root AS (SELECT digest AS root FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY home, first ORDER BY step DESC) AS k FROM climb), root WHERE k = 1
"""

_TURN = "concat(strlen(role), ':', role, strlen(text), ':', text)"

TRIE_SQL = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h, conv_id - conv_id % 20 AS base, count(*) AS n FROM turns GROUP BY conv_id),
sizes AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS m FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
seq AS (
    SELECT s.conv_id, t.d AS depth, t.role, t.text FROM sizes s JOIN turns t ON t.conv_id = s.base AND t.d <= s.m
    UNION ALL
    SELECT s.conv_id, t.d - s.h + s.m, t.role, t.text FROM sizes s JOIN turns t USING (conv_id) WHERE t.d > s.h),
prefixes AS (
    SELECT conv_id, depth, sha256(string_agg({_TURN}, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
        CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM seq
    UNION ALL
    SELECT s.conv_id, 0, 'root', 0, NOT EXISTS (SELECT 1 FROM seq q WHERE q.conv_id = s.conv_id) FROM sizes s),
nodes AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, count(*) FILTER (WHERE last) AS ends,
    min(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM prefixes GROUP BY key),
above AS (SELECT p.key, n.conv_id, n.depth, n.n_convs, n.words, n.ends = n.n_convs AS leaf FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
totals AS (SELECT key, CAST(count(*) FILTER (WHERE leaf) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM above GROUP BY key),
parents AS (SELECT n.key, u.key AS up, un.conv_id AS parent_conv_id FROM nodes n JOIN prefixes u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1 JOIN nodes un ON un.key = u.key),
kids AS (SELECT up AS key, count(*) AS n_children FROM parents GROUP BY up)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t USING (key) LEFT JOIN parents p USING (key) LEFT JOIN kids k USING (key)
"""
