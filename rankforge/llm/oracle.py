"""DuckDB SQL for what SQL can say of these operators: all of op3, and the base columns of others."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
#: Rows by a number of their own, as ids may repeat.
_D = "d AS (SELECT row_number() OVER () AS r, * FROM documents)"
#: Cyclic redundancy checks of decimal numbers: the table of bytes, then one step for each digit.
_CRC = """crc_bytes AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS b),
 crc AS (SELECT r, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, b[(xor(c, x) & 255) + 1])), 4294967295), 0) AS crc FROM d, crc_bytes)"""

LICENSES = rf"""WITH {_D}, w AS (SELECT r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
 p AS (SELECT r, i, CASE WHEN ws[i] = 'cc' AND ws[i + 1] = 'by' THEN 'cc-by' WHEN ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license' THEN 'gpl'
   WHEN ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved' THEN 'reserved' END AS label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
 b AS (SELECT r, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY r)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN b ON w.r = b.r"""

_KINDS = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", "(AKIA[A-Z0-9]+)", 16),
    ("hex", "([0-9a-f]+)", 32),
)


def _places(k: int, kind: str, pattern: str, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""m{k} AS (SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g
   FROM (SELECT r, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', 1) AS vs, string_split_regex(t, '{p}') AS gs FROM t)),
 s{k} AS (SELECT r, v, {k} AS k, '{kind}' AS kind, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop, length(m) AS n FROM m{k})"""


SECRETS = rf"""WITH {_D}, t AS (SELECT r, coalesce(text, '') AS t FROM d), {", ".join(_places(k, *x) for k, x in enumerate(_KINDS))},
 s AS ({" UNION ALL ".join(f"SELECT r, k, kind, stop - n AS start, stop FROM s{k} WHERE length(v) >= {least}" for k, (_, _, least) in enumerate(_KINDS))}),
 g AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM s GROUP BY r)
 SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g ON d.r = g.r"""

LM = rf"""WITH {_D}, {_CRC}, w AS (SELECT d.r, crc % 7 = 2 AS held_out, list_append(regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+'), '') AS ws FROM d JOIN crc ON d.r = crc.r),
 tok AS (SELECT r, held_out, unnest(ws) AS token FROM w), c AS (SELECT token, count(*) AS c FROM tok WHERE NOT held_out GROUP BY token),
 n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c),
 s AS (SELECT tok.r, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1.0))) AS base_score FROM tok LEFT JOIN c ON tok.token = c.token, n GROUP BY tok.r)
 SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score FROM d JOIN w ON d.r = w.r JOIN s ON d.r = s.r, n"""

# Sources in the order in which they fill up: the level is that of the first number of full ones at which the next one is not full.
MIXING = rf"""WITH {_D}, z AS (SELECT r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM d),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
 o AS (SELECT source, source_size, 2.0 * source_size AS cap, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1) % 3 + 1] AS weight FROM s),
 q AS (SELECT *, cap / weight AS ratio, 1.5 * sum(source_size) OVER () AS total, coalesce(sum(cap) OVER before, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free
   FROM o WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT (total - held) / free AS level FROM q WHERE (total - held) / free <= ratio ORDER BY ratio LIMIT 1)
 SELECT doc_id, size, source_size, round(least(weight * coalesce((SELECT level FROM l), 1e300), cap), 6) AS target FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source"""

EMBEDDINGS = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 ok AS MATERIALIZED (SELECT r, list_transform(v, lambda x: coalesce(x, 0)) AS v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.95 ELSE false END),
 reach AS (SELECT r, r AS other FROM e UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
 c AS (SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.other GROUP BY reach.r), n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.r = e.r LEFT JOIN n ON n.r = e.r"""
