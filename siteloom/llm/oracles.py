"""Longer DuckDB SQL for the registered queries of this subpackage."""

from __future__ import annotations

from math import log2

from siteloom.llm import secrets, sharding

# Shards. The table of CRC-32 is made by its rule; a text's bytes are folded over it.
_CRC_TABLE = (
    "SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))"
)
_SEED, _SHARDS = 17, 40


def _unit(digest: str) -> str:
    return f"(('0x' || substr({digest}, 1, 13))::BIGINT::DOUBLE / {1 << 52})"


SHARDS = f"""
    WITH crc AS ({_CRC_TABLE}),
    t AS (
        SELECT doc_id, source, coalesce(strlen(text), 0) + 16 AS size,
               xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'),
                   lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
               {_unit(f"md5('{_SEED}:' || coalesce(doc_id::VARCHAR, ''))")} AS u,
               CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS s
        FROM documents, crc),
    r AS (
        SELECT *, (row_number() OVER (PARTITION BY s ORDER BY u, doc_id NULLS LAST, text_crc32, size)
                   - {_unit(f"md5('{_SEED}/start:' || s)")}) / count(*) OVER (PARTITION BY s) AS f
        FROM t),
    p AS (
        SELECT *, row_number() OVER (ORDER BY f, s, u, doc_id NULLS LAST, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM r),
    k AS (SELECT *, (((place + 1) * {_SHARDS} - 1) // n)::INT AS shard FROM p)
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard, place - (shard::BIGINT * n) // {_SHARDS} AS slot,
           NULL::INT AS grown_shard, source
    FROM k"""

# Secrets. Matches and the gaps between them alternate, so a match begins at the sum of what is before it.


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _placed(kind: str, pattern: str, group: int = 0, where: str = "true") -> str:
    p = _quoted(pattern)
    return f"""
        SELECT doc_id, {secrets.KINDS.index(kind)} AS rank, '{kind}' AS kind, start, start + length(found) AS stop, value FROM (
            SELECT *, sum(length(gap)) OVER w + sum(length(found)) OVER w - length(found) AS start FROM (
                SELECT doc_id, unnest(regexp_extract_all(t, {p}, 0)) AS found, unnest(regexp_extract_all(t, {p}, {group})) AS value,
                       unnest(regexp_split_to_array(t, {p})[:-2]) AS gap, unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS nth
                FROM d WHERE regexp_matches(t, {p}))
            WINDOW w AS (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING))
        WHERE {where}"""


def _entropy(of: secrets.CharacterClass) -> str:
    w = secrets.WINDOW
    needs = [f"regexp_matches(value, {_quoted(x)})" for x in of.needs]
    needs += [f"NOT regexp_matches(value, {_quoted(x)})" for x in secrets.ALLOW]
    weight = "list_sum(list_transform(list_distinct(cs), lambda c: len(list_filter(cs, lambda x: x = c)) * log2(len(list_filter(cs, lambda x: x = c)))))"
    limit = w * (log2(w) - of.threshold) + 1e-9
    real = " AND ".join(f"NOT regexp_matches(substr(value, min(i) + 1, max(i) - min(i) + {w}), {_quoted(x)})" for x in secrets.PLACEHOLDERS)
    return f"""
        SELECT doc_id, rank, kind, (start + min(i))::BIGINT AS start, (start + max(i) + {w})::BIGINT AS stop FROM (
            SELECT *, sum((gap IS NULL OR gap > {w})::INT) OVER (PARTITION BY doc_id, start ORDER BY i) AS island FROM (
                SELECT *, i - lag(i) OVER (PARTITION BY doc_id, start ORDER BY i) AS gap FROM (
                    SELECT *, string_split(substr(value, i + 1, {w}), '') AS cs FROM (
                        SELECT *, unnest(range(0, length(value) - {w - 1})) AS i
                        FROM ({_placed(of.kind, of.candidate, 0, " AND ".join(needs))})))
                WHERE {weight} <= {limit!r}))
        GROUP BY doc_id, rank, kind, start, value, island HAVING {real}"""


_TOLD = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank)"

SECRETS = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    b AS ({_placed("assign", secrets.ASSIGN, 2, "length(value) >= 6")}
        UNION ALL {_placed("access", secrets.ACCESS)}
        UNION ALL {_placed("hex", secrets.HEX)}),
    e AS ({" UNION ALL ".join(map(_entropy, secrets.CLASSES))}),
    a AS (SELECT doc_id, rank, kind, start, stop FROM b
        UNION ALL SELECT * FROM e WHERE NOT EXISTS (
            SELECT 1 FROM b WHERE b.doc_id = e.doc_id AND b.start <= e.start AND b.stop >= e.stop)),
    n AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex, {_TOLD} AS base FROM b GROUP BY doc_id),
    s AS (SELECT doc_id, {_TOLD} AS spans FROM a GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

# Spelling. Words are near if they agree with the same place left out of both, or of one.

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = f"""
    WITH RECURSIVE crc AS ({_CRC_TABLE}),
    t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS given FROM documents),
    g AS (SELECT doc_id, {_LOWER.format("given")} AS run, count(*) AS n FROM t GROUP BY ALL),
    h AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(doc_id::VARCHAR, '') || ':' || run), '..'),
                   lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
        FROM g, crc),
    w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
    v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
    q AS (SELECT word, n, i, substr(word, 1, i - 1) AS front, substr(word, i + 1) AS back FROM p),
    e AS (
        SELECT a.word, b.word AS near, b.n AS m FROM q a JOIN q b ON a.i = b.i AND a.front = b.front AND a.back = b.back AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM q a JOIN v b ON a.front || a.back = b.word
        UNION SELECT b.word, a.word, a.n FROM q a JOIN v b ON a.front || a.back = b.word),
    b AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM e GROUP BY word),
    f AS (
        SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
        FROM v LEFT JOIN b ON v.word = b.word),
    r AS (
        SELECT word, word AS root FROM f
        UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
    FROM f JOIN r ON r.word = f.word JOIN f AS l ON l.word = r.root WHERE l.form IS NULL"""

# Ranked search, of every document that holds a term.

RANKED = rf"""
    WITH d AS (
        SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    s AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
    a AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM s),
    w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, a GROUP BY term, big_n),
    i AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    f AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
        FROM i JOIN w USING (term) JOIN c USING (term) JOIN s USING (doc_id), a GROUP BY item_id, doc_id),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM f WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

SQL = {"op6_interleaved_shards": SHARDS, "op10_secret_spans": SECRETS, "op11_spelling_variants": SPELLING, "op12_best_positions": RANKED}
