"""Check SQL of the operators that work on checksums: CRC-32 by its table of 256 steps, in plain SQL."""

from __future__ import annotations

# the table follows from the reversed polynomial of CRC-32, 0xEDB88320 (fixed value)
CRC_TABLE = """crc_table AS (
    SELECT list_transform(range(256), n -> list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)""".replace(
    "n -> ", "lambda n: ")


def crc32_of(hex_bytes: str) -> str:
    """CRC-32 of bytes given as upper-case hex; ``steps`` of ``crc_table`` must be in reach."""
    bytes_of = (f"list_transform(range(length({hex_bytes}) // 2), "
                f"lambda i: ('0x' || substr({hex_bytes}, 2 * i + 1, 2))::BIGINT)")
    return (f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), "
            "lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)")


REPAIR_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32_of("hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')))")} %% 20 AS code
    FROM conversations, crc_table),
rows_after AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM coded, range(CASE WHEN code = 3 THEN 2 ELSE 1 END) WHERE code <> 0),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n,
           left(role, 1) AS initial, rtrim(text, E' \\t\\n\\x0b\\f\\r') AS bare
    FROM rows_after),
faults AS (
    SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before,
           CASE WHEN bare = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
    FROM numbered),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id),
convs AS (SELECT DISTINCT conv_id FROM conversations),
-- least (cost, audit, lines) after n rows in each state: start, after system, after user, after assistant
steps_of AS (
    SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS p0,
           {{'c': 1000000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS p1,
           {{'c': 1000000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS p2,
           {{'c': 1000000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS p3
    FROM convs
    UNION ALL
    SELECT conv_id, n, least(%(drop0)s) AS p0, least(%(drop1)s, %(keep_s)s) AS p1,
           least(%(drop2)s, %(keep_u0)s, %(keep_u1)s, %(keep_u3)s, %(role_u0)s, %(role_u1)s, %(role_u3)s) AS p2,
           least(%(drop3)s, %(keep_a)s, %(role_a)s) AS p3
    FROM (SELECT s.conv_id, f.n, f.role, f.text, f.initial, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS extra,
                 CASE WHEN f.fault IN ('blank', 'duplicate') THEN 1000000000000 ELSE 0 END AS gone,
                 p0, p1, least(p2, %(in_u0)s, %(in_u1)s, %(in_u3)s) AS p2,
                 least(p3, %(in_a)s, %(in_a0)s, %(in_a1)s) AS p3
          FROM steps_of s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n + 1)),
ended AS (
    SELECT s.conv_id, least(p0, p3, %(in_a)s, %(in_a0)s, %(in_a1)s) AS best
    FROM steps_of s LEFT JOIN (SELECT conv_id, max(n) AS n_rows FROM faults GROUP BY conv_id) l
      ON l.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.n = coalesce(n_rows, 0))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


def _step(state: int, cost: str, edit: str, line: str | None) -> str:
    lines = f"p{state}.t" if line is None else f"list_append(p{state}.t, {line})"
    return f"{{'c': p{state}.c + {cost}, 'a': p{state}.a || '{edit}', 't': {lines}}}"


def _keep(state: int, initial: str) -> str:
    return _step(state, f"extra + gone + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000000000 END", "K",
                 "role || ':' || text")


def _twice(state: int) -> str:
    return (f"{{'c': p{state}.c + 10, 'a': p{state}.a || 'II', "
            f"'t': list_concat(p{state}.t, ['user:', 'assistant:'])}}")


REPAIR_SQL = REPAIR_SQL % {
    **{f"drop{s}": _step(s, "2", "D", None) for s in range(4)},
    "keep_s": _keep(0, "s"), "keep_a": _keep(2, "a"), **{f"keep_u{s}": _keep(s, "u") for s in (0, 1, 3)},
    **{f"role_u{s}": _step(s, "1 + extra + gone", "R", "'user:' || text") for s in (0, 1, 3)},
    "role_a": _step(2, "1 + extra + gone", "R", "'assistant:' || text"),
    **{f"in_u{s}": _step(s, "5", "I", "'user:'") for s in (0, 1, 3)},
    "in_a": _step(2, "5", "I", "'assistant:'"), "in_a0": _twice(0), "in_a1": _twice(1)}


RESAMPLING_SQL = f"""
WITH {CRC_TABLE},
lowered AS (
    SELECT 0 AS side, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
    UNION ALL
    SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
numbered AS (SELECT *, row_number() OVER () AS n FROM lowered),
words AS (
    SELECT n, side, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM numbered),
hexed AS (SELECT word, hex(encode(word)) AS bytes FROM (SELECT DISTINCT word FROM words)),
hashed AS (SELECT word, {crc32_of("bytes")} % 10000 AS bucket FROM hexed, crc_table),
counts AS (
    SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
    FROM words JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE)
                                   / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
    FROM counts, sums),
weighed AS (
    SELECT n, count(*) AS n_features, sum(gain)::BIGINT AS weight
    FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY n),
scored AS (
    SELECT n, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h
    FROM numbered LEFT JOIN weighed USING (n) WHERE side = 0),
placed AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ordered AS (
    SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST) AS place,
           count(*) FILTER (n_features >= 20) OVER () AS able
    FROM placed)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM ordered"""
