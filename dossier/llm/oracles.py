"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

#: CRC-32 of a list of bytes: the table ``t`` by its rule, and its use.
_CRC_TABLE = """
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1
           THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
  FROM range(256) r(i)"""


def _bytes(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda x: ('0x' || x)::BIGINT)"
    )


def _crc(values: str) -> str:
    return (
        f"xor(list_reduce({values}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), "
        "4294967295), 4294967295)"
    )


EXACT_DEDUP = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g')) AS h
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t"""

SHARDING = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         {_bytes("coalesce(text, '')")} AS bytes
  FROM documents),
sized AS (
  SELECT doc_id, size, {_crc("bytes")} AS text_crc32 FROM d, crc),
walk AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS bucket,
         ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616
            * 2862933555777941757 + 1) % 18446744073709551616 AS state
  FROM documents
  UNION ALL
  SELECT doc_id, to_bucket, (state * 2862933555777941757 + 1) % 18446744073709551616
  FROM (SELECT *, floor((bucket + 1)
          * (2147483648::DOUBLE / (state // 8589934592 + 1)::DOUBLE))::BIGINT AS to_bucket
        FROM walk) w
  WHERE to_bucket < 25),
placed AS (
  SELECT doc_id, max(bucket) FILTER (bucket < 24) AS shard, max(bucket) AS grown_shard
  FROM walk GROUP BY doc_id)
SELECT s.doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (
         PARTITION BY shard ORDER BY s.doc_id NULLS LAST, size, text_crc32) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id"""

_TERMS = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}') AS terms
  FROM documents),
occurrences AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS n FROM occurrences
  GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (
  SELECT o.lang, o.source, o.term, count(*) AS n
  FROM occurrences o JOIN kept k ON o.lang = k.lang AND o.term = k.term
  GROUP BY o.lang, o.source, o.term),
langs AS (
  SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k ON g.lang = k.lang GROUP BY g.lang),
sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source
  GROUP BY g.lang, g.source),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM sizes s JOIN langs l ON s.lang = l.lang JOIN kept k ON k.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS other,
           sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source) x
  ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item,
         (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (FROM pairs UNION ALL FROM terms) u) t
WHERE part = 'pair' OR rank <= 10"""

#: The states of a repaired conversation (its last role's initial, ``b`` before the first) and the
#: edits that lead from one to another. The arrays hold, per state, the cheapest cost and of those
#: the least audit; inserts are followed twice after each row, since no third one can be cheaper.
_FAR = 1000000000000


def _least(*paths: tuple[str, str]) -> str:
    """The least of several (cost, audit) pairs."""
    options = ", ".join(f"{{'c': {c}, 'a': {a}}}" for c, a in paths)
    return f"list_min([{options}])"


def _inserted(state: str) -> str:
    """``state`` (b, s, u, a) after one insert more, or none."""
    after_u = _least(
        (f"{state}.u.c", f"{state}.u.a"),
        *[(f"{state}.{x}.c + 3", f"{state}.{x}.a || 'I'") for x in "bsa"],
    )
    after_a = _least((f"{state}.a.c", f"{state}.a.a"), (f"{state}.u.c + 3", f"{state}.u.a || 'I'"))
    return f"{{'b': {state}.b, 's': {state}.s, 'u': {after_u}, 'a': {after_a}}}"


def _row() -> str:
    """The states after the next row, from ``st``: deleted, kept or given another role."""
    kept = f"CASE WHEN fault IN (1, 2) THEN {_FAR} WHEN fault = 3 THEN 3 ELSE 0 END"
    other = f"CASE WHEN fault IN (1, 2) THEN {_FAR} WHEN fault = 3 THEN 6 ELSE 3 END"

    def keep(x: str, role: str) -> tuple[str, str]:
        return (
            f"st.{x}.c + CASE WHEN initial = '{role}' THEN {kept} ELSE {_FAR} END",
            f"st.{x}.a || 'K'",
        )

    def rerole(x: str) -> tuple[str, str]:
        return f"st.{x}.c + {other}", f"st.{x}.a || 'R'"

    gone = {x: (f"st.{x}.c + 4", f"st.{x}.a || 'D'") for x in "bsua"}
    into_u = [p for x in "bsa" for p in (keep(x, "u"), rerole(x))]
    return (
        f"{{'b': {_least(gone['b'])}, 's': {_least(gone['s'], keep('b', 's'))}, "
        f"'u': {_least(gone['u'], *into_u)}, "
        f"'a': {_least(gone['a'], keep('u', 'a'), rerole('u'))}}}"
    )


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

STRUCTURE_REPAIR = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_bytes(_KEY)} AS bytes
  FROM conversations),
drawn AS (SELECT conv_id, turn, role, text, {_crc("bytes")} % 20 AS draw FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
           ELSE text END AS text,
         unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE draw <> 0),
placed AS (
  SELECT *, row_number() OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos
  FROM damaged),
faults AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3
              ELSE 0 END AS fault,
         coalesce(left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos)
           NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed),
sums AS (
  SELECT conv_id,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal,
         list({{'initial': initial, 'fault': fault, 'role': role, 'text': text}} ORDER BY pos)
           AS rows
  FROM faults GROUP BY conv_id),
edits AS (
  SELECT conv_id, rows, 0 AS pos, {_inserted("st")} AS st
  FROM (SELECT conv_id, rows, {_inserted("st")} AS st
        FROM (SELECT conv_id, rows,
                     {{'b': {{'c': 0::BIGINT, 'a': ''}}, 's': {{'c': {_FAR}::BIGINT, 'a': ''}},
                       'u': {{'c': {_FAR}::BIGINT, 'a': ''}},
                       'a': {{'c': {_FAR}::BIGINT, 'a': ''}}}} AS st
              FROM sums) x) y
  UNION ALL
  SELECT conv_id, rows, pos, {_inserted("st")} AS st
  FROM (SELECT conv_id, rows, pos, {_inserted("st")} AS st
        FROM (SELECT conv_id, rows, pos + 1 AS pos, {_row()} AS st
              FROM (SELECT *, rows[pos + 1].initial AS initial, rows[pos + 1].fault AS fault
                    FROM edits WHERE pos < len(rows)) w) x) y),
best AS (
  SELECT conv_id, {_least(("st.b.c", "st.b.a"), ("st.a.c", "st.a.a"))} AS best
  FROM edits WHERE pos = len(rows)),
letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS e,
         generate_subscripts(string_split(best.a, ''), 1) AS k
  FROM best WHERE best.a <> ''),
walked AS (
  SELECT conv_id, e, k, count(*) FILTER (e <> 'I') OVER w AS pos,
         count(*) FILTER (e <> 'D') OVER w AS nth
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
written AS (
  SELECT w.conv_id, w.k, w.e, w.nth, s.rows[w.pos].role AS role, s.rows[w.pos].text AS text,
         coalesce(max(CASE WHEN w.e = 'K' AND s.rows[w.pos].initial = 's' THEN 1 ELSE 0 END)
           OVER (PARTITION BY w.conv_id), 0) AS system
  FROM walked w JOIN sums s ON w.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE w.e <> 'D'),
hashed AS (
  SELECT conv_id, sha256(string_agg(
           CASE e WHEN 'K' THEN role ELSE CASE WHEN (nth - system) % 2 = 1 THEN 'user'
             ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END,
           chr(10) ORDER BY k)) AS repaired_sha256
  FROM written GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN hashed h ON c.conv_id IS NOT DISTINCT FROM h.conv_id"""
