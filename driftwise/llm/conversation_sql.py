"""DuckDB SQL of the conversation repair: a recursive CTE over rows, each state as text ``cost|audit`` so that least() breaks ties."""

from driftwise.llm.merkle_sql import CRC32, crc32

#: Cost in 12 digits, then the audit: text order is cost, then ASCII order of the audit.
_EMPTY = "'000000000000'"


def _step(state: str, cost: str, edit: str) -> str:
    return f"(lpad((CAST(left({state}, 12) AS BIGINT) + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || '{edit}')"


def _next() -> str:
    """The four states after row r: deleted, or kept / given a role where it has neither of the two first faults."""
    more = "CASE WHEN r.fault = 3 THEN 3 ELSE 0 END"
    fine = "r.fault NOT IN (1, 2)"

    def keep(letter: str, state: str, inserts: int) -> str:
        edit = f"CASE WHEN r.initial = '{letter}' THEN {_step(state, f'{3 * inserts} + {more}', 'I' * inserts + 'K')} ELSE {_step(state, f'{3 * inserts + 3} + {more}', 'I' * inserts + 'R')} END"
        return f"CASE WHEN {fine} THEN {edit} END"

    s0 = _step("p.s0", "4", "D")
    s1 = f"least({_step('p.s1', '4', 'D')}, CASE WHEN {fine} AND r.initial = 's' THEN {_step('p.s0', more, 'K')} END)"
    s2 = f"least({_step('p.s2', '4', 'D')}, {keep('u', 'p.s0', 0)}, {keep('u', 'p.s1', 0)}, {keep('u', 'p.s3', 0)}, {keep('u', 'p.s2', 1)})"
    s3 = f"least({_step('p.s3', '4', 'D')}, {keep('a', 'p.s2', 0)}, {keep('a', 'p.s0', 1)}, {keep('a', 'p.s1', 1)}, {keep('a', 'p.s3', 1)})"
    return f"{s0} AS s0, {s1} AS s1, {s2} AS s2, {s3} AS s3"


REPAIR_SQL = f"""
WITH RECURSIVE {CRC32},
ids AS (SELECT DISTINCT conv_id FROM conversations),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS code
  FROM conversations, crc_table),
after_damage AS (
  SELECT conv_id, turn, role AS role0, sha256(text) AS text0, k, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, (SELECT unnest(range(2)) AS k) WHERE code <> 0 AND (k = 0 OR code = 3)),
numbered AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, k) AS i FROM after_damage),
lines AS (
  SELECT *, CASE WHEN ended = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                 WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM lines GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {_EMPTY} AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM ids
  UNION ALL
  SELECT r.conv_id, r.i, {_next()}
  FROM walk p JOIN lines r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1),
ends AS (
  SELECT w.conv_id, least(s0, s3, {_step('s2', '3', 'I')}, {_step('s1', '6', 'II')}) AS best
  FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0)),
letters AS (
  SELECT conv_id, edit, pos, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i
  FROM (SELECT conv_id, unnest(string_split(substr(best, 13), '')) AS edit, generate_subscripts(string_split(substr(best, 13), ''), 1) AS pos FROM ends WHERE length(best) > 12)),
output AS (
  SELECT l.conv_id, pos, edit, r.role, r.text, edit = 'K' AND r.initial = 's' AS is_system,
         count(*) FILTER (NOT (edit = 'K' AND coalesce(r.initial, '') = 's')) OVER (PARTITION BY l.conv_id ORDER BY pos) % 2 = 1 AS is_user
  FROM letters l LEFT JOIN lines r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.edit <> 'I' WHERE edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN is_user THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS text
  FROM output GROUP BY conv_id)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, CAST(left(best, 12) AS BIGINT) AS cost, substr(best, 13) AS audit, sha256(coalesce(p.text, '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM e.conv_id
"""
