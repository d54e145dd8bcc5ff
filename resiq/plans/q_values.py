"""Queries of packed values (problem 2), with the grammar as regular expressions for SQL."""

from __future__ import annotations

from resiq.operators import segment
from resiq.plans.registry import query

#: A separator with the field's end marked by a bar; a quoted piece; a piece with its separator.
SEPARATOR = r"(?:[|;,\t\n\r]| +/(?: |\|$))"
QUOTED = r'"(?:[^"\\]|""|\\.)*"' + r"|'(?:[^'\\]|''|\\.)*'"
PIECE = rf" */ |\s*(?:{QUOTED})\s*{SEPARATOR}|.*?{SEPARATOR}"


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SPACE = "' ' || chr(9) || chr(10) || chr(13)"
VALUES = f"""WITH f AS (SELECT ord, 'dbs' AS field, trim(dbs, {SPACE}) AS s FROM antibacterial_fasta UNION ALL SELECT ord, 'activity', trim(activity, {SPACE}) FROM antibacterial_fasta),
 g AS (SELECT *, s LIKE '[%' AND json_valid(s) AS is_json FROM f WHERE s IS NOT NULL AND s <> '' AND lower(s) NOT IN ('-', 'n/a')),
 a AS (SELECT ord, field, list_transform(from_json(s, '["VARCHAR"]'), lambda x: trim(x)) AS v FROM g WHERE is_json),
 b AS (SELECT ord, field, list_transform(regexp_extract_all(regexp_replace(s, '^/ ', '|') || '|', {literal('(?s)' + PIECE)}), lambda x: trim(regexp_replace(x, {literal('(?s)(?: */ |' + SEPARATOR + ')$')}, ''), {SPACE})) AS v FROM g WHERE NOT is_json),
 c AS (SELECT ord, field, list_filter(list_transform(v, lambda x: CASE WHEN length(x) >= 2 AND regexp_full_match(x, {literal('(?s)' + QUOTED)}) THEN trim(regexp_replace(replace(x[2:-2], x[1] || x[1], x[1]), '\\\\(["''\\\\])', '\\1', 'g')) ELSE x END), lambda x: x <> '') AS v FROM b
  UNION ALL SELECT ord, field, list_filter(v, lambda x: x <> '') FROM a),
 d AS (SELECT ord, field, unnest(range(1, len(v) + 1))::INT AS pos, unnest(v) AS value FROM c)"""


@query("p2_found", f"{VALUES} SELECT ord, field, pos, value FROM d")
def p2_found(spark, sf):
    return segment.p2_found(spark, sf)


@query("p2_counts", f"{VALUES} SELECT field, value, count(DISTINCT ord) AS n_rows, count(*) AS n_values FROM d GROUP BY 1, 2")
def p2_counts(spark, sf):
    return segment.p2_counts(spark, sf)


@query("p2_protected")
def p2_protected(spark, sf):
    return segment.p2_protected(spark, sf)
