"""DuckDB SQL that gives the rows of the queries whose operators SQL can express, by plain joins and windows."""

from __future__ import annotations

from pulsegrid.llm.secrets import ADDED_RULES, BASE_RULES
from pulsegrid.llm.suffix_dedup import ORACLE_SQL as REPEATED_PASSAGES

NEAR_DUPLICATES = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def _level(name: str, columns: list[str], weight: str, before: str | None) -> str:
    """One level of the budget tree: shares of the nodes of a level in their parents' budgets."""
    own, parent = ", ".join(columns), ", ".join(columns[:-1])
    budget = "(SELECT sum(n) FROM docs)::DOUBLE" if before is None else "budget"
    source = f"nodes_{name}" if before is None else f"nodes_{name} JOIN {before} USING ({parent})"
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
nodes_{name} AS (SELECT {own}, sum(n) * 2.0::DOUBLE AS capacity, ({weight})::DOUBLE AS weight FROM docs GROUP BY {own}),
a_{name} AS (SELECT {own}, capacity, weight, {budget} AS budget FROM {source}),
b_{name} AS (SELECT *, (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM a_{name} WINDOW w AS ({part} ORDER BY capacity / weight, {own})),
c_{name} AS (SELECT *, first_value(CASE WHEN level * weight < capacity THEN level END IGNORE NULLS) OVER ({part} ORDER BY capacity / weight, {own} ROWS UNBOUNDED PRECEDING) AS l FROM b_{name}),
{name} AS (SELECT {own}, CASE WHEN l IS NULL THEN capacity ELSE least(capacity, l * weight) END AS budget FROM c_{name})"""


SOURCE_MIXING = f"""
WITH docs AS (
  SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS domain, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM documents
),
{_level("domains", ["domain"], "CASE domain WHEN 'english' THEN 0.7 ELSE 0.3 END", None)},
{_level("langs", ["domain", "lang"], "CASE WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END", "domains")},
{_level("leaves", ["domain", "lang", "source"], "1", "langs")},
tokens AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM docs GROUP BY ALL),
plan AS (SELECT domain, lang, source, epoch, tokens, floor(budget + 1e-6)::BIGINT - epoch * tokens AS left_over
  FROM leaves JOIN tokens USING (domain, lang, source), (SELECT unnest([0, 1]) AS epoch)),
ranked AS (SELECT doc_id, lang, source, epoch, n, tokens, left_over,
  sum(n) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5(concat_ws(':', '17', epoch::VARCHAR, doc_id::VARCHAR)), doc_id, md5(text)) AS up_to
  FROM docs JOIN plan USING (domain, lang, source) WHERE left_over > 0)
SELECT doc_id, lang, source, epoch, n AS n_tokens FROM ranked WHERE left_over >= tokens OR up_to <= left_over
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(rank: int, rule) -> str:
    """A row for each match of a rule that is long enough: its begin is all that comes before it, pieces between matches and matches."""
    pattern = _quoted(rule.pattern)
    return f"""SELECT doc_id, row, {rank} AS rank, '{rule.kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: len(x))), 0)::BIGINT AS start, len(hits[i]) AS size
 FROM (SELECT doc_id, row, gaps, hits, judged, unnest(range(1, len(hits) + 1)) AS i FROM
  (SELECT doc_id, row, string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}, 0) AS hits, regexp_extract_all(text, {pattern}, {rule.group}) AS judged FROM docs WHERE regexp_matches(text, {pattern})))
 WHERE len(judged[i]) >= {rule.least}"""


_RULES = BASE_RULES + ADDED_RULES
_JOINED = "coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank)"
SECRET_SCAN = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_rule(rank, rule) for rank, rule in enumerate(_RULES))})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
 sha256({_JOINED} FILTER (rank < {len(BASE_RULES)}), '')) AS base_sha256, {_JOINED} FILTER (rank IS NOT NULL), '') AS spans
FROM docs d LEFT JOIN spans s ON s.row = d.row GROUP BY d.row, d.doc_id
"""

ORACLES = {"op2_suffix_dedup": REPEATED_PASSAGES, "op5_minhash_near_dedup": NEAR_DUPLICATES, "op9_secret_scan": SECRET_SCAN, "op10_source_mixing": SOURCE_MIXING}
