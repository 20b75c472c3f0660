"""Pieces of the oracles' SQL (DuckDB)."""

from __future__ import annotations

LINES = """lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
paged AS (SELECT *, CAST(floor(line_no / 20.0) AS BIGINT) + 1 AS page_number FROM lines)"""
BLOCKS = LINES + """,
blocks AS (SELECT doc_id, line_no AS position, page_number, trim(regexp_replace(line, '[ \\t　]+', ' ', 'g')) AS content FROM paged
           WHERE trim(regexp_replace(line, '[ \\t　]+', ' ', 'g')) <> '')"""
WORD = r"[\p{L}\p{N}_]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted(pattern)})"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {quoted(pattern)}))"


def role(c: str) -> str:
    """The role of a line of the documents, written for their alphabets: labels, steps, marks, numbered and worded headings."""
    number, rest = f"regexp_extract({c}, '^([0-9]+(?:[.][0-9]+)*)[.)、 ]', 1)", f"trim(regexp_extract({c}, '^[0-9]+(?:[.][0-9]+)*(?:[.)、]|\\s)\\s*(.+)$', 1))"
    words = f"regexp_extract_all({rest}, '[A-Za-z][A-Za-z0-9''/-]*')"
    title = f"(len({words}) > 0 AND NOT regexp_matches({rest}, '[.?!;]\\s*$') AND (len(list_filter({words}, lambda w: regexp_matches(w, '^[A-Z]'))) >= 0.7 * len({words}) OR len({words}) <= 3 OR len(regexp_extract_all({rest}, '\\p{{Lu}}')) >= 0.7 * greatest(len(regexp_extract_all({rest}, '\\p{{L}}')), 1)))"
    toc = f"regexp_matches({c}, '(?i)([.]\\s*){{2,}}\\s*([0-9]+|[A-Z]-?[0-9]+([-./][A-Z0-9]+)*|[IVXLCDM]{{1,7}}|not\\s+applicable|n/a|tbd)\\b')"
    short = f"(length({c}) <= 120 AND NOT {toc})"
    return f"""CASE WHEN {c} = '' THEN 'paragraph' WHEN regexp_matches({c}, '(?i)^note\\s*:') THEN 'note' WHEN regexp_matches({c}, '(?i)^warning\\s*:') THEN 'warning' WHEN regexp_matches({c}, '(?i)^caution\\s*:') THEN 'caution'
      WHEN regexp_matches({c}, '(?i)^definition\\s*:') OR regexp_matches({c}, '(?i)^["“'']?[^。；;:：]{{1,48}}["”'']?\\s+(means|refers\\s+to)\\b') THEN 'definition' WHEN regexp_matches({c}, '(?i)^procedure\\s*:') THEN 'procedure' WHEN regexp_matches({c}, '(?i)^step\\s+[0-9]+\\b') THEN 'procedure_step'
      WHEN regexp_matches({c}, '^([-•·▪◦]\\s+|[(][0-9]+[)]|[0-9]+[)])') THEN 'list_item' WHEN {short} AND regexp_matches({c}, '(?i)^(appendix|annex)') THEN 'appendix' WHEN {short} AND regexp_matches({c}, '(?i)^(chapter|section)\\s+[A-Z0-9.-]+') THEN 'body_section'
      WHEN {short} AND {rest} <> '' AND NOT regexp_matches({rest}, '[。；;]') AND contains({number}, '.') THEN 'clause'
      WHEN {short} AND {rest} <> '' AND NOT regexp_matches({rest}, '[。；;]') AND regexp_matches({c}, '^[0-9]+[.)、]') AND NOT (regexp_matches({c}, '^[0-9]+[.]') AND regexp_matches({rest}, '(?i)^[A-Z0-9]+[.][0-9]+\\s+\\S')) AND {title} THEN 'body_section'
      WHEN regexp_matches({c}, '(?i)^(([A-Z0-9]+[.])+[A-Z0-9]+|[0-9]+([.][0-9]+){{1,5}})[.、)]?\\s+\\S') THEN 'clause' WHEN {toc} THEN 'toc_entry' WHEN regexp_matches({c}, '(?i)list of effective pages|\\bpage\\s+[A-Z0-9./-]+') THEN 'lep_entry' ELSE 'paragraph' END"""


NUMERIC = "(length(content) > 0 AND len(regexp_extract_all(content, '[0-9]')) >= 0.6 * length(content))"
FURNITURE = f"(length(content) > 0 AND length(content) <= 80 AND ({NUMERIC} OR starts_with(lower(content), 'page ')))"
#: Documents differ from lines in having all; a second version of a corpus, for comparisons.
R4 = "floor(({x}) * 1e4 + 0.5) / 1e4"


def r4(x: str) -> str:
    return R4.format(x=x)
