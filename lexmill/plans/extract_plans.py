"""Text values, manuals and layout over orders, line items and documents.  Cases give a text and what has to come of it;
``{k}`` stands for the order's key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import extract as E
from lexmill.functions import roles
from lexmill.functions import text as X
from lexmill.operators import anatomy as A
from lexmill.operators import coverage as C
from lexmill.operators import docx as W
from lexmill.operators import segment as S
from lexmill.plans import sqltext as Q
from lexmill.plans.rule_plans import pick
from lexmill.registry import query, table


def literal(v: object) -> str:
    return "NULL" if v is None else Q.quoted(v) if isinstance(v, str) else str(v)


def filled(c: Column) -> Column:
    return F.replace(c, F.lit("{k}"), F.col("o_orderkey").cast("string"))


def cases(name: str, rows: list[tuple], made: Callable[..., Column]) -> None:
    """Register a query that makes a value of each case's first columns; its oracle is the cases' last column."""
    n = len(rows[0]) - 1
    values = ", ".join(f"({i}, {literal(r[-1])})" for i, r in enumerate(rows))

    @query(name, f"WITH v(n, made) AS (VALUES {values}) SELECT o_orderkey, replace(made, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS made FROM orders JOIN v ON n = o_orderkey % {len(rows)}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        ins = [filled(pick([r[i] for r in rows], F.col("o_orderkey") % len(rows)).cast("string")).alias(f"in{i}") for i in range(n)]
        return table(spark, d, "orders").select("o_orderkey", *ins).select("o_orderkey", made(*[F.col(f"in{i}") for i in range(n)]).alias("made"))


cases("certificates", [
    ("1 stc-0{k}A Holder 2020-01-02", "stc-0{k}A"), ("Unit PMA{k} by X", "PMA{k}"), ("plain AB1, then x9; 12a4;", "12a4"), ("no number here", None), (None, None), ("word xTC1 ok", "xTC1"), ("：A12，", None), ("编号：B7-9{k}。", "编号：B7-9{k}"),
], E.certificate)
cases("holders", [
    ("7 PMA{k} Acme  Aero 2020-03-04 and 2019/1/2", "PMA{k}", "2020-03-04", "7 Acme Aero and"), ("PMA{k}", "PMA{k}", None, None), (None, "a", "b", None), ("twice X X", "X", None, "twice X"), ("a" * 130, None, None, "a" * 120),
], E.holder)
cases("catalog_dates", [
    ("2020-1-2", "2020-01-02|"), ("2020年3月4日 (续)", "2020-03-04|date_text_contains_extra"), ("2020/1/2 2021.02.03", "2021-02-03|date_multiple_candidates"), ("soon", "|date_parse_failed"), ("", "|"), (None, "|"), ("12020-1-23", "|date_parse_failed"), ("（2020.1.2）", "2020-01-02|"),
], lambda c: F.concat(F.coalesce(E.catalog_date(c)["date"], F.lit("")), F.lit("|"), F.coalesce(E.catalog_date(c)["signal"], F.lit(""))))
cases("explicit_codes", [("ctso-c153", "CTSO-C153"), ("{k} CTSO-C9a", "CTSO-C9A"), ("CTSO C12, ctso-C12b and CTSO  C12", "CTSOC12,CTSO-C12B"), ("xCTSO-C1", ""), (None, ""), ("（CTSO-C90d）", "CTSO-C90D")], lambda c: F.array_join(E.explicit_codes(c), ","))
cases("wrap_blanks", [("中 国　商 飞 ACME 公 司 {k}", "中国商飞 ACME 公司 {k}"), (" a  b ", "a b"), (None, ""), ("甲\n乙", "甲乙")], E.without_wrap_blanks)
cases("part_doc_ids", [("doc {k}", "3", None), ("ok.{k}", "1", "ok.{k}-part-1"), ("ab_-.", "2", None), ("", "1", "doc-da39a3ee5e6b-part-1"), (None, "1", "doc-da39a3ee5e6b-part-1"), ("x" * 80, "9", "x" * 80 + "-part-9")], lambda p, i: F.when(p.rlike("^doc |^ab"), None).otherwise(E.part_doc_id(p, i)))
cases("reader_texts", [
    ("Wrapped line\nthat goes on.\nNext para-\ngraph {k}", "Wrapped line that goes on.\n\nNext paragraph {k}"), ("1. Item one\ncontinues here.\nNew sentence begins\nand ends.", "1. Item one continues here.\n\nNew sentence begins and ends."),
    ("(a) first\n(b) second\nmore", "(a) first\n\n(b) second more"), ("one line {k}", "one line {k}"), ("\n \r\n", ""), (None, ""), ("SECTION 2\ntext: \nend", "SECTION 2 text: end"), ("- a\n- b", "- a\n\n- b"),
], E.reader_text)
cases("identifiers", [(" ab–1{k}", "AB-1{k}"), ("x－y−z", "X-Y-Z"), ("", "")], X.identifier)
cases("boundary_joins", [("main-", "tain {k}", "maintain {k}"), ("发动", "机", "发动机"), ("a", "b", "a b"), ("A-", "B", "A- B")], X.join_boundary)
cases("sheet_columns", [("1", "A"), ("26", "Z"), ("27", "AA"), ("702", "ZZ"), ("703", "AAA"), ("0", "A"), ("18279", "AAAA"), ("-5", "A")], lambda c: E.sheet_column(c.cast("long")))
cases("sheet_values", [("3.0", "3"), ("2.5", "2.5"), (None, ""), ("-0.25", "-0.25"), ("100", "100")], lambda c: E.sheet_value(c.cast("double")))


_MANY = "intro\n(1) first\nmore\n" + "\n".join("plain" for _ in range(7)) + "\nNOTE: {k}\nend"
cases("toc_splits", [("A .... 1 B ... 2 C . . 3 tail {k}", "A .... 1|B ... 2|C . . 3\ntail {k}"), ("A .... 1 B .... 2", "A .... 1 B .... 2"), ("x ... IV\ny ... N/A\nz ... B-2", "x ... IV|y ... N/A|z ... B-2"), ("", "")], lambda c: F.array_join(S.split_toc(c), "|"))
cases("item_splits", [(_MANY, "intro|(1) first\nmore\n" + "\n".join("plain" for _ in range(7)) + "|NOTE: {k}\nend"), ("(1) a\n(2) b", "(1) a\n(2) b"), ("\n".join("x" for _ in range(12)), "\n".join("x" for _ in range(12)))], lambda c: F.array_join(S.split_structural(c), "|"))
cases("inline_splits", [("y" * 120 + " (1) one (b) two {k}", "y" * 120 + "|(1) one|(b) two {k}"), ("short (1) a (2) b", "short (1) a (2) b"), ("z" * 130 + " (1) only", "z" * 130 + " (1) only")], lambda c: F.array_join(S.split_inline(c), "|"))


_PAGE = ["Index Name P/N or Type Manufacturer", "1 A wrench for the large bolts", "made by Acme", "of London", "NOTE: ask first", "or later", "{k}", "2 B hammer with a wooden shaft"]
_CHANGED = ["HIGHLIGHTS of {k}", "CHAPTER/Section/Page Description of Change", "Pages 505 and 506", "Changed to new limits of the torque values in the second table of the chapter", "Updated the table", "Added step on page 7", "Added note on page 8", "Some text without page"]


def _paragraphs(spark: SparkSession, d: str, lines: list[str]) -> DataFrame:
    """A page of paragraphs for each order; pages of every third order lack the first line, and so the header."""
    rows = F.posexplode(F.array(*map(F.lit, lines)))
    return table(spark, d, "orders").select("o_orderkey", rows.alias("position", "content")).where("o_orderkey % 3 > 0 or position > 0").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), "position", filled(F.col("content")).alias("content"))


def _merged_sql(with_header: list[str], without: list[str]) -> str:
    rows = ", ".join(f"({int(head)}, {i}, {Q.quoted(t)})" for head, texts in ((True, with_header), (False, without)) for i, t in enumerate(texts))
    return f"WITH v(h, n, t) AS (VALUES {rows}) SELECT o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY n) AS n, replace(t, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS content FROM orders JOIN v ON h = (o_orderkey % 3 > 0)::INT"


def _numbered(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return df.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("position")).cast("long").alias("n"), "content")


@query("table_row_merge", _merged_sql([_PAGE[0], "\n".join(_PAGE[1:4]), _PAGE[4], "\n".join(_PAGE[5:7]), _PAGE[7]], _PAGE[1:]))
def table_row_merge(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(S.merge_table_rows(_paragraphs(spark, d, _PAGE)))


@query("change_merge", _merged_sql([*_CHANGED[:2], "\n".join(_CHANGED[2:4]), _CHANGED[4], "\n".join(_CHANGED[5:7]), _CHANGED[7]], _CHANGED[1:]))
def change_merge(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(S.merge_changes(_paragraphs(spark, d, _CHANGED)))


cases("docx_noise", [("tmp_{k} file", "parse_artifact"), ("Rev {k}", "version_cell"), ("{k}-2", "page_ref_cell"), ("第 {k} 页", "header_footer"), ("ATA {k}.1", "header_footer"), ("2024-1-2", "page_ref_cell"), ("text {k} of it", None), ("", None)], W.noise)
cases("docx_page_labels", [("页码：3-{k}", "3-{k}"), ("Intro 3-{k}", "3-{k}"), ("IV 至 VI", "IV 至 VI"), ("一/2", "一/2"), ("no page here", None), (None, None)], W.page_label)
cases("docx_headings", [("1.{k} Scope 2-3", "1.{k} Scope|body_section|2-3|2"), ("附件{k} 表", "附件{k} 表|appendix||1"), ("第2章  总则", "第2章 总则|body_section||1"), ("{k}) Tools", "{k} Tools|body_section||1"), ("words {k} on", None), ("3-{k}", None)],
      lambda c: roles._let(W.numbered_heading(c), lambda h: F.when(h.isNotNull(), F.concat_ws("|", h["content"], h["role"], F.coalesce(h["label"], F.lit("")), h["level"].cast("string")))))
cases("worth_refining", [("(1) Step one (2) then (a) more " + "x" * 40, "true"), ("(1) Step one (2) then", "false"), ("1. NOTE: (a) b " + "x" * 60, "true"), ("plain words without marks, Step " + "x" * 60, "false"), ("(1) a (2) b (3) c nothing named " + "x" * 60, "false"), ("", "false")], lambda c: S.worth_refining(c, 60, 2).cast("string"))
cases("action_suggestions", [
    ("accept", "rechunk_document", "f", "p", ""), ("local_rerun", "local_provider_rerun", "f", "p", "rerun_warning_parts,inspect_provider_route_plan,reparse_document,review_quality"), ("local_rerun", "local_provider_rerun", None, None, "inspect_provider_route_plan,reparse_document"),
    ("accept_with_warning", "reembed_document", "f", None, "reembed_document,review_quality"), ("accept_with_warning", "other_action", None, None, "other_action"), ("accept_with_warning", None, "f", "p", "review_quality"), ("disabled", "review_parse_ir", "f", "p", ""),
], lambda g, a, f, p: _offered(g, a, f, p))


def _offered(gate: Column, action: Column, flag: Column, part: Column) -> Column:
    """The operator's column for one row, with its inputs as columns."""
    none = F.array().cast("array<string>")
    many = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    return F.array_join(C.offers(F.lit("d"), gate, action, many(flag), many(part)), ",")


@query("sheet_ranges", """WITH r AS (SELECT o_orderkey AS k, 1 + o_orderkey % 9 AS r0, 1 + o_custkey % 5 AS c0, 1 + o_orderkey % 9 + o_custkey % 4 AS r1, 1 + o_custkey % 5 + o_orderkey % 3 AS c1 FROM orders)
 SELECT k, chr(CAST(64 + c0 AS INT)) || r0 || ':' || chr(CAST(64 + c1 AS INT)) || r1 AS ref, greatest(r0, 4) <= least(r1, 6) AND greatest(c0, 2) <= least(c1, 3) AS meets FROM r""")
def sheet_ranges(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    box = [1 + k % 9, 1 + c % 5, 1 + k % 9 + c % 4, 1 + c % 5 + k % 3]
    return table(spark, d, "orders").select(k.alias("k"), E.sheet_range(*box).alias("ref"), E.ranges_meet(box, [F.lit(4), F.lit(2), F.lit(6), F.lit(3)]).alias("meets"))


# An item of a manual: its kind, role, text, and the role in the manual that it has.
_ITEMS = [
    ("paragraph", "paragraph", "1.2 Scope", "body_section"), ("paragraph", "paragraph", "The valve is opened by hand before work", None), ("table", "table", "Record of revisions", "revision_record"), ("paragraph", "toc_entry", "Intro ... 1", "toc_entry"),
    ("paragraph", "header_footer", "Page 1", None), ("paragraph", "paragraph", "APPENDIX B", "appendix"), ("paragraph", "paragraph", "PRE SB 12-345", "revision_record"), ("paragraph", "paragraph", '3.A Branch "X"', None), ("table", "table", "Torque values", None),
    ("title", "title", "Manual", None), ("paragraph", "paragraph", "Chapter 3 Tools:\nUse the tools of the second list", "body_section"), ("paragraph", "paragraph", "Distribution list", "distribution_list"), ("paragraph", "paragraph", "", None), ("paragraph", "front_matter", "Highlights of it", "front_matter"),
    ("paragraph", "paragraph", "GENERAL NOTES", "body_section"), ("paragraph", "paragraph", "7 Removal of the Pump", "body_section"), ("paragraph", "paragraph", "7 removal of the pump", None),
]
_I = f"""v(n, kind, role, t, m) AS (VALUES {", ".join(f"({i}, {', '.join(map(literal, r))})" for i, r in enumerate(_ITEMS))}),
 i AS (SELECT o_custkey AS doc, o_orderkey AS pos, kind, role, t, m, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 END AS page FROM orders JOIN v ON n = (o_orderkey // 2) % {len(_ITEMS)})"""


def items(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.col("o_orderkey") / 2) % len(_ITEMS)
    kind, role, text = (pick([r[i] for r in _ITEMS], n) for i in range(3))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("position"), kind.alias("kind"), role.alias("semantic_role"), text.alias("text"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 9).alias("page_number"))
    return A.manual_role(o)


@query("manual_roles", f"WITH {_I} SELECT pos AS position, m AS manual_role FROM i")
def manual_roles(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("position", "manual_role")


@query("manual_anatomy", f"""WITH {_I} SELECT doc AS doc_id, count(*) FILTER (role IN ('front_matter', 'toc_entry') OR m IN ('front_matter', 'revision_record', 'distribution_list')) AS front_matter_items, count(*) FILTER (m = 'body_section') AS body_sections, count(*) FILTER (m = 'appendix' OR kind = 'table') AS tables_and_appendices,
 count(*) FILTER (role = 'header_footer') AS suspected_noise, coalesce(string_agg(string_split(t, chr(10))[1], ' / ' ORDER BY pos) FILTER (m IN ('body_section', 'appendix')), '') AS chapters FROM i GROUP BY ALL""")
def manual_anatomy(spark: SparkSession, d: str) -> DataFrame:
    return A.anatomy(items(spark, d)).withColumn("chapters", F.array_join("chapters", " / "))


@query("structure_quality", f"""WITH {_I}, h AS (SELECT *, coalesce(m IN ('body_section', 'appendix'), false) AS op, contains(t, chr(10)) AS inl, coalesce(page > 0, false) AS loc, (m IS NULL OR m NOT IN ('front_matter', 'toc_entry', 'revision_record', 'distribution_list', 'body_section', 'appendix')) AND role NOT IN ('header_footer', 'front_matter', 'toc_entry') AND t <> '' AS fol FROM i),
 s AS (SELECT *, sum(op::INT) OVER (PARTITION BY doc ORDER BY pos) AS sec FROM h),
 g AS (SELECT doc, sec, bool_or(op) AS hd, bool_or(op AND inl) AS inl, bool_or(op AND loc) AS hl, arg_min(kind, pos) FILTER (fol) AS bk, arg_min(loc, pos) FILTER (fol) AS bl, count(*) AS n, count(*) FILTER (m IN ('front_matter', 'body_section', 'appendix')) AS hi, count(*) FILTER (role = 'header_footer') AS nz, count(*) FILTER (role = 'toc_entry') AS tc FROM s GROUP BY ALL),
 d AS (SELECT doc, sum(n) AS n, sum(hi) AS hi, count(*) FILTER (hd) AS bh, sum(nz) AS nz, sum(tc) AS tc, count(*) FILTER (hd AND (inl OR bk IS NOT NULL)) AS bd, count(*) FILTER (hd) + count(*) FILTER (hd AND NOT inl AND bk = 'table') AS rl, count(*) FILTER (hd AND hl) + count(*) FILTER (hd AND NOT inl AND bk = 'table' AND bl) AS ev FROM g GROUP BY ALL),
 r AS (SELECT *, tc / greatest(tc, 1) AS a, bh / greatest(hi, 1) AS b, nz / greatest(n, 1) AS c, bd / greatest(bh, 1) AS e, ev / greatest(rl, 1) AS f FROM d)
 SELECT doc AS doc_id, {Q.r4('a')} AS directory_recognition_rate, {Q.r4('b')} AS chapter_coverage_rate, {Q.r4('c')} AS noise_ratio, {Q.r4('e')} AS heading_body_binding_rate, {Q.r4('f')} AS evidence_binding_strength, {Q.r4('(0.0 + a + b + (1.0 - c) + e + f) / 5.0')} AS score,
 CAST(n AS BIGINT) AS items, CAST(hi AS BIGINT) AS heading_items, bh AS body_like_headings, CAST(nz AS BIGINT) AS noise_items, CAST(tc AS BIGINT) AS toc_items FROM r""")
def structure_quality(spark: SparkSession, d: str) -> DataFrame:
    return A.structure_quality(items(spark, d))


@query("page_types", """WITH p AS (SELECT o_orderkey AS k, o_orderkey % 5 AS toc, o_custkey % 4 AS fm, 1 + o_custkey % 3 AS par, ['plain', 'Signature Page 1', 'see Annex B', ''][o_orderkey % 4 + 1] AS t, o_custkey % 2 + 1 AS page FROM orders), s AS (SELECT *, toc + fm + par AS n FROM p)
 SELECT k, CASE WHEN toc / n >= 0.4 THEN 'toc' WHEN fm / n >= 0.4 THEN 'front_matter' WHEN t LIKE 'Sig%' THEN 'signature' WHEN t LIKE '%Annex%' THEN 'appendix' WHEN page = 1 AND t = '' THEN 'cover' ELSE 'body' END AS page_type,
 CASE WHEN toc / n >= 0.4 THEN CASE WHEN toc / n >= 0.7 THEN 'high' ELSE 'medium' END WHEN fm / n >= 0.4 THEN CASE WHEN fm / n >= 0.7 THEN 'high' ELSE 'medium' END WHEN t LIKE '%Annex%' THEN 'medium' ELSE 'high' END AS confidence FROM s""")
def page_types(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    many = lambda role, n: F.array_repeat(F.lit(role), n.cast("int"))
    roles = F.concat(many("toc_entry", k % 5), many("revision_record", c % 4), many("paragraph", 1 + c % 3))
    text = pick(["plain", "Signature Page 1", "see Annex B", ""], k % 4)
    return table(spark, d, "orders").select(k.alias("k"), A.page_type_with_confidence(c % 2 + 1, roles, text, F.lit(True), text).alias("p")).select("k", "p.*")


@query("layout_signals", """WITH b AS (SELECT l_orderkey % 100 AS doc, l_partkey % 7 AS page, l_linenumber AS ln, l_quantity AS q, l_suppkey AS sk FROM lineitem),
 p AS (SELECT doc, page, bool_or(ln = 1 OR ln = 2) AS a, bool_or(sk % 5 > 1) AS b, bool_or(ln = 3) AS c, count(*) FILTER (ln = 3) AS cn, bool_or(q > 40) AS d, count(*) FILTER (q > 40) AS dn, bool_or(q > 45) AS e, count(*) FILTER (q > 45) AS en, bool_or(ln = 5) AS f, count(*) FILTER (ln = 5) AS fn, max(CASE WHEN q > 25 THEN q - 25 END)::DOUBLE AS t1, max(sk % 3)::DOUBLE AS t2 FROM b GROUP BY ALL)
 SELECT doc AS doc_id, count(*) FILTER (a) AS layout_pages, count(*) FILTER (b) AS multi_column_pages, count(*) FILTER (c) AS stripped_pages, count(*) FILTER (d) AS attempted_pages, count(*) FILTER (e) AS fallback_pages, count(*) FILTER (f) AS failed_pages, CAST(sum(cn) AS BIGINT) AS stripped_blocks, CAST(sum(dn) AS BIGINT) AS attempted_blocks,
 CAST(sum(en) AS BIGINT) AS fallback_blocks, CAST(sum(fn) AS BIGINT) AS failed_blocks, coalesce(sum(t1), 0) AS layout_elapsed_s, sum(t2) AS crops, coalesce(max(t1), 0) AS most_layout_elapsed_s, max(t2) AS most_crops FROM p GROUP BY ALL""")
def layout_signals(spark: SparkSession, d: str) -> DataFrame:
    ln, q, sk = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_suppkey")
    b = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("doc_id"), (F.col("l_partkey") % 7).alias("page_number"), F.when(ln == 1, "pdf").when(ln == 4, "").alias("layout_source"), F.when(ln == 2, 600.0).alias("page_width"), F.lit(None).cast("double").alias("page_height"), F.when(sk % 5 > 0, sk % 5).alias("columns"),
        F.when(ln == 3, True).alias("stripped"), (q > 40).alias("ocr_attempted"), (q > 45).alias("ocr_fallback"), F.when(ln == 5, "x").alias("ocr_error"), (q - 25).alias("layout_elapsed_s"), (sk % 3).alias("crops"),
    )
    return A.layout_signals(b, ["layout_elapsed_s", "crops"])


@query("quality_delta", """WITH a AS (SELECT l_suppkey AS doc, count(*) AS b, max(l_quantity) AS m FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL), c AS (SELECT l_suppkey AS doc, count(*) AS b, max(l_quantity) AS m FROM lineitem WHERE l_linenumber >= 4 GROUP BY ALL)
 SELECT doc AS doc_id, c.b - a.b AS total_blocks, c.m - a.m AS max_length FROM a JOIN c USING (doc)""")
def quality_delta(spark: SparkSession, d: str) -> DataFrame:
    side = lambda test: table(spark, d, "lineitem").where(test).groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.count("*").alias("total_blocks"), F.max("l_quantity").alias("max_length"))
    return A.report_delta(side("l_linenumber < 4"), side("l_linenumber >= 4"), ["doc_id"], ["total_blocks", "max_length"])


@query("structure_tags", """SELECT o_orderkey, concat_ws(',', 'role:' || o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN 'page:' || o_orderkey % 3 END, 'parser:x') AS tags FROM orders""")
def structure_tags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(E.tags(F.col("o_orderpriority"), F.when(k % 3 > 0, (k % 3).cast("string")), F.lit("x"), F.lit(" ")), ",").alias("tags"))
