"""Golden cases for semantics that the generated tables do not show."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions import roles, text
from lexmill.operators import catalog, control, coverage, geometry, metrics, search, segment, tables
from lexmill.sources import readers, sinks
from lexmill.streaming import jobs


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column(F.col("v"))).collect()]


def test_search_tokens(spark):
    assert one(spark, text.search_tokens, "发动机维护 Task-5 X_1 Été", "件", "", None) == [["发动", "动机", "机维", "维护", "task", "5", "x_1", "été"], ["件"], [], []]
    assert search.tokens_of("发动机维护 Task-5 X_1 Été") == ["发动", "动机", "机维", "维护", "task", "5", "x_1", "été"]


def test_keyword_score(spark):
    df = spark.createDataFrame([("a b a a a c",), ("x",), ("",)], "t string")
    got = [r[0] for r in df.select(search.keyword_score(F.col("t"), "a d")).collect()]
    assert got == [pytest.approx(1.5 / 2 + 0.25), 0.0, 0.0]


def test_garble(spark):
    reasons = one(spark, lambda c: text.garble_reason(text.garble(c)), "", "(cid:12)(cid:13)(cid:14)(cid:15)(cid:16)", "/1 /2 /3 /i4 /5 /6", "ab\x01\x02c", "ab ab ab ab cd", "a plain sentence of words", "中文" * 20 + "a")
    assert reasons == ["empty_text", "cid_dense", "pdf_name_dense", "control_char_dense", "repeated_short_tokens", None, None]


def test_roles(spark):
    cases = {
        "NOTE: mind": "note", "警告：热": "warning", "Caution : x": "caution", "A term means nothing": "definition", "Step 3 go": "procedure_step", "• item": "list_item", "CHAPTER 2 GENERAL": "body_section",
        "第3章 总则": "body_section", "第5条 内容": "clause", "Appendix A Tables": "appendix", "1.2.3 the long sentence that ends here.": "clause", "Intro ..... 12": "toc_entry", "see Page 3-1": "lep_entry", "": "paragraph", "plain words.": "paragraph",
    }
    assert one(spark, roles.semantic_role, *cases) == list(cases.values())


def test_dates_and_joins(spark):
    assert one(spark, text.last_date, "2020-13-01", "on 2020/2/3 and 2021.12.31", None) == [None, "2021-12-31", None]
    df = spark.createDataFrame([("main-", "tain"), ("发动", "机"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(text.join_boundary(F.col("a"), F.col("b"))).collect()] == ["maintain", "发动机", "a b"]
    assert one(spark, text.identifier, " ab–12 ") == ["AB-12"]


def test_splits(spark):
    assert one(spark, segment.split_toc, "A .... 1 B .... 2 C .... 3 tail", "A .... 1") == [["A .... 1", "B .... 2", "C .... 3\ntail"], ["A .... 1"]]
    lines = "\n".join(["intro"] + [f"({i}) item\nmore" for i in range(5)])
    assert len(one(spark, segment.split_structural, lines)[0]) == 6
    long = "x" * 120 + " (1) first (2) second"
    assert one(spark, segment.split_inline, long, "short (1) a (2) b") == [["x" * 120, "(1) first", "(2) second"], ["short (1) a (2) b"]]


def test_merge_across_pages(spark):
    rows = [(1, 0, 1, "paragraph", "This sentence goes over the"), (1, 1, 2, "paragraph", "page break and, as it"), (1, 2, 3, "paragraph", "happens, the next one."), (1, 3, 4, "paragraph", "lower but after a stop"), (1, 4, 5, "heading", "Title")]
    got = segment.merge_across_pages(spark.createDataFrame(rows, "doc_id long, position int, page_number int, semantic_role string, content string")).orderBy("position").collect()
    assert [(r.page_start, r.page_end, r.merged) for r in got] == [(1, 3, 3), (4, 4, 1), (5, 5, 1)] and got[0].content.endswith("as it happens, the next one.")


def test_captions_and_text_records(spark):
    rows = [(1, 0, "Figure 1"), (1, 1, "the caption"), (1, 2, "Fig. 2"), (1, 3, "Fig. 3"), (1, 4, "body")]
    got = [r.content for r in segment.caption_pairs(spark.createDataFrame(rows, "doc_id long, position int, content string")).orderBy("position").collect()]
    assert got == ["Figure 1\nthe caption", "Fig. 2\nFig. 3", "body"]
    lines = spark.createDataFrame([(1, i, 1 + i // 3, t) for i, t in enumerate(["head", "1. AB-1 made 2020-1-2", "more", "2) next", "end 2021/3/4"])], "doc_id long, line_no int, page_number int, line string")
    got = tables.text_records(lines).orderBy("row_number").collect()
    assert [(r.row_number, r.text, r.latest_date, r.page_start, r.page_end) for r in got] == [(1, "AB-1 made 2020-1-2 more", "2020-01-02", 1, 1), (2, "next end 2021/3/4", "2021-03-04", 2, 2)]


def test_table_continuation(spark):
    t = [(1, "a", 1, ["k", "x"], ["r1", "r2"], 3), (1, "b", 3, ["k", "y"], ["r1", "r2"], 3), (1, "c", 4, ["k", "y"], ["r3", "r4"], 3), (1, "d", 9, ["k", "y"], ["r5", "r6"], 3)]
    got = tables.continuations(spark.createDataFrame(t, "doc_id long, table_id string, page int, header array<string>, labels array<string>, rows int")).orderBy("page").collect()
    assert [(r.kind, r.group_id, r.continues_from) for r in got] == [(None, "1:tblgrp:p1", None), ("column_continuation", "1:tblgrp:p1", "a"), ("row_continuation", "1:tblgrp:p1", "b"), (None, None, None)]
    assert (got[0].span_start, got[0].span_end) == (1, 4)


def test_record_filter_rejects_inverted_ranges(spark):
    with pytest.raises(ValueError, match="invalid_page_range"):
        tables.filter_records(spark.range(1), page_start=3, page_end=2)


def test_percentiles(spark):
    values = [float(v) for v in (5, 1, 4, 2, 3, 9)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    r = metrics.nearest_rank_by(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (r.p50, r.p90) == (3.0, 5.0)  # index round-half-even(2.5) = 2, round(4.5) = 4
    assert df.groupBy("k").agg(metrics.nearest_rank(F.collect_list("v"), 0.5)).first()[1] == 3.0


def test_redaction_and_delay(spark):
    df = spark.createDataFrame([({"api_key": "x", "name": "y"}, 4)], "m map<string,string>, n int")
    r = df.select(metrics.redact(F.col("m")), metrics.retry_delay(F.col("n"))).first()
    assert r[0] == {"api_key": "[redacted]", "name": "y"} and r[1] == 8.0


def test_partition_of_lines():
    import itertools
    import random

    rng = random.Random(3)
    assert catalog.best_partition([10, 30], [9, 11, 29, 31]) == [0, 0, 1, 1]
    assert catalog.best_partition([10, 30], [10]) is None and catalog.best_partition([], [1]) is None and catalog.best_partition([10], []) is None
    assert catalog.best_partition([10, 60], [9, 11, 30]) is None  # no line near the second anchor
    for _ in range(60):
        anchors = sorted(rng.sample(range(0, 200, 12), rng.randrange(1, 5)))
        lines = sorted([a + rng.uniform(-3, 3) for a in anchors] + [rng.uniform(0, 200) for _ in range(rng.randrange(0, 5))])
        steps = sorted(b - a for a, b in zip(anchors, anchors[1:], strict=False))
        scale = max(0.6 * (steps[len(steps) // 2] if steps else 12.0), 4.0)

        def cost(cuts):
            edges = [0, *cuts, len(lines)]
            return sum(((sum(lines[s:e]) / (e - s) - a) / scale) ** 2 for a, s, e in zip(anchors, edges, edges[1:], strict=False))

        best = min(cost(c) for c in itertools.combinations(range(1, len(lines)), len(anchors) - 1))
        got = catalog.best_partition(anchors, lines)
        assert abs(cost([i for i in range(1, len(got)) if got[i] != got[i - 1]]) - best) < 1e-9


def test_diff_cascade(spark):
    cols = "doc_id long, unit_id string, position int, unit_fingerprint string, content_fingerprint string, structure_fingerprint string"
    old = [(1, "a", 0, "u1", "c1", "s1"), (1, "b", 1, "u2", "c2", "s2"), (1, "c", 2, "u3", "c3", "s3"), (1, "d", 3, "u4", "c4", "s4"), (1, "e", 4, "", "cx", ""), (1, "f", 5, "", "cx", ""), (1, "g", 6, "u9", "c9", "s9")]
    new = [(1, "a", 0, "u1", "c1", "s1"), (1, "b", 1, "n2", "c2", "s2"), (1, "c", 2, "n3", "c3", "t3"), (1, "d", 3, "n4", "d4", "s4"), (1, "e", 4, "", "cx", ""), (1, "h", 7, "n8", "n8", "n8")]
    got = coverage.diff_units(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols)).collect()
    assert sorted((r.p_unit_id or "", r.c_unit_id or "", r.status, r.confidence) for r in got) == [
        ("", "h", "added", 1.0), ("a", "a", "unchanged", 1.0), ("b", "b", "unchanged", 0.99), ("c", "c", "relocated", 0.95), ("d", "d", "changed", 0.9), ("e", "e", "unknown", 0.4), ("f", "", "removed", 1.0), ("g", "", "removed", 1.0),
    ]


def test_bands_and_gaps(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 30.0, "a"), (1, 1, 0.0, 5.0, 10.0, 8.0, "b"), (1, 1, 0.0, 31.0, 10.0, 35.0, "c"), (1, 1, 0.0, 60.0, 10.0, 64.0, "d")]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, x0 double, top double, x1 double, bottom double, text string")
    assert sorted((r.top, r.bottom, r.lines) for r in geometry.bands(df, 2.0).collect()) == [(0.0, 35.0, 3), (60.0, 64.0, 1)]
    assert geometry.text_with_gaps(df).first().page_text == "a\nb\n\nc\n\nd"


def test_front_matter(spark):
    assert one(spark, readers.strip_front_matter, "---\na: 1\n---\nbody", "plain", "---\n...\nx") == ["body", "plain", "x"]
    with pytest.raises(Exception, match="front matter"):
        one(spark, readers.strip_front_matter, "---\na: 1\nbody")


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr>{cell("a", "<w:gridSpan w:val=\"2\"/>")}{cell("b", "<w:vMerge w:val=\"restart\"/>")}</w:tr><w:tr>{cell("c")}{cell("d")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "y.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="A"/><sheet name="B" state="hidden"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>key</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>3.0</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {s}><sheetData><row><c r="A1"><v>9</v></c></row></sheetData></worksheet>')
    rows = readers.read_office(spark, str(tmp_path)).collect()
    assert sorted((r.type, r.content, r.level, r.row_index, r.col_index, r.row_span, r.col_span) for r in rows if r.doc == "x.docx" and r.type != "table") == [("paragraph", "Text", None, None, None, None, None), ("title", "Head", 2, None, None, None, None)]
    assert sorted((r.content, r.row_index, r.col_index, r.row_span, r.col_span) for r in rows if r.doc == "x.docx" and r.type == "table") == [("a", 0, 0, 1, 2), ("b", 0, 2, 2, 1), ("c", 1, 0, 1, 1), ("d", 1, 1, 1, 1)]
    assert sorted((r.content, r.row_index, r.col_index) for r in rows if r.doc == "y.xlsx") == [("3", 1, 27), ("key", 0, 0)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1, 2], True), (2, 'a,"b"', None, False)], "id long, t string, l array<int>, b boolean")
    for fmt in sinks.FORMATS:
        sinks.export(df, f"{tmp_path}/{fmt}", fmt)
    assert sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').fillna("").collect()) == [("1", "", "[1,2]", "true"), ("2", 'a,"b"', "", "false")]
    import sqlite3

    assert sqlite3.connect(f"{tmp_path}/sqlite").execute("select id, b from rows order by id").fetchall() == [("1", "true"), ("2", "false")]
    m = sinks.export_package({"records": df, "lines": df.limit(1)}, f"{tmp_path}/package")
    assert {r.dataset: r["rows"] for r in m.collect()} == {"records": 2, "lines": 1}
    sinks.append_events(spark.createDataFrame([({"token": "t"},)], "fields map<string,string>"), f"{tmp_path}/events")
    assert json.loads(spark.read.text(f"{tmp_path}/events").first().value)["fields"]["token"] == "[redacted]"


def test_save_by_document(spark, tmp_path):
    schema = "tenant_id string, doc_id long, v int"
    sinks.save_by_document(spark.createDataFrame([("t", 1, 1), ("t", 2, 2)], schema), f"{tmp_path}/d")
    sinks.save_by_document(spark.createDataFrame([("t", 2, 9)], schema), f"{tmp_path}/d")
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(f"{tmp_path}/d").collect()) == [(1, 1), (2, 9)]


def test_streaming_merge(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/ck")
    schema = "tenant_id string, doc_id long, part int, seq int, text string, ts timestamp, user_id long"
    import datetime

    ts = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("t", 1, 0, 1, "old", ts, 1), ("t", 1, 1, 1, "keep", ts, 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    run = lambda: jobs.drain(jobs.event_stream(spark, f"{tmp_path}/in/*", schema, 1), f"{tmp_path}/q", jobs.merge_into(f"{tmp_path}/out", ["tenant_id", "doc_id", "part"], "seq"))
    run()
    spark.createDataFrame([("t", 1, 0, 2, "new", ts, 1), ("t", 2, 0, 1, "other", ts, 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()
    assert sorted((r.doc_id, r.part, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 0, "new"), (1, 1, "keep"), (2, 0, "other")]


def test_streaming_deduplication(spark, tmp_path):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t), (1, t), (2, t)], "event_id long, ts timestamp").write.parquet(f"{tmp_path}/in")
    s = jobs.deduplicated(jobs.event_stream(spark, f"{tmp_path}/in", "event_id long, ts timestamp"), ["event_id"])
    got = []
    jobs.drain(s, f"{tmp_path}/ck", lambda b, i: got.extend(r.event_id for r in b.collect()))
    assert sorted(got) == [1, 2]


def test_outbox_and_claim(spark):
    key = "tenant_id string, doc_id long, run_id long, event_type string"
    e = spark.createDataFrame([("t", 1, 1, "published"), ("t", 1, 1, "published"), ("t", 2, 1, "published")], key)
    assert [r.doc_id for r in control.outbox(e, e.where("doc_id = 2")).collect()] == [1]


def test_dispatch_and_delimited(spark, tmp_path):
    files = spark.createDataFrame([("a.md", None), ("b.bin", "text/plain"), ("c.zip", None)], "path string, media_type string")
    got = [r.parser for r in readers.dispatch(files, [("markdown", "text/markdown", ".md"), ("text", "text/plain", ".txt")]).collect()]
    assert got == ["markdown", "text", None]
    (tmp_path / "t.csv").write_text('a,"b,1"\nc,\n')
    assert sorted((r.table_id, r.row_index, r.col_index, r.text) for r in readers.read_delimited(spark, str(tmp_path)).collect()) == [("t", 0, 0, "a"), ("t", 0, 1, "b,1"), ("t", 1, 0, "c"), ("t", 1, 1, "")]
    assert io is not None


BOX = "doc_id long, page_number int, x0 double, top double, x1 double, bottom double"


def boxes(spark, rows, more=""):
    return spark.createDataFrame([(1, 1, *map(float, r[:4]), *r[4:]) for r in rows], BOX + more)


def corners(df):
    return sorted((r.x0, r.top, r.x1, r.bottom) for r in df.collect())


def test_figure_lines(spark):
    words = boxes(spark, [(50, 13, 60, 20, "c"), (0, 10, 9, 18, "a"), (20, 12, 30, 19, " b  b "), (0, 13.5, 9, 20, "d"), (0, 30, 9, 38, "e"), (9, 30, 12, 38, " ")], ", text string")
    got = [(r.text, r.x0, r.top, r.x1, r.bottom) for r in geometry.figure_lines(words).orderBy("top").collect()]
    assert got == [("a b b c", 0, 10, 60, 20), ("d", 0, 13.5, 9, 20), ("e", 0, 30, 9, 38)]


def test_figure_rules(spark):
    page = ", page_width double, page_height double, confidence double"
    rows = [(100, 300, 200, 400), (100, 300, 110, 400), (0, 0, 590, 790), (100, 300, 120, 320), (100, 10, 200, 50), (5, 100, 60, 140), (300, 500, 400, 600)]
    figures = boxes(spark, [(*r, 600.0, 800.0, s) for r in rows for s in (0.15, 0.9)], page)
    got = geometry.keep_figures(figures, boxes(spark, [(300, 500, 380, 600)]))
    assert sorted((r.x0, r.top, r.confidence) for r in got.collect()) == [(0, 0, 0.9), (5, 100, 0.9), (100, 10, 0.9), (100, 300, 0.15), (100, 300, 0.9), (100, 300, 0.9)]
    d = spark.createDataFrame([("第 3 页图示区域", False, False), ("Figure 1", True, True), ("Figure 1", True, False), ("A flow chart", False, False), ("Valve", False, True), ("图 2 组织机构图", False, False), ("", False, False), ("Layout", False, False), ("Photo", False, False), ("Graph", False, False)], "d string, l boolean, a boolean")
    got = d.select(geometry.caption_confidence(F.col("d"), F.col("l"), F.col("a")).alias("c"), geometry.figure_kind(F.col("d")).alias("k")).collect()
    assert [(r.c, r.k) for r in got] == [(0.15, "generic"), (0.95, "figure"), (0.9, "figure"), (0.9, "flowchart"), (0.65, "figure"), (0.9, "structure"), (0.65, "generic"), (0.65, "diagram"), (0.9, "illustration"), (0.65, "chart")]


def test_ocr_regions_and_lines(spark):
    page = ", unusable boolean, page_width double, page_height double"
    lines = [(0, 100, 50, 110, True), (0, 120, 60, 130, True), (0, 160, 50, 170, True), (0, 300, 50, 310, True), (0, 200, 50, 210, False)]
    at = boxes(spark, [(*r, 600.0, 800.0) for r in lines], page)
    assert corners(geometry.ocr_regions(at, boxes(spark, [(40, 305, 90, 400)]))) == [(0, 100, 60, 130), (0, 160, 50, 170)]
    many = boxes(spark, [(0, 100 * k, 50, 100 * k + 10, True, 600.0, 800.0) for k in range(5)], page)
    assert geometry.ocr_regions(many, boxes(spark, [])).count() == 0
    images = [(0, 0, 200, 200), (0, 300, 200, 500), (300, 0, 500, 300), (0, 0, 20, 20), (0, 0, 600, 700), (300, 400, 500, 600)]
    got = geometry.image_regions(boxes(spark, [(*r, 600.0, 800.0) for r in images], ", page_width double, page_height double"), boxes(spark, [(10, 310, 90, 320)]), boxes(spark, [(490, 590, 600, 700)]))
    assert corners(got) == [(0, 0, 200, 200), (300, 0, 500, 300)]
    native = boxes(spark, [(0, 10, 50, 20, "good line", False), (0, 30, 50, 40, "b@d", True), (0, 90, 50, 99, "label", False)], ", text string, replaced boolean")
    ocr = boxes(spark, [(1, 11, 49, 19, "goodline", 1), (0, 30, 50, 40, "bad", 2), (0, 35, 50, 45, "b ad", 3), (0, 41, 50, 49, "bad", 4), (0, 60, 50, 70, "label", 5), (0, 80, 9, 85, " ", 6)], ", text string, line_index int")
    got = [(r.position, r.text, r.top) for r in geometry.merge_ocr_lines(native, ocr).orderBy("position").collect()]
    assert got == [(1, "good line", 10), (2, "bad", 30), (3, "bad", 41), (4, "label", 60), (5, "label", 90)]
    more = ", rendered_width double, rendered_height double, page_width double, page_height double, source_width double, source_height double, origin_x double, origin_top double"
    r = boxes(spark, [(10, 20, 30, 40, 300.0, 400.0, 600.0, 800.0, None, None, None, None), (10, 20, 30, 40, 300.0, 400.0, 600.0, 800.0, 100.0, 100.0, 50.0, 60.0), (1, 1, 2, 2, 0.0, 1.0, 1.0, 1.0, None, None, None, None)], more)
    assert corners(geometry.ocr_coordinates(r)) == [(20, 40, 60, 80), (53.3333, 65, 60, 70)]
    assert corners(geometry.box_union(boxes(spark, [(5, 5, 9, 9), (1, 7, 3, 12), (0, 0, 0, 50)]), ["doc_id"])) == [(1, 5, 9, 12)]


def test_sections(spark):
    want = {
        "已获批准的 PMA 产品": "pma_item", "PMA持证人": "pma_holder", "补充型号认可证 VSTC": "vstc", "型号认可证": "vtc", "list of VTC": "vtc", "VDA": "vda", "补充型号合格证": "stc", "MDA list": "mda", "tda": "tda",
        "PC": "pc", "型号合格证": "tc", "TC-1": "tc", "获得国外认可的民用航空产品": "foreign_product_recognition", "获得国外当局认可的技术标准规定项目": "foreign_tso_recognition", "CTSOA": "ctsoa", "列TC": None, "else": None,
    }
    d = spark.createDataFrame([(h, f" \n\u3000\n {h}\nTC") for h in want], "h string, page string")
    got = {r.h: r.s for r in d.select("h", catalog.section_of(catalog.first_line(F.col("page"))).alias("s")).collect()}
    assert got == want
    w = spark.createDataFrame([("截至2024", 1.0, 800.0), ("TC-1", 730.0, 800.0), ("B-1", 730.0, 800.0), ("TC-1", 700.0, 800.0), ("TC-1", 700.0, None)], "t string, top double, h double")
    assert [r.f for r in w.select(catalog.furniture_word(F.col("t"), F.col("top"), F.col("h")).alias("f")).collect()] == [True, True, False, False, False]


def test_search_all_is_the_search_of_each(spark, monkeypatch):
    import random

    rng = random.Random(5)
    vectors = [None if k % 11 == 3 else [1.0] if k % 13 == 5 else [0.0] * 3 if k % 17 == 4 else [float(rng.randrange(-2, 3)) for _ in range(3)] for k in range(120)]
    texts = [rng.choice(["pump valve", "the valve", "other"]) for _ in vectors]
    chunks = spark.createDataFrame([(f"c{k}", t, "paragraph", v) for k, (t, v) in enumerate(zip(texts, vectors, strict=True))], "chunk_id string, text string, semantic_role string, embedding array<float>").repartition(3)
    asked = {k: v for k, v in enumerate(vectors) if k % 10 == 0 and v}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, embedding array<float>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rows = chunks.select(F.col("chunk_id").alias("id"), "embedding", search.keyword_score(F.col("text"), "pump valve").alias("keyword"), roles.role_weight(F.lit("paragraph")).alias("weight"))
    got = search.search_all(rows, queries, 20, 4, search.VECTOR_WEIGHT, search.KEYWORD_WEIGHT).where("score > 0").collect()
    for k, v in asked.items():
        want = [(r.chunk_id, r.score) for r in search.search(chunks, "pump valve", v, 20).collect()]
        assert sorted((r.id, r.score) for r in got if r.query_id == k) == sorted(want), k
    assert {r.query_id for r in got} == set(asked)


def test_cells_and_bands(spark):
    words = spark.createDataFrame([(1, 30.0, 10.0, "b"), (1, 5.0, 12.4, "a"), (1, 9.0, 12.6, "c"), (1, 1.0, 15.2, "d"), (2, 1.0, 1.0, "e"), (2, None, 1.0, "f")], "cell int, x0 double, top double, text string")
    assert {r.cell: r.text for r in catalog.cell_text(words, ["cell"]).collect()} == {1: "a b c d", 2: "e"}
    page = "doc_id long, page_number int, "
    anchors = spark.createDataFrame([(1, 1, 1, 100.0), (1, 1, 2, 140.0), (1, 1, 3, 180.0), (1, 1, 4, 300.0), (1, 2, 5, 50.0), (1, 2, 6, 90.0)], page + "row_number int, top double")
    rules = spark.createDataFrame([(1, 1, t, t + 1, w) for t, w in ((90.0, 520.0), (130.0, 520.0), (190.0, 520.0), (160.0, 40.0), (450.0, 520.0))], page + "top double, bottom double, width double")
    pages = spark.createDataFrame([(1, 1, 80.0, 800.0), (1, 2, 30.0, 700.0)], page + "header_bottom double, page_bottom double")
    got = {r.row_number: (r.start, r.end) for r in catalog.row_bands(anchors, rules, pages).collect()}
    assert got == {1: (90.5, 129.5), 2: (120.0, 160.0), 3: (160.0, 240.0), 4: (240.0, 449.5), 5: (31.5, 70.0), 6: (70.0, 700.0)}
