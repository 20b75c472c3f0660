"""Rules with cases that state what they ask for: states, failures, profiles, tables, gates, parts, and their edge cases."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import blocks, catalog, control, coverage, diagnostics, metrics, rag, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("axis", "old", "new", "legal"), [
    ("execution", "pending", "running", True), ("execution", "succeeded", "running", False), ("execution", "failed", "pending", False), ("execution", "running", "running", False),
    ("validation", "not_run", "passed", True), ("validation", "rejected", "passed", False), ("validation", "error", "not_run", True), ("validation", "passed", "info", False),
    ("publication", "unpublished", "published", True), ("publication", "superseded", "published", False), ("publication", "superseded", "withdrawn", True), ("publication", "withdrawn", "published", False),
    ("publication", None, "published", False), ("other", "pending", "running", False),
])
def test_transitions(spark, axis, old, new, legal):
    changes = spark.createDataFrame([(axis, old, new)] * 2, "axis string, old string, new string")
    assert [r.legal for r in control.check_transitions(changes).collect()] == [legal] * 2


def test_transitions_of_no_change(spark):
    assert control.check_transitions(spark.createDataFrame([], "axis string, old string, new string")).count() == 0


@pytest.mark.parametrize(("message", "kind", "status", "name"), [
    ("HTTP Error 429: slow down", None, None, "rate_limited"), ("boom", "TimeoutError", None, "timeout"), ("boom", "PermissionError", None, "permission_denied"), ("boom", "FileNotFoundError", None, "invalid_input"),
    ("boom", "JSONDecodeError", None, "invalid_response"), ("boom", "ConnectionError", None, "provider_unavailable"), ("boom", "HTTPError", 502, "provider_unavailable"), ("boom", "HTTPError", 429, "rate_limited"),
    ("401 pages were read", None, None, "provider_failed"), ("Access is denied", None, None, "permission_denied"), ("file extension .xyz", None, None, "unsupported"), (None, None, None, "provider_failed"),
])
def test_failures(spark, message, kind, status, name):
    assert one(spark, metrics.failure_class(F.lit(message).cast("string"), F.lit(kind).cast("string"), F.lit(status).cast("int"))) == name


def test_retry_delays(spark):
    d = lambda n, **k: one(spark, metrics.retry_delay(F.lit(n).cast("int"), **k))
    assert [d(1), d(3), d(9), d(None), d(0), d(2, base=0.0), d(4, base=5.0, most=2.0), d(2, base=0.0333)] == [1.0, 4.0, 60.0, 1.0, 1.0, 0.0, 5.0, 0.067]


def resolve(spark, media=None, name=None, size=None, pages=None, tables_=None, wish=None):
    c = lambda v, t: F.lit(v).cast(t)
    return one(spark, control.profile(c(media, "string"), c(name, "string"), c(size, "long"), c(pages, "int"), c(tables_, "int"), c(wish, "string")))


def test_profiles(spark):
    p = resolve(spark, name="Big.PDF", pages=500)
    assert (p.profile, p.reasons, p.recommended_async, p.source) == ("large-pdf", ["page_count>=500"], True, "auto")
    assert resolve(spark, "application/pdf", "年度目录.pdf", 52428800).profile == "large-pdf-catalog"
    assert resolve(spark, "application/pdf", "x.pdf", None, 600, 300).reasons == ["page_count>=500", "table_density>=0.5"]
    assert resolve(spark, name="a.b/c.xlsx").profile == "excel-ledger" and resolve(spark, name=".pdf", pages=900).profile == "default"
    assert resolve(spark, name="scan.png").profile == "ocr-heavy" and resolve(spark, name="MyScan.pdf").profile == "scan-pdf"
    assert resolve(spark).profile == "default" and resolve(spark, pages=0, tables_=5).profile == "default"
    p = resolve(spark, wish=" Odd ")
    assert (p.profile, p.source, p.known, p.reasons) == ("odd", "requested", False, ["requested_profile=odd"])
    assert resolve(spark, wish="AUTO").source == "auto"


CELLS = "doc_id long, table_id string, row_index int, text string"


def grid(*tables_):
    return [(1, name, r, text) for name, rows in tables_ for r, row in enumerate(rows) for text in row]


def test_table_warnings(spark):
    rows = grid(("whole", [["a", "b"], ["1", "2"]]), ("blank", [["", None], ["1", "2"]]), ("ragged", [["a", "b"], ["1"]]), ("sparse", [["a", ""], ["", ""], ["", " "]]), ("wide", [["a", "b", "c"]]))
    shapes = tables.shapes(spark.createDataFrame(rows, CELLS))
    got = {r.table_id: r.warnings for r in tables.warnings(shapes).collect()}
    assert got == {"whole": [], "blank": ["table_header_missing"], "ragged": ["table_ragged_rows"], "sparse": ["table_empty_ratio_high"], "wide": []}
    declared = shapes.withColumn("declared", F.when(F.col("table_id") == "whole", F.array(F.lit(2), F.lit(3), F.lit(0))))
    assert {r.table_id: r.warnings for r in tables.warnings(declared).collect()}["whole"] == ["table_ragged_rows"]
    assert tables.common_columns(shapes).collect() == [(1, 2)]
    extra = tables.warnings(shapes).withColumns({"header": F.array(F.lit("A"), F.lit("a "), F.lit("")), "has_formula": F.lit(None).cast("boolean"), "hidden_sheet": F.lit(True)})
    codes = {r.code for r in tables.signals(extra).where("table_id = 'wide'").collect()}
    assert codes == {"table_col_count_changed", "table_hidden_sheet", "table_header_blank_cells", "table_header_duplicate_values"}
    none = tables.shapes(spark.createDataFrame([], CELLS))
    assert tables.signals(tables.warnings(none)).count() == 0 and tables.common_columns(none).count() == 0


def test_provider_comparison(spark):
    schema = "provider string, coverage_pages int, coverage_gaps int, blocks int, tables int, confidence double, codes array<string>"
    rows = [("a", 10, 0, 5, 1, 0.5, []), ("b", 10, 0, 5, 1, None, None), ("c", 0, None, 9, 1, 0.9, ["rag_table_without_unit"]), ("d", 4, 8, 1, 1, None, ["rag_empty_text_page"])]
    ranked = control.compare_providers(spark.createDataFrame(rows, schema))
    got = {r.provider: (r["rank"], r.score, r.recommendation, r.order_axis) for r in ranked.collect()}
    assert got == {"b": (1, 1.0, "keep_candidate", "not_observed"), "a": (2, 0.9, "keep_candidate", "warning"), "c": (3, 0.85, "compare_table_provider_or_local_rerun", "ok"), "d": (4, 0.3, "review_parse_ir_or_local_rerun", "not_observed")}
    s = control.comparison_summary(ranked, "a").first()
    assert (s.best, s.best_differs, s.action, s.primary_rank, s.with_warnings) == ("b", True, "inspect_provider_route_plan", 2, 3)
    s = control.comparison_summary(ranked.where("provider = 'b'"), "b").first()
    assert (s.needs_attention, s.action) == (False, "keep_current_primary")


def test_provider_usage(spark):
    schema = "provider string, doc_id long, page_number int, kind string, elapsed double, memory double, confidence double, codes array<string>"
    rows = [("p", 1, 1, "block", 2.0, 5.0, 1.5, ["x"]), ("p", 1, 1, "table", 3.0, None, 0.2, None), ("p", 1, 2, "figure", None, 7.0, None, ["y", "x"]), (" ", 1, 1, "block", 9.0, 9.0, 0.1, None), (None, 1, 1, "block", 9.0, 9.0, 0.1, None)]
    r = control.provider_usage(spark.createDataFrame(rows, schema)).collect()
    assert len(r) == 1 and (r[0].pages, r[0].blocks, r[0].tables, r[0].figures, r[0].elapsed, r[0].elapsed_pages, r[0].memory, r[0].confidence, r[0].confidence_pages, r[0].codes) == (2, 1, 1, 1, 3.0, 1, 7.0, 1.0, 1, ["x", "y"])


def test_attention(spark):
    schema = "doc_id string, gate string, action string, gate_actions array<string>, part_focuses array<string>, provider_attention boolean, provider_mismatch boolean"
    rows = [
        ("a", "accept_with_warning", "rechunk_document", None, ["parse_ir"], True, True), ("b", "local_rerun", "local_provider_rerun", ["rerun_warning_parts"], [], True, True), ("c", "accept", None, None, [""], True, False),
        ("d", "accept", None, None, [""], None, None), ("e", "Manual_Review ", None, None, None, None, None), ("f", None, None, None, None, None, None), ("g", "disabled", None, None, ["coverage_gaps"], True, False),
    ]
    got = {r.doc_id: (r.focus, r.needs_attention) for r in diagnostics.attention(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("quality_gate", True), "b": ("parts", True), "c": ("providers", True), "d": ("parts", True), "e": ("quality_gate", True), "f": (None, False), "g": ("parts", True)}


def test_ocr_trace(spark):
    schema = "doc_id long, page_number int, position int, attempted boolean, fallback boolean, attempt_reason string, acceptance_reason string, rejection_reason string, error_reason string, native_tokens int, final_tokens int"
    rows = [(1, 1, 2, True, None, "late", None, None, "", 5, None), (1, 1, 1, None, None, "early", "", None, None, 3, 8), (1, 2, 1, True, True, None, None, None, "broke", None, 4)]
    r = diagnostics.ocr_trace(spark.createDataFrame(rows, schema)).first()
    assert (r.attempted_pages, r.fallback_pages, r.rejected_pages, r.failed_pages, r.attempt_reasons, r.acceptance_reasons, r.error_reasons, r.native_tokens, r.final_tokens) == (2, 1, 1, 1, ["early"], [], ["broke"], 5, 12)


def test_continuity(spark):
    schema = "doc_id long, unit_id string, position int, unit_type string, page_start int, page_end int, continues_from string, group_id string, is_continuation boolean, table_ids array<string>"
    rows = [
        (1, "a", 1, "p", 1, 1, None, "g", None, None), (1, "b", 2, "p", 1, 2, "a", None, None, ["t"]), (1, "c", 3, "t", 3, 3, "nowhere", "", None, ["t"]), (1, "d", 4, "t", 4, 4, None, None, True, None),
        (1, "e", 5, "p", 4, 4, None, "g", True, None), (1, "f", 6, "p", 9, 9, None, None, True, None), (2, "a", 1, "p", 1, 1, None, "g", True, ["t"]),
    ]
    got = {(r.doc_id, r.unit_id): (r.previous, r.reason, r.confidence) for r in diagnostics.continuity(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, "b"): ("a", "explicit_source_relation", 1.0), (1, "c"): ("b", "same_table_across_adjacent_pages", 0.95), (1, "d"): ("c", "adjacent_explicit_continuation", 0.9), (1, "e"): ("a", "continuation_group", 1.0),
    }


def test_gate(spark):
    schema = "doc_id string, text_ratio double, table_ratio double, chunk_ratio double, order_confidence double, rag_flags array<string>, rag_gate string, rag_action string"
    rows = [
        ("ok", 1.0, 1.0, 1.0, None, [], "accept", None), ("order", 1.0, 1.0, 1.0, 0.7, None, None, None), ("edge", 0.98, 0.95, 0.98, 0.75, [], "accept", None), ("chunks", 1.0, 1.0, 0.9, None, [], "accept", None),
        ("empty", 0.1, 1.0, 1.0, None, ["rag_empty_text_page"], "manual_review", "review_parse_ir"), ("figure", 1.0, 1.0, 1.0, 0.9, ["rag_figure_caption_missing"], "accept_with_warning", "review_parse_ir"), ("null", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: (r.gate, r.action, r.passed) for r in coverage.quality_gate(df).collect()}
    assert got == {
        "ok": ("accept", None, True), "order": ("local_rerun", "local_provider_rerun", False), "edge": ("accept", None, True), "chunks": ("accept_with_warning", "rechunk_document", True),
        "empty": ("manual_review", "review_parse_ir", False), "figure": ("accept_with_warning", "review_parse_ir", True), "null": ("accept", None, True),
    }
    strict = {r.doc_id: r.gate for r in coverage.quality_gate(df, allow_review=False, allow_rerun=False).collect()}
    assert strict["empty"] == strict["order"] == "accept_with_warning"


def test_ledger(spark):
    rows = [(1, "done", {"records": 3}), (1, "done", {"records": 4, "pages": 1}), (2, "done", {"records": 1}), (2, "failed", {"records": 9}), (3, None, None), (3, "", None), (4, "running", None), (4, "failed", None)]
    got = {r.run_id: (r.state, r.part_states, r.completed_counts) for r in catalog.ledger(spark.createDataFrame(rows, "run_id int, state string, counts map<string,int>")).collect()}
    assert got == {1: ("completed", {"done": 2}, {"records": 7, "pages": 1}), 2: ("partial", {"done": 1, "failed": 1}, {"records": 1}), 3: ("planned", {"pending": 2}, None), 4: ("running", {"running": 1, "failed": 1}, None)}


def test_fingerprints(spark):
    import hashlib
    import json

    schema = "doc_id long, position int, type string, semantic_role string, page_number int, content string"
    rows = [(1, 0, "paragraph", "paragraph", 1, "ﬁne  Ａ\t\"x\" \u2003é\n"), (1, 1, "paragraph", None, 1, None), (2, 0, "paragraph", "paragraph", 1, 'fine A "x" é')]
    got = {(r.doc_id, r.position): r for r in blocks.fingerprints(spark.createDataFrame(rows, schema)).collect()}
    sha = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    a, b, c = got[1, 0], got[1, 1], got[2, 0]
    assert a.content_fingerprint == c.content_fingerprint == sha({"text": 'fine A "x" é'}) and a.unit_fingerprint != c.unit_fingerprint
    assert a.structure_fingerprint == sha({"page": 1, "role": "paragraph", "type": "paragraph"}) and b.structure_fingerprint == sha({"page": 1, "role": None, "type": "paragraph"})
    assert a.unit_fingerprint == sha({"content": a.content_fingerprint, "doc_id": "1", "structure": a.structure_fingerprint}) and a.stable_id == f"1:kuf:{a.unit_fingerprint[:20]}"


def test_noisy_pages(spark):
    rows = [(1, 1, 10, 5, 0, 0), (1, 2, 2, 2, 0, 0), (1, 3, 4, 2, 1, 1), (1, 4, 4, 2, 2, 0), (1, 5, 0, 0, 9, 9)]
    pages = spark.createDataFrame(rows, "doc_id int, page_number int, blocks int, very_short int, furniture int, numeric_heavy int")
    assert [r.page_number for r in blocks.noisy_pages(pages, 4).collect()] == [2, 3, 4, 1]


def test_rag_edges(spark):
    blocks_ = spark.createDataFrame([(1, "b1", 1, 2, 10, None, "x"), (1, "b2", 3, 3, None, None, None), (1, "b3", 4, 4, 5, "skip", ""), (2, "b1", 1, 1, 5, None, "y")], "doc_id int, block_id string, page_start int, page_end int, chars int, index_policy string, provider string")
    raw = spark.createDataFrame([(1, "u1", 1, 2, True, None, ["b1"], None), (2, "u1", 1, 1, None, "", ["b1"], ["t1"])], "doc_id int, unit_id string, page_start int, page_end int, should_index boolean, skip_reason string, block_ids array<string>, table_ids array<string>")
    chunks = spark.createDataFrame([(1, "c1", ["b1", "b1"], True), (1, "c2", ["b1"], None), (2, "c1", None, True)], "doc_id int, chunk_id string, block_ids array<string>, embedded boolean")
    tables_ = spark.createDataFrame([(2, "t1", 1), (2, "t1", 1), (2, "", 1)], "doc_id int, table_id string, page_number int")
    figures = spark.createDataFrame([(1, "f1", 3, None, " "), (1, "f2", 3, "", "alt")], "doc_id int, figure_id string, page_number int, caption string, alt_text string")
    units = rag.units(raw, chunks)
    u = {(r.doc_id, r.unit_id): (r.chunks, r.state, r.reason) for r in units.collect()}
    assert u == {(1, "u1"): (2, "chunks_not_embedded", "chunks_not_embedded"), (2, "u1"): (0, "skipped", "not_indexable")}
    pages = rag.pages(blocks_, units, chunks, tables_, figures)
    p = {(r.doc_id, r.page_number): (r.missing_reason, r.parsed_text_chars, r.codes) for r in pages.collect()}
    assert p == {
        (1, 1): ("chunks_not_embedded", 10, ["rag_chunks_not_embedded"]), (1, 2): ("chunks_not_embedded", 10, ["rag_chunks_not_embedded"]), (1, 3): (None, 0, ["rag_figure_caption_missing"]), (1, 4): (None, 0, []),
        (2, 1): ("no_indexable_units", 5, ["rag_empty_text_page", "rag_table_without_unit"]),
    }
    s = {r.doc_id: r for r in rag.quality(rag.summary(pages, units)).collect()}
    assert (s[1].total_unit_count, s[1].pages_with_coverage_gaps, s[1].rag_gate, s[1].rag_action, s[1].rag_score) == (1, 3, "accept_with_warning", "review_parse_ir", 0.25)
    assert (s[2].rag_gate, s[2].unit_chunk_coverage_ratio, s[2].rag_score) == ("manual_review", 1.0, 0.0)
    empty = [x.limit(0) for x in (blocks_, chunks, tables_, figures)]
    assert rag.summary(rag.pages(empty[0], rag.units(raw.limit(0), empty[1]), *empty[1:]), rag.units(raw.limit(0), empty[1])).count() == 0


def test_part_states_and_focus(spark):
    parts = spark.createDataFrame([(1, "a", 1, 2, " DONE", 0), (1, "b", 3, 3, "failed", 0), (1, "c", 4, 4, None, 2), (1, "d", 5, 5, "strange", None), (1, "e", 6, 6, "parsing", 1)], "doc_id int, part_id string, page_start int, page_end int, raw_state string, reported_signals int")
    signals = spark.createDataFrame([(1, 1, "x", "warning"), (1, 2, None, None), (1, 3, "y", "error"), (2, 1, "z", "info"), (1, None, "x", "info")], "doc_id int, page_number int, code string, severity string")
    got = {r.part_id: (r.state, r.signals, r.codes, r.severity_counts) for r in rag.part_states(parts, signals).collect()}
    assert got == {"a": ("warning", 2, ["x"], {"unknown": 1, "warning": 1}), "b": ("failed", 1, ["y"], {"error": 1}), "c": ("warning", 2, [], None), "d": ("unknown", 0, [], None), "e": ("parsing", 1, [], None)}

    def focus(status, changed, gaps, signals_, gate, supported):
        return one(spark, rag.part_focus(F.lit(status).cast("string"), F.lit(changed).cast("boolean"), F.lit(gaps), F.lit(signals_), F.lit(gate).cast("string"), F.lit(supported).cast("boolean")))

    assert focus("Unchanged", None, 0, 0, None, None) == "provider_route_plan" and focus("mixed", None, 0, 0, None, None) == "parse_ir" and focus("improved", True, 0, 0, "accept", True) == "keep_current_provider"
    assert focus("improved", None, 0, 0, "accept_with_warning", None) == "coverage_gaps" and focus(None, None, 1, 0, None, True) == "local_provider_rerun" and focus(None, None, 1, 3, None, None) == "quality_review" and focus(None, None, 0, 0, None, True) is None
