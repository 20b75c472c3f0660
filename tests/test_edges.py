"""Operators on nothing, on nulls, on ties and on rows that repeat."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexmill.functions import extract
from lexmill.operators import anatomy, catalog, geometry, metrics, reader, runs, structure
from lexmill.sources import sinks

T = datetime.datetime(2024, 1, 1)
ITEMS = "doc_id long, position int, kind string, semantic_role string, text string, page_number int"
UNITS = (
    "doc_id long, position int, unit_id string, stable_unit_id string, semantic_role string, heading boolean, section_id string, parent_section_id string, section_level int, section_no string, title_path array<string>, "
    "list_level int, list_parent string, text string, page_start int, page_end int, continuity_kind string, continues_from string, continuity_required boolean"
)
RUNS = "run_id long, tenant_id string, doc_id long, created_at timestamp, sealed_at timestamp, publication string, validation string, execution string"
JOBS = "tenant_id string, job_id long, parent_doc_id long, state string, failure_reason string, next_attempt_at timestamp, created_at timestamp, lease_expires_at timestamp, attempt_count int, duration double, quota_units long"
BLOCKS = "doc_id long, position int, block_id string, type string, page_number int, content string"
NOTHING = {
    "manual": (lambda f: anatomy.structure_quality(anatomy.manual_role(f)), ITEMS), "anatomy": (lambda f: anatomy.anatomy(anatomy.manual_role(f)), ITEMS), "unit signals": (structure.unit_signals, UNITS), "list parents": (structure.list_parents, UNITS),
    "notes": (structure.table_notes, BLOCKS), "staged": (lambda f: runs.staged_counts(f, {"blocks": f}), RUNS), "claim": (lambda f: runs.claim_next(f, "2024-01-01"), JOBS), "part jobs": (runs.part_jobs, JOBS), "retries": (lambda f: runs.after_failure(f, "2024-01-01"), JOBS),
    "dashboard": (runs.dashboard, JOBS), "sheet": (structure.trimmed_sheet, "sheet long, row_index int, col_index int, text string"), "boxes": (lambda f: geometry.box_union(f, ["k"]), "k int, x0 double, top double, x1 double, bottom double"),
    "page signals": (reader.page_signals, "doc_id long, page_number int, text string, tables int, ocr_attempted boolean, ocr_errors array<string>, reading_order_confidence double"), "joined": (lambda f: runs.joined_reports(f, f.select("doc_id", F.lit(1).alias("total_pages"))), "doc_id long, part_index int, page_start int, page_end int"),
}


@pytest.mark.parametrize("name", NOTHING)
def test_nothing(spark, name):
    operator, schema = NOTHING[name]
    assert operator(spark.createDataFrame([], schema)).count() == 0


def test_gates_of_nothing(spark):
    empty = spark.createDataFrame([], "status string, requested_pages int, parsed_pages int, reasons_complete boolean, traceability double")
    assert all(r.passed for r in runs.sample_gate(empty).collect())
    none = spark.createDataFrame([(None,) * 5], empty.schema)
    assert {r.metric for r in runs.sample_gate(none).collect() if r.passed} == {"requested_pages_have_audit_record"}


def test_null_items(spark):
    rows = [(1, 1, None, None, None, None), (1, 1, None, None, None, None), (1, 2, "table", "TABLE", None, 3), (2, 0, "paragraph", " Body_Section ", "CHAPTER ONE IN CAPS", 0)]
    roles = anatomy.manual_role(spark.createDataFrame(rows, ITEMS))
    assert [r.manual_role for r in roles.where("doc_id = 1").collect()] == [None, None, None]
    q = {r.doc_id: r for r in anatomy.structure_quality(roles).collect()}
    assert (q[1]["items"], q[1].heading_items, q[1].score) == (3, 0, 0.2) and (q[2].body_like_headings, q[2].heading_body_binding_rate, q[2].evidence_binding_strength) == (1, 0.0, 0.0)


def test_headings_with_bodies(spark):
    rows = [(1, 1, "paragraph", "paragraph", "1. Scope:\nAll of the parts are covered", 1), (1, 2, "paragraph", "paragraph", "2. Tools", 1), (1, 3, "paragraph", "header_footer", "page", 1), (1, 4, "table", "table", "", None), (1, 5, "paragraph", "paragraph", "3. End", None), (1, 6, "paragraph", "toc_entry", "x", 1)]
    r = anatomy.structure_quality(anatomy.manual_role(spark.createDataFrame(rows, ITEMS))).first()
    # Bound: the first by its own text, the second by the table; evident: two headings, not the table, not the last.
    assert (r.body_like_headings, r.heading_body_binding_rate, r.evidence_binding_strength, r.noise_ratio) == (3, 0.6667, 0.5, 0.1667)


def test_unit_signal_nulls(spark):
    blank = (None,) * 12
    units = spark.createDataFrame([(1, 1, "a", None, None, None, None, *blank), (1, 2, "b", "s", "Clause", True, "x", None, 2, "1.1", ["t"], None, None, " ", 1, 2, None, None, None), (1, 3, "c", "s", "title", True, "x", None, 2, "1.3.", None, None, None, "t", 2, 2, None, None, True)], UNITS)
    got = sorted((r.unit_id, r.code) for r in structure.unit_signals(units).collect())
    assert got == [
        ("a", "structure_unit_identity_invalid"), ("b", "structure_cross_page_continuity_missing"), ("b", "structure_section_parent_missing"), ("b", "structure_semantic_unit_empty"), ("c", "structure_cross_page_continuity_missing"),
        ("c", "structure_section_number_jump"), ("c", "structure_section_parent_missing"), ("c", "structure_title_path_missing"), ("c", "structure_unit_identity_invalid"),
    ]


def test_notes_stop(spark):
    rows = [(1, 1, "t1", "table", 1, None), (1, 2, "a", "paragraph", 1, " "), (1, 3, "b", "paragraph", None, "(a) x"), (1, 4, "c", "paragraph", 1, "* y"), (1, 5, "d", "paragraph", 1, "注 1"), (1, 6, "e", "paragraph", 1, "Note: z"), (1, 7, "t2", "table", 1, None), (1, 8, "f", "paragraph", 2, "(a) other page"), (1, 9, "t3", "table", 2, None), (1, 10, "g", "paragraph", 2, "Text"), (1, 11, "h", "paragraph", 2, "(b) late")]
    assert [(r.table_block, r.n, r.note_block) for r in structure.table_notes(spark.createDataFrame(rows, BLOCKS)).orderBy("n").collect()] == [("t1", 1, "b"), ("t1", 2, "c"), ("t1", 3, "d")]


def test_claims_and_retries(spark):
    job = lambda i, state, **k: ("t", i, 1, state, k.get("why"), k.get("next"), T, k.get("lease"), k.get("n"), k.get("d"), None)
    jobs = spark.createDataFrame([job(2, "pending"), job(1, "pending"), job(3, "pending", next=T + datetime.timedelta(days=9)), job(4, "failed", n=3), job(5, "failed", n=2, why="Cancelled "), job(6, "running", lease=T - datetime.timedelta(1)), job(7, "running", lease=T + datetime.timedelta(1)), job(8, "done", d=2.0), job(8, "done", d=None), job(9, None)], JOBS)
    assert runs.claim_next(jobs, "2024-01-02").first().job_id == 1
    got = {r.job_id: (r.state, r.next_attempt_at) for r in runs.after_failure(jobs, "2024-01-01").collect()}
    assert got == {4: ("dead_letter", None), 5: ("pending", T + datetime.timedelta(seconds=2)), 6: ("pending", T + datetime.timedelta(seconds=1))}
    r = runs.part_jobs(jobs).first()
    assert (r.parts_total, r.parts_done, r.parts_failed, r.parts_cancelled, r.parts_queued, r.parts_retry_pending, r.durations, r["mean"], r.p50) == (10, 2, 1, 1, 3, 1, 1, 2.0, 2.0)
    assert runs.dashboard(jobs, 2).first().recent == [9, 8]


def test_previews_and_collisions(spark):
    run = lambda i, **k: (i, "t", 1, T, k.get("sealed", T), k.get("pub", "unpublished"), k.get("val", "passed"), k.get("ex", "succeeded"))
    all_runs = spark.createDataFrame([run(1), run(2, sealed=None), run(3, pub="published"), run(4, val="rejected"), run(5, ex="failed"), run(6, val=None), run(7)], RUNS)
    pointers = spark.createDataFrame([("t", 1, 7)], "tenant_id string, doc_id long, active_run_id long")
    wanted = spark.createDataFrame([("t", 1, i) for i in range(1, 9)] + [("u", 1, 1)], "tenant_id string, doc_id long, run_id long")
    got = [r.preview for r in runs.previews(wanted, all_runs, pointers).orderBy("tenant_id", "run_id").collect()]
    assert got == ["available", *["not_available"] * 6, "not_found", "not_found"]
    ids = "kind string, id string, tenant_id string, doc_id long"
    live = spark.createDataFrame([("block", "a", "t", 1), ("block", "a", "t", 2), ("chunk", "b", "u", 1)], ids)
    staged = spark.createDataFrame([("block", "a", "t", 1), ("block", "a", "t", 1), ("chunk", "a", "t", 1), ("chunk", "b", "t", 1), (None, None, "t", 1)], ids)
    assert sorted(r.collision for r in runs.id_collisions(staged, live).collect()) == ["block:a", "chunk:b"]


def test_reader_edges(spark):
    blocks = spark.createDataFrame([(1, "b1", None, None, None, None, "x-\ny"), (1, "b2", 1, 0, "hidden", None, "h"), (1, "b0", 2, 1, "table", "figure", None)], "doc_id long, block_id string, page_number int, reading_order int, reader_policy string, display_kind string, text string")
    tables = spark.createDataFrame([(1, "t1", "b2", 5), (1, "", "b1", 1), (1, "t2", None, None)], "doc_id long, table_id string, block_id string, page_number int")
    figures = spark.createDataFrame([], "doc_id long, figure_id string, block_id string, page_number int")
    units = spark.createDataFrame([(1, "u1", ["b1", "b1"], None), (1, "u2", None, ["t1"])], "doc_id long, unit_id string, block_ids array<string>, table_ids array<string>")
    rows = reader.projection(blocks, tables, figures, units)
    assert [(r.n, r.page_number, r.type, r.table_id, r.block_ids, r.text, r.unit_ids) for r in rows.orderBy("n").collect()] == [
        (1, 1, "table", "", ["b1"], None, ["u1"]), (2, 2, "table", None, ["b0"], None, []), (3, 5, "table", "t1", ["b2"], None, ["u2"]), (4, 1, "table", "t2", [], None, []),
    ]
    signals = spark.createDataFrame([(1, " c ", 2, None, None, None, None, None, None), (1, "", 2, None, None, None, None, None, None), (1, "d", 2, "t1", None, None, None, None, ["b0"]), (1, "e", None, None, None, None, None, None, None)], "doc_id long, code string, page_number int, table_id string, figure_id string, block_id string, table_ids array<string>, figure_ids array<string>, block_ids array<string>")
    got = {r.n: r.codes for r in reader.with_signals(rows, reader.signal_targets(signals)).collect()}
    assert got == {1: [], 2: ["c", "d"], 3: ["d"], 4: []}


def test_catalogue_edges(spark):
    rows = spark.createDataFrame([("tc", 1, 1, {"approval.numberOriginal": "TC1", "holder.nameOriginal": "A"}), ("tc", 2, 9, {"holder.nameOriginal": "A", "approval.numberOriginal": "TC1"}), ("tc", 2, 2, {"approval.numberOriginal": " ", "holder.nameOriginal": None}), ("tc", 3, 3, None)], "section string, page_number int, row_number int, fields map<string,string>")
    got = sorted((r.page_number, r.row_number, r.rejected, r.missing) for r in catalog.build_records(rows, "a" * 64).collect())
    both = list(catalog.REQUIRED)
    assert got == [(1, 1, False, []), (2, 2, True, both), (3, 3, True, both)]
    parts = spark.createDataFrame([("p", 1, 1), ("q", 2, 3)], "part_id string, first int, last int")
    assert sorted(r.part_id for r in catalog.owned_records(catalog.build_records(rows, "a" * 64), parts).collect()) == ["p", "q", "q"]
    states = spark.createDataFrame([(1, "a", None, "running"), (1, "b", 2, "failed"), (1, "c", 1, "done"), (1, "d", 1, None)], "run_id int, part_id string, part_index int, state string")
    assert [r.part_id for r in runs.selected_parts(runs.recovered_parts(states), 5).collect()] == ["a", "b"] and [r.part_id for r in runs.selected_parts(states, 5, failed_only=True).collect()] == ["b"]
    with pytest.raises(ValueError):
        runs.selected_parts(states, 0)


def test_part_ids(spark):
    import hashlib

    cases = ["ok-1", "a b", "ü" * 3, "x" * 81, None, "..", "d/" + "y" * 90]
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", extract.part_doc_id(F.col("c"), F.lit(7)).alias("p")).collect()
    digest = lambda c: hashlib.sha1((c or "").encode()).hexdigest()[:12]
    assert [r.p for r in rows] == ["ok-1-part-7", f"a-b-{digest('a b')}-part-7", f"doc-{digest('üüü')}-part-7", f"{'x' * 67}-{digest('x' * 81)}-part-7", f"doc-{digest('')}-part-7", f"doc-{digest('..')}-part-7", f"d-{'y' * 65}-{digest('d/' + 'y' * 90)}-part-7"]


def test_saved_documents_share_folders(spark, tmp_path):
    rows = [("t", i, i) for i in range(50)]
    path = f"{tmp_path}/d"
    sinks.save_by_document(spark.createDataFrame(rows, "tenant_id string, doc_id long, v int"), path, 4)
    sinks.save_by_document(spark.createDataFrame([("t", 7, 100), ("t", 99, 99), (None, None, 1)], "tenant_id string, doc_id long, v int"), path, 4)
    assert len(list((tmp_path / "d").glob("bucket=*"))) == 4
    got = {r.doc_id: r.v for r in spark.read.parquet(path).collect()}
    assert got == {**{i: i for i in range(50)}, 7: 100, 99: 99, None: 1}


def test_retry_of_every_attempt(spark):
    r = spark.range(0, 8).select(metrics.retry_delay(F.col("id"), 0.1, 1.0).alias("d")).collect()
    assert [x.d for x in r] == [0.1, 0.1, 0.2, 0.4, 0.8, 1.0, 1.0, 1.0]
