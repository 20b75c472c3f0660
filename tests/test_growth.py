"""What keeps a query's driver, tasks and time in step with its input: exchanges planned, rows a task, work done once."""

import re

from pyspark.sql import functions as F

from lexmill.functions import scratch
from lexmill.operators import rag
from lexmill.plans import load
from lexmill.registry import QUERIES

load()
DATA = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Exchanges between executors that the plan asks for."""
    return len(re.findall(r"Exchange (?:hash|range|RoundRobin)", planned(df)))


def test_more_tasks_for_more_input(spark):
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scratch.parts(li) == own and scratch.parts(li, a_part=1000) > 100
    assert scratch.parts(li.where("l_quantity > 3").select("l_orderkey"), li, a_part=1000) == scratch.parts(li, a_part=1000)
    assert scratch.parts(spark.createDataFrame([(1,)], "a int")) == own  # of an unknown size


def test_coverage_of_parts_is_dealt_once_by_document(spark):
    assert exchanges(QUERIES["part_coverage"](spark, DATA)) <= 16
    assert exchanges(QUERIES["rag_pages"](spark, DATA)) <= 10


def test_units_and_pages_on_nulls_and_repeats(spark):
    raw = spark.createDataFrame(
        [(1, "u", 1, 1, True, None, ["b", "b"], ["t"]), (1, "v", 1, 2, True, None, ["b", None], None), (1, "w", 1, 1, True, None, None, ["x"]), (None, "u", 1, 1, True, None, ["b"], None), (1, "u", 1, 1, True, None, ["b", "b"], ["t"])],
        "doc_id long, unit_id string, page_start int, page_end int, should_index boolean, skip_reason string, block_ids array<string>, table_ids array<string>",
    )
    chunks = spark.createDataFrame([(1, "c", ["b"], True), (1, "c", ["b", "b"], True), (1, "d", ["b"], None), (1, "e", [None], True), (None, "f", ["b"], True)], "doc_id long, chunk_id string, block_ids array<string>, embedded boolean")
    units = rag.units(raw, chunks)
    assert sorted((r.doc_id or 0, r.unit_id, r.chunks, r.embedded) for r in units.collect()) == [(0, "u", 0, False), (1, "u", 2, False), (1, "u", 2, False), (1, "v", 2, False), (1, "w", 0, False)]
    blocks = spark.createDataFrame([(1, "b", 1, 1, 5, None, "p"), (1, "z", 1, 2, 7, "skip", "")], "doc_id long, block_id string, page_start int, page_end int, chars int, index_policy string, provider string")
    tables = spark.createDataFrame([(1, "t", 1), (1, "t", 1), (1, "x", 2), (1, "", 1), (1, "y", None)], "doc_id long, table_id string, page_number int")
    figures = spark.createDataFrame([(1, "f", 2, " ", None), (1, "f", 2, " ", None), (1, "g", 1, "cap", None)], "doc_id long, figure_id string, page_number int, caption string, alt_text string")
    pages = {r.page_number: r for r in rag.pages(blocks, units, chunks, tables, figures).collect()}
    one, two = pages[1], pages[2]
    assert set(pages) == {1, 2} and (one.blocks, one.parsed_text_chars, one.chunks, one.embedded, one.units, one.indexable_units, one.provider_ids) == (2, 5, 2, False, 4, 4, ["p"])
    assert (one.unchunked_unit_ids, one.unembedded_unit_ids, one.tables, one.table_ids_without_units, one.figures) == (["w"], ["u", "v"], 1, [], 1)
    assert (two.blocks, two.chunks, two.embedded, two.units, two.tables, two.table_ids_without_units, two.figures, two.figure_ids_missing_caption) == (1, 0, False, 1, 1, ["x"], 2, ["f"])


def test_merged_rows_are_dealt_to_more_tasks_for_more_input(spark, monkeypatch):
    from lexmill.operators import segment

    monkeypatch.setattr(segment, "A_PART", 1000)
    n = scratch.parts(spark.read.parquet(f"{DATA}/orders.parquet"), a_part=1000)
    for name in ("table_row_merge", "change_merge"):
        p = planned(QUERIES[name](spark, DATA))
        assert re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, (\d+)\)", p) == [str(n)] and exchanges(QUERIES[name](spark, DATA)) == 1
    assert planned(QUERIES["table_row_merge"](spark, DATA)).count(" Sort [") <= 2


def test_a_heading_is_worked_out_once(spark):
    p = QUERIES["docx_headings"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("regexp") < 60


def test_changes_that_meet_are_told_anew(spark):
    from lexmill.operators.segment import merge_changes

    texts = ["HIGHLIGHTS", "CHAPTER/Section/Page Description of Change", "Page 7", "Changed", "Changed this", "Changed page 8", None, "Added x on page 9", "Added y on page 10", "Added z on page 11"]
    b = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id long, page_number int, position long, content string")
    got = [r.content for r in merge_changes(b).orderBy("position").collect()]
    assert got == [*texts[:2], "Page 7\nChanged\nChanged this\nChanged page 8", None, "Added x on page 9\nAdded y on page 10", "Added z on page 11"]


def test_units_and_chunks_meet_in_two_exchanges(spark):
    for name, most in (("unit_coverage", 2), ("page_coverage", 2), ("coverage_summary", 2)):
        assert exchanges(QUERIES[name](spark, DATA)) <= most


def test_unit_coverage_on_nulls_and_repeats(spark):
    from lexmill.operators.coverage import unit_coverage

    units = spark.createDataFrame([(1, "u", 1, 1, True, ["a", "b"]), (1, "v", 1, 2, True, ["b"]), (1, "w", 1, 1, True, None), (2, "u", 1, 1, False, ["z"]), (1, "u", 1, 1, True, ["a", "b"])], "doc_id long, unit_id string, page_start int, page_end int, should_index boolean, block_ids array<string>")
    chunks = spark.createDataFrame([("c", ["a", "b", "b"], True), ("c", ["b"], True), ("d", ["b"], False), ("e", ["z"], None), ("f", [None], True)], "chunk_id string, block_ids array<string>, embedded boolean")
    got = sorted((r.doc_id, r.unit_id, r.chunks, r.embedded, r.all_embedded, r.missing_reason) for r in unit_coverage(units, chunks).collect())
    assert got == [(1, "u", 2, 1, False, "not_embedded")] * 2 + [(1, "v", 2, 1, False, "not_embedded"), (1, "w", 0, 0, False, "no_chunk"), (2, "u", 1, 0, False, None)]


def test_the_corpus_is_searched_once_for_a_reranking(spark):
    assert "documents.parquet" not in planned(QUERIES["reranked"](spark, DATA))
    from lexmill.plans.search_plans import chunks

    p = chunks(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("refers\\s+to") == 1


def test_lines_of_few_pages_are_objects_at_a_time(spark, monkeypatch):
    from lexmill.operators import catalog

    pages = 3 * catalog.PAGES + 1
    lines = spark.range(pages).selectExpr("id as doc_id", "1 as page_number", "explode(array(10D, 22D, 50D)) as centre").withColumn("text", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("centre").cast("int").cast("string")))
    anchors = spark.range(pages).selectExpr("id as doc_id", "1 as page_number", "inline(array(struct(10D as centre, 7 as row_number), struct(if(id = 5, 200D, 50D) as centre, 8 as row_number)))")
    got = catalog.assign_rows(anchors, lines)
    assert "MapInArrow" in planned(got)
    rows = {(r.doc_id, r.line_no): (r.row_number, r.text) for r in got.collect()}
    assert len(rows) == 3 * (pages - 1) and (5, 0) not in rows and [rows[(pages - 1, i)] for i in range(3)] == [(7, f"{pages - 1}-10"), (7, f"{pages - 1}-22"), (8, f"{pages - 1}-50")]


def test_a_reader_view_is_dealt_once_by_document(spark):
    assert exchanges(QUERIES["reader_projection"](spark, DATA)) <= 7  # five are the plan's own grouping of line items
    assert exchanges(QUERIES["reader_signals"](spark, DATA)) <= 10


def test_reader_view_on_nulls_and_hidden_blocks(spark):
    from lexmill.operators.reader import projection, with_signals

    blocks = spark.createDataFrame(
        [(1, "a", 1, 1, None, None, "x"), (1, "b", 1, 2, "hidden", None, "y"), (1, "", 2, None, None, "figure", None), (1, "c", None, 0, "table", None, "z")],
        "doc_id long, block_id string, page_number int, reading_order int, reader_policy string, display_kind string, text string",
    )
    tables = spark.createDataFrame([(1, "t1", "a", 1), (1, "t2", "a", 1), (1, "t3", "b", 4), (1, "t4", "", 5), (1, "", "a", 6)], "doc_id long, table_id string, block_id string, page_number int")
    figures = spark.createDataFrame([(1, "f1", "", None), (1, "f2", "c", 1)], "doc_id long, figure_id string, block_id string, page_number int")
    units = spark.createDataFrame([(1, "u", ["a", "a", None], None), (1, "v", None, ["t2", "t4"]), (1, "w", [""], ["t3", None])], "doc_id long, unit_id string, block_ids array<string>, table_ids array<string>")
    got = projection(blocks, tables, figures, units)
    rows = [(r.type, r.block_ids, r.table_id, r.figure_id, r.unit_ids) for r in got.orderBy("n").collect()]
    assert rows == [
        ("table", ["c"], None, None, []), ("table", ["a"], "t2", None, ["u", "v"]), ("figure", [""], None, None, ["w"]), ("table", ["a"], "t1", None, ["u"]), ("table", ["b"], "t3", None, ["w"]), ("table", [], "t4", None, ["v"]),
        ("figure", [], None, "f1", []), ("figure", ["c"], None, "f2", []),
    ]
    targets = spark.createDataFrame([(1, "block", "a", "p"), (1, "table", "t2", "q"), (1, "page", "2", "r"), (1, "page", None, "s")], "doc_id long, kind string, target string, code string")
    assert [r.codes for r in with_signals(got, targets).orderBy("n").collect()] == [[], ["p", "q"], ["r"], ["p"], [], [], [], []]
