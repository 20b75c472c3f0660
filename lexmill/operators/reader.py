"""The reader's view of a document: visible blocks in order, tables and figures in place, and the signals of each.

Nulls: a null policy is inline, a null reading order 0, a null page 1; repeated ids are not expected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import scratch
from lexmill.functions.extract import reader_text


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def projection(blocks: DataFrame, tables: DataFrame, figures: DataFrame, units: DataFrame) -> DataFrame:
    """One row a reader block, numbered per document: visible blocks by page, reading order and id, a table or figure where a block is its
    place, then tables and figures without a visible block.

    Blocks: doc_id, block_id, page_number, reading_order, reader_policy, display_kind, text.  Tables: doc_id, table_id, block_id, page_number.
    Figures: doc_id, figure_id, block_id, page_number.  Units: doc_id, unit_id, block_ids, table_ids."""
    n = scratch.parts(blocks, tables, figures, units)
    page = F.coalesce("page_number", F.lit(1))
    policy = F.coalesce(F.when(F.col("reader_policy") != "", F.col("reader_policy")), F.lit("inline"))
    # All rows of a document are dealt together once; they meet by block, table and figure in windows there.
    rows = [
        blocks.select("doc_id", "block_id", page.alias("page_number"), F.lit(0).alias("part"), F.coalesce("reading_order", F.lit(0)).alias("reading_order"), policy.alias("policy"), F.coalesce("display_kind", F.lit("")).alias("display_kind"), "text").where("policy <> 'hidden'"),
        tables.select("doc_id", "block_id", page.alias("page_number"), F.lit(1).alias("part"), "table_id"),
        figures.select("doc_id", "block_id", page.alias("page_number"), F.lit(2).alias("part"), "figure_id"),
        units.select("doc_id", F.explode("block_ids").alias("block_id"), F.lit(3).alias("part"), "unit_id"),
        units.select("doc_id", F.explode("table_ids").alias("table_id"), F.lit(3).alias("part"), "unit_id"),
    ]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows).repartition(n, "doc_id")
    known = lambda c: F.col("doc_id").isNotNull() & F.col(c).isNotNull()
    at_block, of = Window.partitionBy("doc_id", "block_id"), lambda part, c: F.when(F.col("part") == part, F.col(c))
    shown, named = F.col("part") == 0, known("block_id") & (F.col("block_id") != "")
    every = every.withColumns({
        "table_here": F.when(shown & named, F.max(of(1, "table_id")).over(at_block)), "figure_here": F.when(shown & named, F.max(of(2, "figure_id")).over(at_block)),
        "by_block": F.when(known("block_id"), F.collect_set(of(3, "unit_id")).over(at_block)),
    }).where("part < 3 or table_id is not null")
    kind = F.when((F.col("policy") == "table") | F.col("table_here").isNotNull(), "table").when((F.col("policy") == "source_snapshot") | F.col("figure_here").isNotNull() | (F.col("display_kind") == "figure"), "figure").otherwise("text")
    every = every.withColumn("type", F.when(shown, kind).when(F.col("part") == 1, "table").when(F.col("part") == 2, "figure"))
    every = every.withColumns({"table_id": F.when(shown, F.when(F.col("type") == "table", F.col("table_here"))).otherwise(F.col("table_id")), "figure_id": F.when(shown, F.when(F.col("type") == "figure", F.col("figure_here"))).otherwise(F.col("figure_id"))}).drop("table_here", "figure_here")
    at_table, at_figure = Window.partitionBy("doc_id", "table_id"), Window.partitionBy("doc_id", "figure_id")
    every = every.withColumns({"by_table": F.when(known("table_id"), F.collect_set(of(3, "unit_id")).over(at_table)), "placed": F.when(known("table_id"), F.max(shown).over(at_table))})
    # What a visible block shows is not shown again after the blocks.
    left = lambda c: (F.coalesce(c, F.lit("")) != "") & ~F.coalesce("placed", F.lit(False))
    every = every.where(shown | ((F.col("part") == 1) & left("table_id")) | (F.col("part") == 2))
    every = every.withColumn("placed", F.when(known("figure_id"), F.max(shown).over(at_figure))).where((F.col("part") < 2) | left("figure_id"))
    key = F.when(shown, F.col("block_id")).when(F.col("part") == 1, F.col("table_id")).otherwise(F.col("figure_id"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", F.when(shown, F.col("page_number")), "reading_order", "id"))
    every = every.withColumns({"id": key, "reading_order": F.coalesce("reading_order", F.lit(0))}).withColumn("n", nth)
    at = F.when(shown | (F.coalesce("block_id", F.lit("")) != ""), F.array("block_id")).otherwise(_none())
    return every.select(
        "doc_id", F.format_string("rb-%06d", "n").alias("reader_block_id"), "n", "page_number", "type", at.alias("block_ids"), "table_id", "figure_id", F.when(F.col("type") == "text", reader_text(F.col("text"))).alias("text"),
        F.sort_array(F.array_union(F.coalesce(F.when(F.size(at) > 0, F.col("by_block")), _none()), F.coalesce("by_table", _none()))).alias("unit_ids"),
    )


def signal_targets(signals: DataFrame) -> DataFrame:
    """Where each signal belongs: (doc_id, kind, target, code): to the tables, figures and blocks that it names, to its page if it names none;
    a page's signal on tables without units or figures without captions belongs to those that its detail lists.

    Signals: doc_id, code, page_number, table_id, figure_id, block_id, table_ids, figure_ids, block_ids (arrays of the detail)."""
    some = signals.where(F.trim(F.coalesce("code", F.lit(""))) != "").withColumn("code", F.trim("code"))

    def ids(kind: str) -> Column:
        one = F.trim(F.coalesce(f"{kind}_id", F.lit("")))
        every = F.concat(F.array(one), F.coalesce(f"{kind}_ids", _none()))
        return F.transform(F.filter(every, lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))

    named = F.concat(ids("table"), ids("figure"), ids("block"))
    paged = F.when(F.col("page_number").isNotNull(), F.array(F.struct(F.lit("page").alias("kind"), F.col("page_number").cast("string").alias("target"))))
    return some.select("doc_id", "code", F.explode(F.when(F.size(named) > 0, named).otherwise(paged)).alias("t")).select("doc_id", "t.*", "code").distinct()


def with_signals(reader_blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Reader blocks with the codes of their page, table, figure and source blocks, in order, each once."""
    key = ["doc_id", "reader_block_id"]
    one = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("target")))
    spots = F.concat(F.array(F.struct(F.lit("page").alias("kind"), F.col("page_number").cast("string").alias("target")), one("table", "table_id"), one("figure", "figure_id")), F.transform("block_ids", lambda x: F.struct(F.lit("block").alias("kind"), x.alias("target"))))
    # Reader blocks and targets are dealt by document, where they meet by target and a block's spots by block.
    n = scratch.parts(reader_blocks, targets)
    at = reader_blocks.select("*", F.posexplode(F.filter(spots, lambda x: x.isNotNull())).alias("spot_no", "spot")).select("*", "spot.kind", "spot.target").drop("spot").repartition(n, "doc_id")
    told = targets.select("doc_id", "kind", "target", "code").repartition(n, "doc_id")
    at = at.unionByName(told, allowMissingColumns=True)
    found = F.when(F.col("target").isNotNull(), F.collect_set("code").over(Window.partitionBy("doc_id", "kind", "target")))
    at = at.withColumn("found", found).where("spot_no is not null")
    codes = F.sort_array(F.array_distinct(F.flatten(F.collect_list("found").over(Window.partitionBy(*key)))))
    return at.withColumn("codes", codes).where("spot_no = 0").select(*reader_blocks.columns, "codes")


def page_signals(pages: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Signals on pages: empty ones, OCR tried or failed, low confidence of the reading order.

    Pages: doc_id, page_number, text, tables (their number), ocr_attempted, ocr_errors (array), reading_order_confidence."""
    empty = (F.trim(F.coalesce("text", F.lit(""))) == "") & (F.coalesce("tables", F.lit(0)) == 0)
    rules = [
        ("empty_page", "info", empty), ("ocr_attempted", "info", F.coalesce("ocr_attempted", F.lit(False))), ("ocr_failed", "error", F.size(F.coalesce("ocr_errors", _none())) > 0),
        ("reading_order_low_confidence", "warning", F.coalesce(F.col("reading_order_confidence") < threshold, F.lit(False))),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules]), lambda r: r.isNotNull())
    return pages.select("doc_id", "page_number", F.inline(found))


def quality_observation(pages: DataFrame, signals: DataFrame) -> DataFrame:
    """Per document the mean confidence of its pages (0 to 1; pages without one do not count) and how many different (page, code) signals it has."""
    c = F.when(F.col("confidence").isNotNull(), F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)))
    by_doc = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.avg(c).alias("mean"))
    n = signals.select("doc_id", "page_number", "code").distinct().groupBy("doc_id").agg(F.count("*").alias("signals"))
    from lexmill.functions.text import round_half_up

    return by_doc.join(n, "doc_id", "left").select("doc_id", "pages", round_half_up(F.col("mean")).alias("confidence"), F.coalesce("signals", F.lit(0)).alias("signals"))
