"""Page geometry over words and lines with x0, top, x1, bottom (points)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def overlap_area(a: str, b: str) -> Column:
    c = lambda s, k: F.col(f"{s}.{k}")
    return overlap(c(a, "x0"), c(a, "x1"), c(b, "x0"), c(b, "x1")) * overlap(c(a, "top"), c(a, "bottom"), c(b, "top"), c(b, "bottom"))


def area(a: str) -> Column:
    return F.greatest(F.col(f"{a}.x1") - F.col(f"{a}.x0"), F.lit(0.0)) * F.greatest(F.col(f"{a}.bottom") - F.col(f"{a}.top"), F.lit(0.0))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Words of a page into lines: buckets of 2 points, cut where the gap exceeds max(12, 3% of the width)."""
    b = words.withColumn("bucket", F.bround(F.col("top") / 2))
    w = Window.partitionBy("doc_id", "page_number", "bucket").orderBy("x0", "x1")
    cut = F.col("x0") - F.lag("x1").over(w) > F.greatest(F.lit(12.0), 0.03 * F.col("page_width"))
    b = b.withColumn("cut", F.coalesce(cut.cast("int"), F.lit(0))).withColumn("part", F.sum("cut").over(w))
    parts = F.array_sort(F.collect_list(F.struct("x0", "x1", "text")))
    return b.groupBy("doc_id", "page_number", "bucket", "part").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.array_join(parts["text"], " ").alias("text"), F.max("page_width").alias("page_width")).drop("bucket", "part")


def column_of(lines: DataFrame) -> DataFrame:
    """0 for a line across both columns (55% wide or over the middle), else 1 left or 2 right."""
    w = F.col("page_width")
    across = (F.col("x1") - F.col("x0") >= 0.55 * w) | (F.col("x0") < 0.48 * w) & (F.col("x1") > 0.52 * w)
    return lines.withColumn("column", F.when(across, 0).when((F.col("x0") + F.col("x1")) / 2 < w / 2, 1).otherwise(2))


def bands(lines: DataFrame, gap: float) -> DataFrame:
    """Lines of a page that follow within ``gap`` of the lowest bottom so far, as bands."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("top", "x0")
    below = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = lines.withColumn("opens", F.coalesce((F.col("top") - below > gap).cast("int"), F.lit(1))).withColumn("band", F.sum("opens").over(w))
    return b.groupBy("doc_id", "page_number", "band").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("lines"))


def in_region(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Line-region pairs of a page that overlap, with the share of the line inside. Pages are the join key."""
    box = lambda: F.struct("x0", "top", "x1", "bottom")
    a = lines.select("doc_id", "page_number", "line_id", box().alias("a"))
    b = regions.select("doc_id", "page_number", "region_id", box().alias("b"))
    j = a.join(b, ["doc_id", "page_number"])
    return j.select("doc_id", "page_number", "line_id", "region_id", F.when(area("a") > 0, overlap_area("a", "b") / area("a")).otherwise(0.0).alias("share")).where("share > 0")


def text_with_gaps(lines: DataFrame) -> DataFrame:
    """A page's text: a blank line where the gap to the line above exceeds .8 of the median line height."""
    med = F.percentile(F.col("bottom") - F.col("top"), F.lit(0.5)).over(Window.partitionBy("doc_id", "page_number"))
    w = Window.partitionBy("doc_id", "page_number").orderBy("top", "x0")
    a = lines.withColumn("height", med).withColumn("gap", F.col("top") - F.lag("bottom").over(w))
    piece = F.when(F.col("gap") > 0.8 * F.col("height"), F.concat(F.lit("\n"), "text")).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("top", "x0", piece.alias("t"))))
    return a.groupBy("doc_id", "page_number").agg(F.array_join(parts["t"], "\n").alias("page_text"))


def words_to_columns(words: DataFrame, headers: DataFrame) -> DataFrame:
    """Words to the header whose midpoint interval [left, right) holds the word's centre."""
    c = (F.col("x0") + F.col("x1")) / 2
    w = Window.partitionBy("doc_id", "page_number").orderBy("centre")
    h = headers.select("doc_id", "page_number", "name", c.alias("centre"))
    h = h.withColumn("left", F.coalesce((F.lag("centre").over(w) + F.col("centre")) / 2, F.lit(float("-inf")))).withColumn("right", F.coalesce((F.lead("centre").over(w) + F.col("centre")) / 2, F.lit(float("inf"))))
    return words.withColumn("c", c).join(h, ["doc_id", "page_number"]).where((F.col("c") >= F.col("left")) & (F.col("c") < F.col("right"))).drop("c", "centre", "left", "right")


def repeated_figures(figures: DataFrame, least: int = 3) -> DataFrame:
    """Figures without those whose box (in rounded percent of the page) recurs on three pages with low confidence."""
    pct = lambda c, whole: F.floor(100.0 * F.col(c) / F.col(whole) + 0.5)
    f = figures.withColumn("sig", F.concat_ws(",", pct("x0", "page_width"), pct("top", "page_height"), pct("x1", "page_width"), pct("bottom", "page_height")))
    often = f.groupBy("doc_id", "sig").agg(F.count_distinct("page_number").alias("n")).where(F.col("n") >= least)
    return f.join(often, ["doc_id", "sig"], "left").where(F.col("n").isNull() | (F.col("confidence") >= 0.65)).drop("sig", "n")


def order_confidence(columns: Column, applied: Column, strategy: Column, empty: Column) -> Column:
    """Fixed values by layout strategy; null for an empty page."""
    return (
        F.when(empty, None).when(columns <= 1, 0.98).when(~applied, F.when(strategy == "mixed", 0.58).otherwise(0.64))
        .when(strategy == "gutter", 0.9).when(strategy == "bands", 0.84).when(strategy == "regions", 0.86).otherwise(0.8)
    )


_PAGE = ["doc_id", "page_number"]
_KEYWORD = r"(?iU)(?:流程图|流程|示意图|结构图|架构图|关系图|原理图|布置图|组织机构图|图示|图片|照片|Figure|Fig\.?|Illustration|Image|Photo|Chart|Diagram|Flow\s*Chart|Flowchart|Workflow|Process\s+Map|Architecture\s+Diagram)"
_GENERIC = r"(?U)^\s*第\s*\d+\s*页图示区域\s*$"
_KINDS = {
    "flowchart": r"(?iU)(?:流程图|flow\s*chart|flowchart|workflow)",
    "structure": r"(?iU)(?:结构图|组织机构图|组织架构|structure|organization(?:al)?\s+chart)",
    "diagram": r"(?iU)(?:示意图|原理图|布置图|diagram|schematic|layout)",
    "chart": r"(?iU)(?:Chart|Graph|曲线图|柱状图|折线图|图表)",
    "illustration": r"(?iU)(?:Photo|Image|Illustration|图片|照片|插图)",
}
MOST_REGIONS, MOST_REGION_SHARE, LEAST_IMAGE_SHARE, MOST_IMAGE_SHARE = 4, 0.6, 0.03, 0.5


def _boxes_meet(a: str, b: str) -> Column:
    """Half-open separation: boxes that only touch do not meet."""
    c = lambda s, k: F.col(f"{s}.{k}")
    return ~((c(a, "x1") <= c(b, "x0")) | (c(a, "x0") >= c(b, "x1")) | (c(a, "bottom") <= c(b, "top")) | (c(a, "top") >= c(b, "bottom")))


def _meeting_none(boxes: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of ``boxes`` that meet no box of ``others`` on their page."""
    a, b = boxes.alias("a"), others.select(*_PAGE, "x0", "top", "x1", "bottom").alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_number") == F.col("b.page_number"))
    return a.join(b, same & _boxes_meet("a", "b"), "left_anti")


def figure_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words of a page, by (top, x0), into lines: a word within ``tolerance`` of its line's first word joins it."""
    lo, hi = lambda a, b: F.least(F.col(a), F.col(b)), lambda a, b: F.greatest(F.col(a), F.col(b))
    clean = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    w = words.select(*_PAGE, lo("top", "bottom").cast("double").alias("top"), lo("x0", "x1").cast("double").alias("x0"), hi("x0", "x1").cast("double").alias("x1"), hi("top", "bottom").cast("double").alias("bottom"), clean.alias("text")).dropna()
    one = F.struct("top", "x0", "x1", "bottom", "text")
    p = w.where("text != ''").groupBy(*_PAGE).agg(F.array_sort(F.collect_list(one)).alias("ws"))
    tops = F.aggregate("ws", F.array().cast("array<double>"), lambda s, x: F.when((F.size(s) > 0) & (F.abs(x["top"] - F.element_at(s, -1)) <= tolerance), s).otherwise(F.array_append(s, x["top"])))
    p = p.withColumn("tops", tops).select(*_PAGE, "tops", F.explode("ws").alias("w"))
    p = p.withColumn("line", F.size(F.filter("tops", lambda x: x <= F.col("w.top"))))
    parts = F.array_sort(F.collect_list("w"))
    return p.groupBy(*_PAGE, "line").agg(F.min("w.x0").alias("x0"), F.min("w.top").alias("top"), F.max("w.x1").alias("x1"), F.max("w.bottom").alias("bottom"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def caption_confidence(description: Column, is_label: Column, appended: Column) -> Column:
    generic = description.rlike(_GENERIC)
    return F.when(generic, 0.15).when(is_label & appended, 0.95).when(is_label | description.rlike(_KEYWORD), 0.9).otherwise(0.65)


def figure_kind(description: Column) -> Column:
    d = F.coalesce(description, F.lit(""))
    kind = F.when((d == "") | d.rlike(_GENERIC), "generic")
    for name, pattern in _KINDS.items():
        kind = kind.when(d.rlike(pattern), name)
    return kind.otherwise("figure")


def keep_figures(figures: DataFrame, tables: DataFrame) -> DataFrame:
    """Figures of 18 points and more, of .0015 to .8 of the page and outside its margins unless captioned (.8), not three quarters in a table."""
    c, pw, ph = F.col, F.col("page_width"), F.col("page_height")
    wide, high = c("x1") - c("x0"), c("bottom") - c("top")
    share = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0)) / F.greatest(pw * ph, F.lit(1.0))
    edge = ((c("top") <= ph * 0.12) & (c("bottom") <= ph * 0.22)) | ((c("bottom") >= ph * 0.88) & (c("top") >= ph * 0.76))
    side = (c("x0") <= pw * 0.08) | (c("x1") >= pw * 0.92)
    noise = ((c("top") < 0) & (c("bottom") <= ph * 0.24)) | ((share <= 0.055) & edge) | ((share <= 0.018) & side & ((c("top") <= ph * 0.2) | (c("bottom") >= ph * 0.8)))
    sure = F.coalesce(c("confidence"), F.lit(0.0)) >= 0.8
    f = figures.where((wide >= 18) & (high >= 18) & (pw > 0) & (ph > 0) & (sure | ((share < 0.8) & (share >= 0.0015) & ~noise))).alias("a")
    t = tables.select(*_PAGE, "x0", "top", "x1", "bottom").alias("b")
    same = (c("a.doc_id") == c("b.doc_id")) & (c("a.page_number") == c("b.page_number"))
    return f.join(t, same & (overlap_area("a", "b") >= 0.75 * area("a")), "left_anti")


def ocr_coordinates(lines: DataFrame) -> DataFrame:
    """Line boxes of a rendered region (rendered_width, rendered_height) on their page, by the region's origin and size.

    Without a page size the rendered one counts, without a source size the page's; nothing for an empty rendering."""
    r = lines.where("rendered_width > 0 and rendered_height > 0")
    size = lambda k: F.coalesce(F.col(f"source_{k}"), F.when(F.col(f"page_{k}") > 0, F.col(f"page_{k}")).otherwise(F.col(f"rendered_{k}")))
    on = lambda c, o, k: F.bround(F.coalesce(F.col(o), F.lit(0.0)) + F.col(c) * (size(k) / F.col(f"rendered_{k}")), 4)
    moved = {"x0": on("x0", "origin_x", "width"), "top": on("top", "origin_top", "height"), "x1": on("x1", "origin_x", "width"), "bottom": on("bottom", "origin_top", "height")}
    return r.withColumns(moved)


def ocr_regions(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Bands of unusable lines of a page that meet no table; none where there are too many or they cover most of it.

    Lines: doc_id, page_number, x0, top, x1, bottom, unusable, page_width, page_height."""
    bad = lines.where("unusable").withColumn("bottom", F.when(F.coalesce("bottom", F.lit(0)) == 0, F.col("top")).otherwise(F.col("bottom")))
    page = Window.partitionBy(*_PAGE)
    heights = F.array_sort(F.collect_list(F.greatest(F.lit(1.0), F.col("bottom") - F.col("top"))).over(page))
    bad = bad.withColumn("gap", F.greatest(F.lit(2.0), 1.5 * F.get(heights, F.floor(F.size(heights) / 2).cast("int"))))
    sizes = bad.groupBy(*_PAGE).agg(F.greatest(F.lit(1.0), F.max("page_width").cast("double") * F.max("page_height")).alias("whole"))
    r = _meeting_none(bands(bad, F.col("gap")), tables).join(sizes, _PAGE)
    size = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("bottom") - F.col("top"))
    r = r.withColumn("n", F.count("*").over(page)).withColumn("covered", F.sum(size).over(page))
    return r.where((F.col("n") <= MOST_REGIONS) & (F.col("covered") / F.col("whole") <= MOST_REGION_SHARE)).select(*_PAGE, "x0", "top", "x1", "bottom")


def image_regions(images: DataFrame, lines: DataFrame, tables: DataFrame) -> DataFrame:
    """A page's largest pictures of .03 to .5 of it that meet neither a table nor a line of text."""
    size = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("bottom") - F.col("top"))
    share = size / F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height"))
    own = lines.withColumn("bottom", F.when(F.coalesce("bottom", F.lit(0)) == 0, F.col("top")).otherwise(F.col("bottom")))
    r = _meeting_none(_meeting_none(images.where((size > 0) & (share >= LEAST_IMAGE_SHARE) & (share <= MOST_IMAGE_SHARE)), tables), own)
    w = Window.partitionBy(*_PAGE).orderBy(size.desc(), "top", "x0")
    return r.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MOST_REGIONS).drop("rn")


def merge_ocr_lines(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """A page's own lines that are not ``replaced``, and the OCR lines (in order of ``line_index``) that do not repeat
    a line kept so far: same text without white space, boxes that meet."""
    box = "struct<top:double,x0:double,x1:double,bottom:double,at:long,text:string,source_kind:string>"
    key = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "").alias("key")
    bottom = F.when(F.coalesce("bottom", F.lit(0)) == 0, F.col("top")).otherwise(F.col("bottom"))
    a = native.where(~F.col("replaced")).select(*_PAGE, key, F.struct("top", "x0", "x1", bottom, F.lit(-1), "text", F.lit("pdf_native_text")).cast(box).alias("x"))
    b = ocr.select(*_PAGE, key, F.struct("top", "x0", "x1", "bottom", "line_index", "text", F.lit("pdf_ocr_fallback")).cast(box).alias("x")).where("key != ''")
    by_at = F.array_sort(F.collect_list(F.struct("x.at", "x.top", "x.x0", "x")))
    meets = lambda p, q: ~((p["x1"] <= q["x0"]) | (p["x0"] >= q["x1"]) | (p["bottom"] <= q["top"]) | (p["top"] >= q["bottom"]))
    kept = F.aggregate("xs", F.array().cast(f"array<{box}>"), lambda s, e: F.when((e["x"]["at"] >= 0) & F.exists(s, lambda o: meets(e["x"], o)), s).otherwise(F.array_append(s, e["x"])))
    g = a.unionByName(b).groupBy(*_PAGE, "key").agg(by_at.alias("xs")).select(*_PAGE, F.explode(kept).alias("x")).select(*_PAGE, "x.*")
    w = Window.partitionBy(*_PAGE).orderBy("top", "x0", "at")
    return g.withColumn("position", F.row_number().over(w)).drop("at")


def box_union(lines: DataFrame, key: list[str]) -> DataFrame:
    """The box around all boxes of some extent."""
    g = lines.where("x1 > x0 and bottom > top").groupBy(*key)
    return g.agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
