"""Word-processor paragraphs against a state machine that takes them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import docx

SCHEMA = "doc_id long, position int, text string, style string, outline_level int"


@pytest.mark.parametrize(("text", "noise", "label", "heading"), [
    ("tmp_12 x", "parse_artifact", "x", None), ("R3TR2", "version_cell", None, None), ("版次", "version_cell", None, None), ("1-2", "page_ref_cell", "1-2", None), ("页码： IV", "page_ref_cell", "IV", None), ("第 3 页", "header_footer", None, None), ("Page 12", "header_footer", None, None),
    ("2024/1/2", "page_ref_cell", "2024/1/2", None), ("AB 12.3", "header_footer", "12.3", None), ("1.2 General 3-4", None, "3-4", ("1.2 General", "body_section", 2)), ("附录A 表格", None, None, ("附录A 表格", "appendix", 1)), ("第三章 总则 一/2", None, "一/2", ("第三章 总则", "body_section", 1)),
    ("7) Tools", None, None, ("7 Tools", "body_section", 1)), ("plain words", None, None, None), ("", None, None, None),
])
def test_lines(spark, text, noise, label, heading):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(docx.noise(F.col("t")).alias("n"), docx.page_label(F.col("t")).alias("l"), docx.numbered_heading(F.col("t")).alias("h")).first()
    assert (r.n, r.l, r.h and (r.h.content, r.h.role, r.h.level)) == (noise, label, heading)


TEXTS = {  # front, signs, heading (role, label), noise, role, page
    "目录": ("toc", 0, None, None, "paragraph", None), "List of effective pages": ("lep", 0, None, None, "lep_entry", None), "Record of revisions": ("revision", 0, None, None, "paragraph", None), "Approval sheet": (None, 1, None, None, "paragraph", None),
    "1.1 Scope 2-3": (None, 0, ("body_section", "2-3"), None, "clause", "2-3"), "1 Scope of it": (None, 0, ("body_section", None), None, "paragraph", None), "Appendix B Tables": (None, 0, ("appendix", None), None, "appendix", None),
    "R3": (None, 0, None, "version_cell", "paragraph", None), "NOTE: mind": (None, 0, None, None, "note", None), "words of the text": (None, 0, None, None, "paragraph", None), "entry of it 3-1": (None, 0, None, None, "paragraph", "3-1"), "": None,
}


def one_by_one(rows):
    started, state, out = False, None, []
    for text, style in rows:
        if not text:
            out.append(("paragraph", "paragraph", "body"))
            continue
        front, signs, h, noise, role, page = TEXTS[text]
        if front:
            state = front
            out.append(("title", "front_matter", "front_matter"))
            continue
        if signs and not started:
            state = None
            out.append(("title", "front_matter", "signature"))
            continue
        if h:
            if started or style or h[0] == "appendix" or h[1] is None:
                started, state = True, None
                out.append(("title", h[0], "appendix" if h[0] == "appendix" else "body"))
            else:
                out.append(("paragraph", "toc_entry", "toc"))
            continue
        if noise:
            out.append(("paragraph", noise, "body" if started else "front_matter"))
            continue
        if role == "paragraph" and state == "toc" and page:
            role = "toc_entry"
        elif role == "paragraph" and state == "lep":
            role = "lep_entry"
        if style and role == "paragraph":
            started = True
            out.append(("title", "body_section", "body"))
            continue
        kind = "toc" if role == "toc_entry" else "front_matter" if role == "lep_entry" or not started else "body"
        out.append(("paragraph", role if started or role in ("toc_entry", "lep_entry", "note") else "paragraph", kind))
    return out


def test_states_one_by_one(spark):
    rng = random.Random(9)
    docs = {d: [(rng.choice([*TEXTS]), rng.choice([None, None, None, "Heading 2"])) for _ in range(rng.randrange(1, 25))] for d in range(150)}
    rows = [(d, i, t, s, None) for d, r in docs.items() for i, (t, s) in enumerate(r)]
    got = {(r.doc_id, r.position): (r.type, r.semantic_role, r.page_type) for r in docx.classify(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    for d, r in docs.items():
        for i, want in enumerate(one_by_one(r)):
            assert got[d, i] == want, (r[: i + 1], got[d, i], want)


def test_nulls(spark):
    assert docx.classify(spark.createDataFrame([], SCHEMA)).count() == 0
    r = docx.classify(spark.createDataFrame([(1, 1, None, None, None), (1, 2, "Opening", "标题 1", 3)], SCHEMA)).orderBy("position").collect()
    assert [(x.type, x.content, x.level) for x in r] == [("paragraph", "", None), ("title", "Opening", 3)]
