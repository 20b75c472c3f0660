"""Column kernels on text. All are Catalyst expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and thresholds whose results must agree with the published behaviour.
WORD = r"[\p{L}\p{N}_]+"
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{20000}-\x{2fa1f}"
CID_TOKEN = r"\(cid:\d+\)"
PDF_NAME_TOKEN = r"(?<![\p{L}\p{N}_])/i?\d+(?![\p{L}\p{N}_])"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
COMPONENT = r"[A-Za-z0-9\x{4e00}-\x{9fff}]+"
NUMERIC_HEAVY, SHORT_LINE = 0.6, 80
CID_LEAST, CID_SHARE, NAME_LEAST, NAME_SHARE = 5, 0.08, 5, 0.08
CONTROL_MOST, PRINTABLE_LEAST, REPEATED_MOST = 0.03, 0.75, 0.35


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def inline_space(c: Column) -> Column:
    """Runs of blanks, tabs and ideographic spaces become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(c, "[ \t　]+", " "))


def record_text(c: Column) -> Column:
    """All white space runs become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def round_half_up(c: Column, digits: int = 4) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same bits in every engine, unlike the built-in."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def search_tokens(c: Column) -> Column:
    """Lower-case words; a run of Chinese characters gives its overlapping bigrams instead."""
    runs = F.regexp_extract_all(text_or_empty(c), F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}_&&[^{CJK}]]+"), F.lit(0))

    def expand(run: Column) -> Column:
        n = F.char_length(run)
        bigrams = F.when(n == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))
        return F.when(run.rlike(f"^[{CJK}]"), bigrams).otherwise(F.array(F.lower(run)))

    return F.flatten(F.transform(runs, expand))


def numeric_heavy(c: Column) -> Column:
    n = F.char_length(c)
    return (n > 0) & (F.regexp_count(c, F.lit(r"\d")) >= NUMERIC_HEAVY * n)


def header_footer_like(c: Column) -> Column:
    s = F.trim(c)
    return (F.char_length(s) > 0) & (F.char_length(s) <= SHORT_LINE) & (numeric_heavy(s) | F.lower(s).startswith("page "))


def heading_like(c: Column) -> Column:
    """One short line, mostly upper case or opened by a heading marker."""
    s = F.trim(c)
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    upper = F.regexp_count(s, F.lit(r"\p{Lu}"))
    marked = s.rlike(r"^(?i)(chapter|section|appendix|part)\s+\S|^\d+(\.\d+)*[.)]?\s+\p{Lu}")
    return (F.instr(s, "\n") == 0) & (F.char_length(s) <= SHORT_LINE) & (((letters >= 3) & (upper >= 0.8 * letters)) | marked)


def printable_count(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[\p{C}&&[^\n\r\t]]", ""))


def garble(c: Column) -> Column:
    """Struct of the counts from which a text's garbling is judged; null reads as empty."""
    t = F.trim(text_or_empty(c))
    parts = F.transform(F.regexp_extract_all(t, F.lit(COMPONENT), F.lit(0)), F.lower)
    short = F.filter(parts, lambda p: F.char_length(p) <= 2)
    # Sorted, equal components are neighbours: one fold adds up the runs of three and more.
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("sum"))

    def step(s: Column, p: Column) -> Column:
        run = F.when(s["last"] == p, s["run"] + 1).otherwise(1)
        return F.struct(p.alias("last"), run.alias("run"), (s["sum"] + F.when(run == 3, 3).when(run > 3, 1).otherwise(0)).alias("sum"))

    repeated = F.aggregate(F.array_sort(short), start, step, lambda s: s["sum"])
    return F.struct(
        F.char_length(t).alias("chars"),
        F.regexp_count(t, F.lit(CID_TOKEN)).alias("cid_tokens"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, CID_TOKEN, ""))).alias("cid_chars"),
        F.regexp_count(t, F.lit(PDF_NAME_TOKEN)).alias("name_tokens"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, PDF_NAME_TOKEN, ""))).alias("name_chars"),
        F.regexp_count(t, F.lit(CONTROL)).alias("control_chars"),
        printable_count(t).alias("printable_chars"),
        F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fff}]")).alias("cjk_chars"),
        F.regexp_count(t, F.lit("[A-Za-z]")).alias("latin_chars"),
        F.size(parts).alias("components"),
        repeated.alias("repeated_short"),
    )


def garble_reason(g: Column) -> Column:
    """The first rule that the counts of :func:`garble` break, or null."""
    n = g["chars"]
    return (
        F.when(n == 0, "empty_text")
        .when((g["cid_tokens"] >= CID_LEAST) & (g["cid_chars"] >= CID_SHARE * n), "cid_dense")
        .when((g["name_tokens"] >= NAME_LEAST) & (g["name_chars"] >= NAME_SHARE * n), "pdf_name_dense")
        .when(g["control_chars"] >= CONTROL_MOST * n, "control_char_dense")
        .when(g["printable_chars"] < PRINTABLE_LEAST * n, "low_printable_ratio")
        .when((g["components"] > 0) & (g["repeated_short"] >= REPEATED_MOST * g["components"]), "repeated_short_tokens")
        .when((g["cjk_chars"] > 0.15 * n) & (g["latin_chars"] > 0) & (g["latin_chars"] < 0.02 * n), "script_distribution_anomaly")
    )


def last_date(c: Column) -> Column:
    """The last valid year-month-day in the text, as YYYY-MM-DD."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(r"\b(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b"), F.lit(1))
    dates = F.filter(F.transform(found, lambda d: F.try_to_date(F.regexp_replace(d, "[/.]", "-"), "yyyy-M-d")), lambda d: d.isNotNull())
    return F.date_format(F.get(dates, F.size(dates) - 1), "yyyy-MM-dd")


def identifier(c: Column) -> Column:
    """No-break spaces to blanks, any dash to a hyphen, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.translate(c, "   ", "   "), r"[‐-―−－]", "-")))


def join_boundary(a: Column, b: Column) -> Column:
    """Two pieces of one paragraph: a trailing hyphen before a small letter joins the word,
    Chinese on both sides joins without a blank, all else with one."""
    hyphen = a.rlike(r"\p{L}-$") & b.rlike(r"^\p{Ll}")
    cjk = a.rlike(f"[{CJK}]$") & b.rlike(f"^[{CJK}]")
    return F.when(hyphen, F.concat(F.substring(a, F.lit(1), F.char_length(a) - 1), b)).when(cjk, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))


def canonical_hash(*cols: Column) -> Column:
    """sha256 over a key-sorted compact JSON object of the columns."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
