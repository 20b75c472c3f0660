"""Operator 8 [native]: canonical exact digest.

A text is normalised (NFKC), case-folded, normalised again, and its white space
runs are folded to one blank; pure ASCII texts need lower-casing only.  The
fingerprint is a 256-bit digest of four chained xxhash64 lanes; equal digests
are compared byte by byte on the canonical texts.  The ICU routines come with
Spark and are called through SQL's ``java_method``: no Python runs on the
executors.

An exact digest knows equal and unequal only, so every likeness is 1.0 or 0.0.

Defined results: a null text is empty; empty texts are equal to each other;
repeated ids are ordered by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import slim_docs

LANES = 4
DOCS_PER_BUCKET, MOST_BUCKETS = 1000, 1024


def _java(cls: str, method: str, text: Column) -> Column:
    return F.call_function("java_method", F.lit(cls), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    nfkc = lambda x: _java("com.ibm.icu.text.Normalizer", "compose", x)
    folded = nfkc(_java("com.ibm.icu.lang.UCharacter", "foldCase", nfkc(text)))
    same = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(same, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """xxhash64 starts a column from the hash of those before it, so a leading number seeds a lane."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(lane), canon)), 16, "0") for lane in range(LANES)]))


def _bounds(ids: DataFrame) -> tuple[list[int], list[int | None], list[int | None], list[int]]:
    """Bucket bounds; per bucket its least id, the bucket before it, and whether that is a wrap.
    At most MOST_BUCKETS numbers come to the driver, from an id-only scan."""
    n = ids.count()
    parts = max(1, min(MOST_BUCKETS, n // DOCS_PER_BUCKET))
    cuts: list[int] = []
    if parts > 1:
        fractions = [i / parts for i in range(1, parts)]
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", fractions, 20 * MOST_BUCKETS).alias("q")).first()["q"] or []))
    least = {r["bucket"]: r["least"] for r in ids.groupBy(_bucket(cuts).alias("bucket")).agg(F.min("doc_id").alias("least")).collect() if r["least"] is not None}
    order = sorted(least)
    before: list[int | None] = [None] * (len(cuts) + 1)
    wraps = [0] * (len(cuts) + 1)
    for i, b in enumerate(order):
        before[b] = order[i - 1]
        wraps[b] = int(i == 0)
    return cuts, [least.get(b) for b in range(len(cuts) + 1)], before, wraps


def _bucket(cuts: list[int]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)) if len(cuts) < 2 else F.from_json(F.lit(str(cuts)), "array<bigint>"), lambda c: c <= F.col("doc_id")))


def with_next(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each kept column: its value in the next document by ascending id
    (after the last: the first).

    The ids are cut into ranges of about DOCS_PER_BUCKET documents, each range is
    one window; the first document of a range is copied into the range before
    it, so one shuffle of the texts is enough and no task sees all rows.
    """
    cuts, least, before, wraps = _bounds(docs.select("doc_id"))

    def by_bucket(values: list) -> Column:
        return F.get(F.from_json(F.lit(str(["x" if v is None else v for v in values]).replace("'x'", "null")), "array<bigint>"), F.col("bucket"))

    rows = docs.withColumn("bucket", _bucket(cuts))
    own = F.array(F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(False).alias("copy"), F.lit(0).alias("wrap")))
    copied = F.array(F.struct(by_bucket(before).cast("int").alias("bucket"), F.lit(True).alias("copy"), by_bucket(wraps).cast("int").alias("wrap")))
    rows = rows.withColumn("place", F.explode(F.when(F.col("doc_id") == by_bucket(least), F.concat(own, copied)).otherwise(own))).drop("bucket").select("*", "place.*").drop("place")
    w = Window.partitionBy("bucket").orderBy("wrap", "doc_id", "text")
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in keep])
    return rows.where(~F.col("copy")).drop("bucket", "copy", "wrap")


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint)."""
    return slim_docs(docs).withColumn("canon", canonical(F.col("text"))).select("doc_id", "text", digest(F.col("canon")).alias("fingerprint"))


def exact_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, class_id): class_id is the least id among the documents of equal canonical text.

    Documents are grouped by digest (ids only, combined before the shuffle);
    those of a shared digest are compared byte by byte with the group's first
    document.  One that differs (a digest collision) goes to the least id among
    the differing documents of the same second digest, sha-256.
    """
    prints = slim_docs(docs).withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", digest(F.col("canon")))
    first = prints.select("doc_id", "fingerprint").groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = prints.join(first, "fingerprint", "left")
    head = rows.where("doc_id = first_id").groupBy("first_id").agg(F.min("canon").alias("first_canon"))
    rows = rows.select("doc_id", "fingerprint", "canon", "first_id").join(head, "first_id", "left")
    same = F.coalesce(F.col("canon") == F.col("first_canon"), F.lit(False))
    judged = rows.select("doc_id", "fingerprint", "first_id", same.alias("same"), F.when(~same & F.col("first_id").isNotNull(), F.sha2("canon", 256)).alias("other"))
    odd = judged.where("other is not null").groupBy("fingerprint", "other").agg(F.min("doc_id").alias("odd_id"))
    return judged.join(odd, ["fingerprint", "other"], "left").select(
        "doc_id", "fingerprint", F.when(F.col("same"), F.col("first_id")).otherwise(F.coalesce("odd_id", "doc_id")).alias("class_id")
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness; see the module's contract."""
    rows = with_next(fingerprint(docs), ["text", "fingerprint"])
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", digest(canonical(F.col("edited"))))

    def likeness(a: str, b: str, x: str, y: str) -> Column:
        return F.when(F.col(a) != F.col(b), 0.0).when(F.col(x) == F.col(y), 1.0).otherwise((canonical(F.col(x)) == canonical(F.col(y))).cast("double"))

    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", "text", "edited").alias("near_edited"), likeness("fingerprint", "next_fingerprint", "text", "next_text").alias("near_next"),
    )
