"""Runs, staged artifacts, previews, part jobs and stage times: keyed joins and aggregates over the control tables.

Nulls: a null size or duration counts as 0 or not at all, a null state as pending where said.  Repeated rows count as often as they occur."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import round_half_up
from lexmill.operators.metrics import nearest_rank_by

_RUN = ["run_id", "tenant_id", "doc_id", "created_at", "sealed_at", "publication", "validation"]


def staged_counts(runs: DataFrame, staged: dict[str, DataFrame]) -> DataFrame:
    """Each run with the number of its rows in every staging table; each table is counted by run first, a run without rows has 0."""
    out = runs.select(*_RUN)
    for name, rows in staged.items():
        out = out.join(rows.groupBy("run_id").agg(F.count("*").alias(name)), "run_id", "left")
    return out.fillna(0, list(staged))


def run_assets(assets: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that own assets, with their count, bytes and paths in order of position.  Assets: run_id, position, path, bytes."""
    some = assets.groupBy("run_id").agg(
        F.count("*").alias("assets"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.array_sort(F.collect_list(F.struct("position", "path")))["path"].alias("paths")
    )
    return runs.select(*_RUN).join(some, "run_id")


def snapshot(pointers: DataFrame, runs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of each document's active run.  Pointers: tenant_id, doc_id, active_run_id."""
    key = ["tenant_id", "doc_id"]
    live = pointers.select(*key, F.col("active_run_id").alias("run_id")).join(runs.select(*key, "run_id"), [*key, "run_id"], "left_semi")
    return rows.join(live.select("run_id", *key), "run_id")


def previews(wanted: DataFrame, runs: DataFrame, pointers: DataFrame) -> DataFrame:
    """Each wanted run (tenant_id, doc_id, run_id) with what a preview of it gives: ``available``, ``not_found`` (no such run of that
    document), or ``not_available`` (not succeeded, not sealed, published, rejected or in error, or the active run)."""
    key = ["tenant_id", "doc_id", "run_id"]
    ok = (F.col("execution") == "succeeded") & F.col("sealed_at").isNotNull() & (F.col("publication") == "unpublished") & ~F.col("validation").isin("rejected", "error", "not_run")
    known = runs.select(*key, F.coalesce(ok, F.lit(False)).alias("ok"))
    active = pointers.select("tenant_id", "doc_id", F.col("active_run_id").alias("run_id"), F.lit(True).alias("active"))
    j = wanted.join(known, key, "left").join(active, key, "left")
    return j.select(*key, F.when(F.col("ok").isNull(), "not_found").when(F.col("ok") & F.col("active").isNull(), "available").otherwise("not_available").alias("preview"))


def id_collisions(staged: DataFrame, live: DataFrame) -> DataFrame:
    """Staged ids (kind, id, tenant_id, doc_id) that another document's live rows hold already; a semi-join, one row each."""
    s, o = staged.alias("s"), live.alias("o")
    other = (F.col("s.kind") == F.col("o.kind")) & (F.col("s.id") == F.col("o.id")) & ((F.col("s.tenant_id") != F.col("o.tenant_id")) | (F.col("s.doc_id") != F.col("o.doc_id")))
    return s.join(o, other, "left_semi").select(F.concat_ws(":", "kind", "id").alias("collision"), "tenant_id", "doc_id").distinct()


def claim_next(jobs: DataFrame, as_of: str) -> DataFrame:
    """The job that a worker takes next: the oldest pending one that is ready; ties by id.  No row if none is."""
    now = F.to_timestamp(F.lit(as_of))
    ready = jobs.where((F.col("state") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
    return ready.orderBy("created_at", "job_id").limit(1)


def after_failure(jobs: DataFrame, as_of: str, base: float = 1.0, most: float = 60.0, attempts: int = 3) -> DataFrame:
    """Failed or expired jobs after their attempt: dead letters once ``attempts`` are used up, else pending again after the retry delay.

    Jobs: job_id, state, attempt_count, lease_expires_at.  A running job whose lease has not expired is left out."""
    from lexmill.operators.metrics import retry_delay

    now = F.to_timestamp(F.lit(as_of))
    lost = (F.col("state") == "failed") | ((F.col("state") == "running") & (F.col("lease_expires_at") < now))
    dead = F.coalesce("attempt_count", F.lit(0)) >= attempts
    delay = retry_delay(F.col("attempt_count"), base, most)
    return jobs.where(lost).select("job_id", F.when(dead, "dead_letter").otherwise("pending").alias("state"), F.when(~dead, F.timestamp_seconds(now.cast("double") + delay)).alias("next_attempt_at"))


# States in which a part's job is at work.
ACTIVE = ("parsing", "structuring", "embedding")


def part_jobs(jobs: DataFrame) -> DataFrame:
    """Per tenant the jobs on parts by state, retries that wait, and durations of the done ones.
    Jobs: tenant_id, state, failure_reason, next_attempt_at, duration."""
    s = F.col("state")
    cancelled = (s == "failed") & (F.lower(F.trim(F.coalesce("failure_reason", F.lit("")))) == "cancelled")
    done = F.when(s == "done", F.col("duration"))
    g = jobs.groupBy("tenant_id").agg(
        F.count("*").alias("parts_total"), F.count_if(s == "done").alias("parts_done"), F.count_if((s == "failed") & ~cancelled).alias("parts_failed"), F.count_if(s.isin(*ACTIVE)).alias("parts_active"),
        F.count_if(s == "pending").alias("parts_queued"), F.count_if(cancelled).alias("parts_cancelled"), F.count_if((s == "pending") & F.col("next_attempt_at").isNotNull()).alias("parts_retry_pending"),
        F.count(done).alias("durations"), round_half_up(F.avg(done), 3).alias("mean"), F.min(done).alias("least"), F.max(done).alias("most"),
    )
    picks = nearest_rank_by(jobs.where("state = 'done'"), ["tenant_id"], "duration", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return g.join(picks, "tenant_id", "left")


def active_parts(jobs: DataFrame) -> DataFrame:
    """How many part jobs of each parent are at work."""
    return jobs.where(F.col("state").isin(*ACTIVE)).groupBy("tenant_id", "parent_doc_id").agg(F.count("*").alias("active"))


def stage_timings(entries: DataFrame) -> DataFrame:
    """Seconds of each stage of a document, and its share of the whole (0 if there is no time); entries: doc_id, stage, seconds."""
    g = entries.groupBy("doc_id", "stage").agg(F.sum(F.greatest(F.coalesce("seconds", F.lit(0.0)), F.lit(0.0))).alias("seconds"))
    whole = F.sum("seconds").over(Window.partitionBy("doc_id"))
    return g.select("doc_id", "stage", round_half_up(F.col("seconds"), 6).alias("seconds"), F.when(whole > 0, round_half_up(F.col("seconds") / whole)).otherwise(0.0).alias("share"))


def signal_summary(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Signals per key, in all and by severity and code, as maps; a null name is unknown."""

    def by(column: str) -> DataFrame:
        n = signals.groupBy(*keys, F.coalesce(column, F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
        return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(f"by_{column}"), F.sum("n").alias("total"))

    return by("severity").join(by("code").drop("total"), keys)


def dashboard(jobs: DataFrame, recent: int = 5) -> DataFrame:
    """Per tenant: jobs by state, units, and the ids of the latest ones, newest first.  Jobs: tenant_id, job_id, state, quota_units, created_at."""
    w = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    last = jobs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= recent).groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct("rn", "job_id")))["job_id"].alias("recent"))
    s = F.coalesce("state", F.lit("pending"))
    g = jobs.groupBy("tenant_id").agg(
        F.count("*").alias("jobs"), F.count_if(s == "done").alias("done"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin("done", "failed")).alias("active"), F.sum(F.greatest(F.coalesce("quota_units", F.lit(1)), F.lit(1))).alias("units")
    )
    return g.join(last, "tenant_id")


def recovered_parts(parts: DataFrame) -> DataFrame:
    """Running parts of an interrupted run are pending again, and say why."""
    hung = F.coalesce(F.col("state") == "running", F.lit(False))
    return parts.withColumns({"state": F.when(hung, "pending").otherwise(F.col("state")), "last_error": F.when(hung, "interrupted_before_checkpoint")})


def selected_parts(parts: DataFrame, most: int, failed_only: bool = False) -> DataFrame:
    """The parts of each run to work on next, in order of index: pending and failed ones, or failed ones only."""
    if most < 1:
        raise ValueError("at least one part is asked for")
    w = Window.partitionBy("run_id").orderBy(F.coalesce("part_index", F.lit(0)), "part_id")
    some = parts.where(F.col("state").isin(*(["failed"] if failed_only else ["pending", "failed"])))
    return some.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


# --- samples and gates ---------------------------------------------------------------------------------------------

# What each axis of a page's score weighs.
GOLD_WEIGHTS = {"completeness": 25, "reading_order": 20, "table_text_coverage": 25, "heading_hierarchy": 15, "key_tokens": 10, "runtime_cost": 5}


def gold_scores(pages: DataFrame) -> DataFrame:
    """Score of a provider's page against what is expected of it, its axes, vetoes and status.

    Pages: page_id, provider, done, blocks (evidence on the page), ordered, with_provenance, approved (booleans), anchors, anchor_hits, table_anchors, table_hits,
    ordered_anchors, order_ok, kinds, kind_hits, forbidden, forbidden_hits, critical, critical_hits, elapsed, baseline_elapsed; no critical tokens: the anchors are."""
    n = lambda c: F.coalesce(c, F.lit(0))

    def share(hits: str, of: str, empty: float = 1.0) -> Column:
        return F.when(n(of) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), n(hits) / n(of)))).otherwise(empty)

    of = F.when(n("critical") > 0, n("critical")).otherwise(n("anchors"))
    hits = F.when(n("critical") > 0, n("critical_hits")).otherwise(n("anchor_hits"))
    timed = (F.col("elapsed") > 0) & (F.col("baseline_elapsed") > 0)
    axes = {
        "completeness": share("anchor_hits", "anchors"), "reading_order": F.when(n("ordered_anchors") == 0, 1.0).when(F.col("order_ok"), 1.0).otherwise(0.0), "table_text_coverage": share("table_hits", "table_anchors"),
        "heading_hierarchy": F.least(share("kind_hits", "kinds"), 1.0 - share("forbidden_hits", "forbidden", 0.0)), "key_tokens": F.when(of > 0, F.least(F.lit(1.0), hits / of)).otherwise(1.0),
        "runtime_cost": F.when(F.coalesce(timed, F.lit(False)), F.least(F.lit(1.0), F.col("baseline_elapsed") / F.col("elapsed"))).otherwise(0.0),
    }
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    vetoes = F.filter(F.array(
        F.when(no("done"), "provider_not_completed"), F.when(n("blocks") == 0, "missing_expected_page"), F.when(no("ordered"), "duplicate_or_unordered_blocks"), F.when(no("with_provenance"), "missing_block_provenance"),
        F.when(no("approved"), "provider_license_not_approved"), F.when(n("table_hits") < n("table_anchors"), "table_structure_missing_anchor"), F.when(hits < of, "critical_token_missing"),
    ), lambda v: v.isNotNull())
    score = reduce(Column.__add__, [float(GOLD_WEIGHTS[k]) * a for k, a in axes.items()], F.lit(0.0))
    return pages.select(
        "page_id", "provider", F.when(F.size(vetoes) > 0, "blocked").otherwise("scored").alias("status"), round_half_up(score, 3).alias("score"), *[round_half_up(a * 100, 3).alias(k) for k, a in axes.items()], vetoes.alias("vetoes")
    )


def sample_gate(samples: DataFrame) -> DataFrame:
    """A row for each check over all samples: how many (or the least value) pass, what is asked for, and whether it passes.  Without
    samples everything passes.  Samples: status, requested_pages, parsed_pages, reasons_complete, traceability."""
    n = lambda c: F.coalesce(c, F.lit(0))
    tests = {
        "all_samples_completed": F.coalesce(F.col("status") == "done", F.lit(False)), "all_samples_have_page_coverage": n("parsed_pages") > 0,
        "requested_pages_have_audit_record": n("requested_pages") <= n("parsed_pages"), "missing_reason_completeness": F.coalesce("reasons_complete", F.lit(False)),
    }
    trace = F.coalesce(F.min(F.coalesce("traceability", F.lit(0.0))), F.lit(1.0))
    one = samples.agg(F.count("*").alias("all"), *[F.count_if(t).alias(k) for k, t in tests.items()], trace.alias("trace"))
    rows = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("actual"), F.col("all").cast("double").alias("threshold"), (F.col(k) == F.col("all")).alias("passed")) for k in tests]
    rows.append(F.struct(F.lit("chunk_source_traceability").alias("metric"), F.col("trace").alias("actual"), F.lit(1.0).alias("threshold"), (F.col("trace") >= 1.0).alias("passed")))
    return one.select(F.inline(F.array(*rows)))


def ocr_benchmark(results: DataFrame) -> DataFrame:
    """One row of sums over documents, and the slowest page.  Results: status, elapsed, attempted, fallback, rejected, failed, native_tokens, final_tokens, ocr_elapsed, most_page."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return results.agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "failed").alias("failed_documents"), round_half_up(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 3).alias("elapsed"),
        *[total(c) for c in ("attempted", "fallback", "rejected", "failed", "native_tokens", "final_tokens")],
        round_half_up(F.coalesce(F.sum("ocr_elapsed"), F.lit(0.0)), 3).alias("ocr_elapsed"), round_half_up(F.coalesce(F.max("most_page"), F.lit(0.0)), 3).alias("most_page"),
    )


def joined_reports(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Part reports of large documents put together: parts, indices that came twice, pages covered, gaps between the pages, and whether
    every page is covered once.  Parts: doc_id, part_index, page_start, page_end (done ones); totals: doc_id, total_pages."""
    one = parts.groupBy("doc_id", "part_index").agg(F.min(F.struct("page_start", "page_end")).alias("p"), F.count("*").alias("n")).select("doc_id", "part_index", "n", "p.*")
    w = Window.partitionBy("doc_id").orderBy("page_start", "page_end")
    reach = F.coalesce(F.max("page_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("reach", reach)
    g = one.groupBy("doc_id").agg(
        F.count("*").alias("parts"), F.count_if(F.col("n") > 1).alias("duplicate_parts"), F.sum(F.greatest(F.lit(0), F.col("page_end") - F.greatest(F.col("reach"), F.col("page_start") - 1))).alias("covered_pages"),
        F.count_if(F.col("page_start") > F.col("reach") + 1).alias("gaps"), F.count_if(F.col("page_start") <= F.col("reach")).alias("overlaps"),
    )
    return totals.join(g, "doc_id", "left").fillna(0, ["parts", "duplicate_parts", "covered_pages", "gaps", "overlaps"]).withColumn(
        "complete", (F.col("covered_pages") == F.col("total_pages")) & (F.col("gaps") == 0) & (F.col("overlaps") == 0)
    )
