"""Pulls of boards into a catalog: what is new since the last pull, first of each posting, checks, merge, state.

The order is: normalize, leave out what the board's state rules out, keep the first of each posting in the
order of arrival, check, merge, bring the state up to date. In strict mode a failed check ends a pull before anything
is kept. A state has one row a board: its high watermarks, the last ids in order of arrival, and how the
last pull went.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog, ingest
from ..functions.text import dedup_key, iso_of, text_or_null, timestamp
from ..sources import files
from ..sources.shared import kept

STATE = "source string, source_ref string, high_posted_at string, high_updated_at string, last_success_at_utc string, last_coverage_complete boolean, recent_ids array<string>"
CATALOG = "stable_key string, first_seen_at_utc string, last_seen_at_utc string, is_active boolean, last_payload_hash string, latest_posted_at string, latest_updated_at string, latest_record_json string"
#: Ids that a board's state remembers.
REMEMBERED = 500
_BOARD = ["source", "source_ref"]


@dataclass(frozen=True)
class Pull:
    """One board's pull: its records as JSON texts in ``raw``, and how much of it was asked for.

    ``ordinal``, where the records have it, is their order of arrival; without it they come by their hashes. Records
    are counted unless ``fetched`` says how many there were. ``max_jobs`` is None for a pull without a limit on records.
    """

    source: str
    source_ref: str
    records: DataFrame
    requests: int = 1
    max_pages: int = 25
    max_jobs: int | None = 5000
    fetched: int | None = None
    page_repeated: bool = False

    def complete(self, counted: int | None = None) -> bool:
        """Whether the board was read to its end: no limit was met and no page came twice. False if nobody counted."""
        fetched = self.fetched if self.fetched is not None else counted
        return fetched is not None and self.requests < self.max_pages and (self.max_jobs is None or fetched < self.max_jobs) and not self.page_repeated

    def warnings(self, counted: int | None = None) -> list[str]:
        """Codes in alphabetical order."""
        repeated = ["INGEST_PAGE_REPEAT_DETECTED"] if self.page_repeated else []
        return repeated + ([] if self.complete(counted) else ["INGEST_TRUNCATED"])


# -- the state of boards --------------------------------------------------------------------------------


def effective() -> Column:
    """The later one of a record's dates; null if neither can be read."""
    return F.greatest(timestamp(F.col("posted_at")), timestamp(F.col("source_updated_at")))


def unseen(records: DataFrame, state: DataFrame) -> DataFrame:
    """Records of any boards without those that the board's state rules out.

    A record goes if its id is one of the remembered ones, or if its later date isn't above the later watermark; a date or
    watermark that can't be read rules nothing out. A state without a watermark of posting dates and without ids
    rules nothing out either.
    """
    mark = F.greatest(timestamp(F.col("high_posted_at")), timestamp(F.col("high_updated_at")))
    ids = F.coalesce("recent_ids", F.array().cast("array<string>"))
    blank = text_or_null(F.col("high_posted_at")).isNull() & (F.size(ids) == 0)
    known = state.where(~blank).select(*_BOARD, mark.alias("_mark"), ids.alias("_ids"))
    gone = F.array_contains("_ids", text_or_null(F.col("source_job_id"))) | (effective() <= F.col("_mark"))
    return records.join(known, _BOARD, "left").where(~F.coalesce(gone, F.lit(False))).drop("_mark", "_ids")


def state_after(state: DataFrame, records: DataFrame, runs: DataFrame) -> DataFrame:
    """The state after some boards were pulled: ``records`` are what they gave, ``runs`` (source, source_ref, at, complete) which were.

    Watermarks never go back. Ids are the last ones of those that were there and those that came, in their order; an id may come
    twice. Boards without a run keep their row. Each task passes on the last ids only, so a board with many records needs
    no more memory than one with few.
    """
    order = [F.desc("ordinal"), F.desc("source_payload_hash")] if "ordinal" in records.columns else [F.desc("source_payload_hash")]
    last = Window.partitionBy(*_BOARD).orderBy(*order)
    named = records.select(*_BOARD, text_or_null(F.col("source_job_id")).alias("id"), *[c for c in ("ordinal", "source_payload_hash") if c in records.columns]).where("id is not null")
    ids = named.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= REMEMBERED).groupBy(*_BOARD).agg(F.array_sort(F.collect_list(F.struct((-F.col("nth")).alias("n"), "id")))["id"].alias("came"))
    high = records.groupBy(*_BOARD).agg(F.max(timestamp(F.col("posted_at"))).alias("posted"), F.max(timestamp(F.col("source_updated_at"))).alias("updated"))
    both = runs.join(high, _BOARD, "left").join(ids, _BOARD, "left").join(state, _BOARD, "left")

    def merged(old: str, new: str) -> Column:
        return F.coalesce(iso_of(F.greatest(timestamp(F.col(old)), F.col(new))), F.col(old)).alias(old)

    none = F.array().cast("array<string>")
    all_ids = F.concat(F.coalesce("recent_ids", none), F.coalesce("came", none))
    recent = F.slice(all_ids, F.greatest(F.lit(1), F.size(all_ids) - (REMEMBERED - 1)), F.lit(REMEMBERED))
    pulled = both.select(*_BOARD, merged("high_posted_at", "posted"), merged("high_updated_at", "updated"), F.col("at").alias("last_success_at_utc"), F.col("complete").alias("last_coverage_complete"), recent.alias("recent_ids"))
    return pulled.unionByName(state.join(runs.select(*_BOARD), _BOARD, "left_anti"))


# -- one pull -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Synced:
    """What a pull gave: ``status`` is fail where a strict gate stopped it, and catalog and state are then as they were."""

    status: str
    normalized: DataFrame
    fresh: DataFrame
    records: DataFrame
    checks: DataFrame
    completeness: DataFrame
    catalog: DataFrame
    state: DataFrame


def _first_ones(fresh: DataFrame) -> DataFrame:
    keyed = fresh.withColumn("stable_key", dedup_key())
    return catalog.keep_first(keyed, "stable_key", "ordinal" if "ordinal" in fresh.columns else "source_payload_hash")


def incoming(records: DataFrame) -> DataFrame:
    """Records as the merge takes them."""
    body = F.to_json(F.struct(*[c for c in sorted(records.columns) if c not in ("stable_key", "ordinal")]))
    return records.select("stable_key", F.col("source_payload_hash").alias("payload_hash"), "posted_at", F.col("source_updated_at").alias("updated_at"), body.alias("record_json"))


def synced(pull: Pull, known: DataFrame, state: DataFrame, at: str, policy: str = "updated_hash", prune_days: int = 90, full_refresh: bool = False, strict: bool = False, skipped_stay: bool = False, **quality) -> Synced:
    """One pull as plans; jobs run for the count of records, where the pull doesn't say it, and for a strict gate.

    ``quality`` goes to ingest.quality_checks. With whole coverage, keys of the catalog that didn't come through the filter become inactive,
    those of records that the state ruled out among them; with ``skipped_stay`` these stay as they are.
    """
    spark = known.sparkSession
    ordinal = tuple(c for c in ("ordinal",) if c in pull.records.columns)
    found = ingest.normalized(pull.records, pull.source, pull.source_ref, at, keep=ordinal)
    fresh = found if full_refresh else unseen(found, state)
    records = _first_ones(fresh)
    checks, completeness = ingest.quality_checks(records, at, **quality), ingest.key_completeness(records)
    if strict and not checks.where("status <> 'pass'").isEmpty():
        return Synced("fail", found, fresh, records, checks, completeness, known, state)
    complete = pull.complete(None if pull.fetched is not None else pull.records.count())
    merged = catalog.merge(known, incoming(records), at, complete, policy, prune_days)
    if skipped_stay and complete:
        still = found.select(dedup_key().alias("stable_key")).distinct().withColumn("_came", F.lit(True))
        back = (F.col("change") == "tombstoned") & F.coalesce("_came", F.lit(False))
        merged = merged.join(still, "stable_key", "left").withColumns({"is_active": F.col("is_active") | back, "change": F.when(back, "kept").otherwise(F.col("change"))}).drop("_came")
    runs = spark.range(1).select(F.lit(pull.source).alias("source"), F.lit(pull.source_ref).alias("source_ref"), F.lit(at).alias("at"), F.lit(complete).alias("complete"))
    return Synced("pass", found, fresh, records, checks, completeness, merged, state_after(state, records, runs))


# -- pulls that are written -----------------------------------------------------------------------------


def sync_board(spark: SparkSession, pull: Pull, folder: str, at: str, **options) -> dict:
    """One pull, written under ``folder``: the board's catalog (a new version), its active postings, the boards' state, and a report.

    What comes in is read once and kept; everything after reads that. The catalog is written before the state, so a pull that breaks off
    between the two is pulled again, which changes nothing. Returns the report; an error is raised, nothing being written.
    """
    home = f"{folder.rstrip('/')}/{pull.source}/{pull.source_ref}"
    known, state = files.read_catalog(spark, f"{home}/catalog", CATALOG), files.read_catalog(spark, f"{folder}/state", STATE)
    raw = Pull(**{**pull.__dict__, "records": kept(pull.records, "raw")})
    counted = raw.records.count()
    done = synced(raw, known, state, at, **options)
    n_normalized, n_fresh = done.normalized.count(), done.fresh.count()
    checks = done.checks.collect()
    before = state.where((F.col("source") == pull.source) & (F.col("source_ref") == pull.source_ref)).first()
    report = {
        "schema_version": "1.0", "status": done.status, "source": pull.source, "source_ref": pull.source_ref, "at": at, "request_count": pull.requests, "fetched_count": counted if pull.fetched is None else pull.fetched,
        "normalized_count": n_normalized, "skipped_by_state": n_normalized - n_fresh, "coverage_complete": pull.complete(counted), "quality_status": "pass" if all(c.status == "pass" for c in checks) else "fail",
        "quality_summary": {s: sum(c.status == s for c in checks) for s in ("pass", "warn", "fail")}, "high_watermark_before": before and before.high_posted_at, "high_watermark_after": before and before.high_posted_at, "rows_written": 0, "error": None,
    }
    report["check_codes"] = sorted({*pull.warnings(counted), *(c.code for c in checks if c.status != "pass")})
    completeness = done.completeness.first().asDict()
    unique = completeness.pop("rows")
    report |= {"dedup_dropped": n_fresh - unique, "key_field_completeness": completeness}
    if done.status == "pass":
        merged, after = kept(done.catalog, "merged"), kept(done.state, "state")
        changes = {r["change"]: r["count"] for r in merged.groupBy("change").count().collect()}
        report |= {f"{c}_count": changes.get(c, 0) for c in ("new", "updated", "unchanged", "tombstoned")}
        report["pruned_inactive_count"] = known.where("trim(stable_key) <> ''").count() + changes.get("new", 0) - sum(changes.values())
        files.write_catalog(merged.drop("change").orderBy("stable_key"), f"{home}/catalog")
        active = merged.where("is_active and latest_record_json is not null").select("stable_key", F.from_json("latest_record_json", done.records.drop("stable_key", "ordinal").schema).alias("r"))
        files.write_catalog(active.orderBy("stable_key").select("r.*"), f"{home}/latest")
        files.write_catalog(after, f"{folder}/state")
        mine = after.where((F.col("source") == pull.source) & (F.col("source_ref") == pull.source_ref)).first()
        report |= {"rows_written": active.count(), "high_watermark_after": mine.high_posted_at}
    else:
        report["error"] = {"type": "QualityGateError", "message": "a quality check failed in strict mode"}
    files.write_json(spark, f"{home}/report.json", report)
    return report


def sync_boards(spark: SparkSession, pulls: list[Pull], folder: str, at: str, fail_fast: bool = False, **options) -> dict:
    """Several pulls, one after the other, each its own group of jobs; a pull is done when all it writes is there.

    An error of a pull, in its plan or in a row, stays with its board: the report has it, and the others go on (unless ``fail_fast``).
    Returns, and writes to ``folder``, a report with a pull's report each, and totals; completeness is weighed by rows written, or else by what was normalized.
    """
    reports = []
    for pull in pulls:
        spark.sparkContext.setJobGroup(f"sync-{pull.source}-{pull.source_ref}", f"pull of {pull.source} {pull.source_ref}")
        try:
            reports.append(sync_board(spark, pull, folder, at, **options))
        except Exception as e:
            nothing = {"rows_written": 0, "fetched_count": 0, "request_count": 0, "quality_status": "fail", "quality_summary": {"pass": 0, "warn": 0, "fail": 1}, "check_codes": []}
            reports.append({"schema_version": "1.0", "status": "fail", "source": pull.source, "source_ref": pull.source_ref, "at": at, **nothing, "error": {"type": type(e).__name__, "message": str(e)[:2000]}})
            if fail_fast:
                break
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            spark.sparkContext.setLocalProperty("spark.job.description", None)
    failed = sum("normalized_count" not in r for r in reports)
    weights = [(r["rows_written"] or r["normalized_count"], r["key_field_completeness"]) for r in reports if "key_field_completeness" in r]
    total = sum(w for w, _ in weights)
    names = sorted({n for w, c in weights if w for n in c})
    out = {
        "schema_version": "1.0", "status": "fail" if failed else "pass", "at": at, "total_sources": len(pulls), "pass_count": len(reports) - failed, "fail_count": failed,
        **{f"total_{n}": sum(r[n] for r in reports) for n in ("rows_written", "fetched_count", "request_count")},
        "quality_summary": {s: sum((r["quality_status"] == s) for r in reports) for s in ("pass", "warn", "fail")},
        "key_field_completeness": {n: round(sum(w * c.get(n, 0.0) for w, c in weights) / total, 3) for n in names} if total else {},
        "check_codes": sorted({c for r in reports for c in r["check_codes"]}), "sources": reports,
    }
    files.write_json(spark, f"{folder}/report.json", out)
    return out
