"""A catalog of postings kept up to date: dedup, incremental filter, merge with tombstones, checks, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_null, timestamp

POLICIES = ("first_seen", "last_seen", "updated_hash")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``; a grouping with partial results, so a frequent key needs no sort."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("s"))
    return first.select("s.*")


def newer(records: DataFrame, watermark: str | None, seen: DataFrame | None = None, record_id: str = "source_job_id") -> DataFrame:
    """Records whose latest time is above the watermark (or unknown) and whose id wasn't seen lately."""
    when = F.greatest(timestamp(F.col("posted_at")), timestamp(F.col("source_updated_at")))
    out = records if watermark is None else records.where(when.isNull() | (when > F.lit(watermark).cast("timestamp")))
    return out if seen is None else out.join(seen, record_id, "left_anti")


def merge(catalog: DataFrame, records: DataFrame, seen_at: str, complete: bool, policy: str = "updated_hash", prune_days: int = 90) -> DataFrame:
    """The catalog after a run, with ``change``: new, updated, unchanged, tombstoned, kept or (left out of it) pruned.

    One full join by stable_key. records: stable_key, payload_hash, posted_at, updated_at, record_json, one row
    for each key. Blank keys of the catalog go. With complete coverage, active keys that weren't seen become
    inactive; inactive ones last seen over prune_days ago go (never with a negative number).
    """
    if policy not in POLICIES:
        raise ValueError(f"no merge policy {policy!r}")
    old = catalog.where(F.trim("stable_key") != "").withColumn("old", F.lit(True))
    new = records.select("stable_key", *[F.col(c).alias(f"in_{c}") for c in ("payload_hash", "posted_at", "updated_at", "record_json")], F.lit(True).alias("new"))
    both = old.join(new, "stable_key", "full")
    is_old, is_new = F.col("old").isNotNull(), F.col("new").isNotNull()

    def compared(a: str, b: str):
        """1 if what comes in is newer, -1 if what is there is, 0 if they agree or neither is known."""
        x, y = timestamp(F.col(a)), timestamp(F.col(b))
        return F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1).when(y > x, 1).when(y < x, -1).otherwise(0)

    by_update, by_post = compared("latest_updated_at", "in_updated_at"), compared("latest_posted_at", "in_posted_at")
    differs = F.coalesce("last_payload_hash", F.lit("")) != F.coalesce("in_payload_hash", F.lit(""))
    later = F.when(by_update != 0, by_update > 0).when(by_post != 0, by_post > 0).otherwise(F.coalesce("in_payload_hash", F.lit("")) > F.coalesce("last_payload_hash", F.lit("")))
    wins = {"first_seen": F.lit(False), "last_seen": F.lit(True), "updated_hash": later}[policy]
    takes = is_new & (~is_old | (differs & wins))
    active = F.when(is_new, True).when(F.lit(complete), False).otherwise(F.coalesce("is_active", F.lit(False)))
    change = F.when(is_new & ~is_old, "new").when(takes, "updated").when(is_new, "unchanged").when(F.lit(complete) & F.coalesce("is_active", F.lit(False)), "tombstoned").otherwise("kept")
    pick = lambda there, coming: F.when(takes, F.col(coming)).otherwise(F.col(there)).alias(there)
    out = both.select(
        "stable_key",
        F.coalesce("first_seen_at_utc", F.lit(seen_at)).alias("first_seen_at_utc"),
        F.when(is_new, F.lit(seen_at)).otherwise(F.col("last_seen_at_utc")).alias("last_seen_at_utc"),
        active.alias("is_active"),
        pick("last_payload_hash", "in_payload_hash"),
        pick("latest_posted_at", "in_posted_at"),
        pick("latest_updated_at", "in_updated_at"),
        pick("latest_record_json", "in_record_json"),
        change.alias("change"),
    )
    if prune_days < 0:
        return out
    cutoff = F.lit(seen_at).cast("timestamp") - F.make_interval(days=F.lit(prune_days))
    return out.where(F.col("is_active") | F.coalesce(timestamp(F.col("last_seen_at_utc")) >= cutoff, F.lit(True)))


def upsert_counts(target: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """One row: keys to insert, to update, and to deactivate, from one full join of the keys."""
    a, b = target.select(key, F.lit(1).alias("t")), stage.select(key, F.lit(1).alias("s"))
    count = lambda c: F.count_if(c)
    return a.join(b, key, "full").agg(count(F.col("t").isNull()).alias("inserts"), count(F.col("t").isNotNull() & F.col("s").isNotNull()).alias("updates"), count(F.col("s").isNull()).alias("missing"))


def upsert(target: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """All keys of both; the stage's row where there is one."""
    return stage.unionByName(target.join(stage.select(key), key, "left_anti"))


def published(target: DataFrame, stage: DataFrame, key: str, at: str) -> DataFrame:
    """The target after a publication: the stage's rows active, rows of other keys inactive; ``changed_at`` says since when.

    The stage's columns but ``is_active`` and ``changed_at`` are the target's; keys are unique on either side.
    """
    live = upsert(target.drop("is_active", "changed_at"), stage, key)
    state = target.select(key, F.col("is_active").alias("_was"), F.col("changed_at").alias("_since")).join(stage.select(key, F.lit(True).alias("_here")), key, "full")
    here = F.coalesce("_here", F.lit(False))
    since = F.when(F.col("_was").eqNullSafe(here), F.col("_since")).otherwise(F.lit(at))
    return live.join(state, key).withColumns({"is_active": here, "changed_at": since}).drop("_was", "_since", "_here")


def without_orphans(features: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Features whose job is there and active."""
    return features.join(jobs.where("is_active").select(key), key, "left_semi")


def ingest_checks(df: DataFrame, now: str, nulls: tuple[str, ...] = ("title", "company", "posted_at", "apply_url")) -> DataFrame:
    """One row: rows, share missing of key fields, share with a place or a remote flag, share of readable dates, age of the newest in days."""
    n = F.count(F.lit(1))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    when = timestamp(F.col("posted_at"))
    has = text_or_null(F.col("posted_at")).isNotNull()
    age = F.floor((F.lit(now).cast("timestamp").cast("double") - F.max(when).cast("double")) / 86400.0)
    return df.agg(n.alias("rows"), *[share(text_or_null(F.col(c)).isNull()).alias(f"{c}_missing") for c in nulls], share(text_or_null(F.col("location")).isNotNull() | F.coalesce("remote", F.lit(False))).alias("place_share"), (F.count_if(has & when.isNotNull()) / F.nullif(F.count_if(has), F.lit(0))).alias("readable_share"), age.alias("newest_age_days"))
