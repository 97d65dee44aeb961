"""Streams read from files until nothing is left, against the same rows in one batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from postlark.operators import matching
from postlark.sources.files import read_catalog
from postlark.streaming import feedback, records

CATALOG = "stable_key string, first_seen_at_utc string, last_seen_at_utc string, is_active boolean, last_payload_hash string, latest_posted_at string, latest_updated_at string, latest_record_json string"


def rows_of(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    events = spark.range(600).select((F.col("id") % 200).alias("source_job_id"), (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 3).alias("kind"))
    for n in range(3):
        events.where(f"source_job_id >= 0 and cast(unix_timestamp(ts) / 60 as long) % 3 = {n}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    seen = rows_of(records.first_seen(stream, "ts", delay="30 days"), tmp_path, "seen")
    assert sorted(r.source_job_id for r in seen) == list(range(200))
    counts = rows_of(records.counts_over_time(stream, "ts", "kind", delay="30 days"), tmp_path, "counts")
    assert counts == []  # within the delay every window may still change
    one = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    done = rows_of(records.counts_over_time(one, "ts", "kind", delay="0 seconds"), tmp_path, "done")
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "kind").count().where("w.end <= timestamp '2026-01-01 09:59:00'").collect()
    assert {(r.start, r.kind, r["count"]) for r in done} == {(r.w.start, r.kind, r["count"]) for r in want}


def test_merge_of_batches(spark, tmp_path):
    for n, (key, h) in enumerate((("a", "1"), ("b", "1"), ("a", "2"))):
        spark.createDataFrame([(key, h, f"2026-01-0{n + 1}", None, "{}")], "stable_key string, payload_hash string, posted_at string, updated_at string, record_json string").write.json(f"{tmp_path}/j/{n}")
    stream = spark.readStream.schema("stable_key string, payload_hash string, posted_at string, updated_at string, record_json string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/j")
    path = f"file://{tmp_path}/catalog"
    records.merged_into_catalog(stream, path, CATALOG, "2026-01-15", f"file://{tmp_path}/cp").awaitTermination(120)
    assert sorted((r.stable_key, r.last_payload_hash, r.is_active) for r in read_catalog(spark, path, CATALOG).collect()) == [("a", "2", True), ("b", "1", True)]


def folded(spark, tmp_path, events, batches, name, **options):
    """The rows that a stream of weights gives when events come in the given batches."""
    schema = "profile_id string, recorded_at timestamp, event_id string, event string"
    for n, rows in enumerate(batches):
        spark.createDataFrame([events[k] for k in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in-{name}/{n:03d}")
    read = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in-{name}")
    for k, v in feedback.STATE_STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        return rows_of(feedback.weights_over_time(read, **options), tmp_path, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        for k in feedback.STATE_STORE:
            spark.conf.unset(k)


def test_weights_equal_one_fold_after_any_cut(spark, tmp_path):
    draw = random.Random(3)
    start = dt.datetime(2026, 1, 1)
    kinds = ["not_relevant", "applied", "interviewed", "interviewed", "other"]
    events = [(f"p{draw.randrange(3)}", start + dt.timedelta(seconds=37 * n), f"e{n}", draw.choice(kinds)) for n in range(150)]
    end = ("p9", start + dt.timedelta(days=30), "end", "applied")  # moves the watermark past all others
    known = spark.createDataFrame(events, "profile_id string, recorded_at timestamp, event_id string, event string")
    want = {(r.profile_id, r.signal): round(r.weight, 9) for r in matching.feedback_weights(known).collect()}
    order = list(range(150))
    jumbled = [k for b in range(0, 150, 10) for k in draw.sample(order[b : b + 10], 10)]  # within the delay
    cuts = {"one": [jumbled], "some": [jumbled[:23], jumbled[23:25], jumbled[25:110], jumbled[110:] + jumbled[140:]]}
    for name, batches in cuts.items():
        rows = folded(spark, tmp_path, [*events, end], [*batches, [150], [150]], name)
        last = {}
        for r in rows:
            at, w = last.get((r.profile_id, r.signal), (None, None))
            if at is None or r.through >= at:
                last[r.profile_id, r.signal] = (r.through, r.weight)
        assert {k: round(w, 9) for k, (_, w) in last.items() if k[0] != "p9"} == want, name


def test_weights_expire(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    events = [("a", start, "1", "applied"), ("b", start + dt.timedelta(days=9), "2", "applied"), ("c", start + dt.timedelta(days=40), "3", "applied"), ("a", start + dt.timedelta(days=41), "4", "interviewed"), ("c", start + dt.timedelta(days=90), "5", "applied")]
    rows = folded(spark, tmp_path, events, [[0], [1], [2], [3], [4], [4], [4]], "expiry", delay="1 day", expire_days=20)
    skills = sorted((r.profile_id, r.through, round(r.weight, 4), r.expired) for r in rows if r.signal == "skills")
    at = [e[1] for e in events]
    assert [x for x in skills if x[0] == "a"] == [("a", at[0], 1.0, True), ("a", at[0], 1.03, False), ("a", at[3], 1.0, True), ("a", at[3], 1.08, False)]
