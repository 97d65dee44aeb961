"""Pulls in a row: order, state, gates, failures that stay with their board; and the order of the input."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from postlark import queries
from postlark.operators import catalog, contract, sync
from postlark.plans.records import AT
from postlark.sources import files, ordinals

STATE = [("lever", "acme", "2026-01-05T00:00:00+00:00", None, "x", True, ["old", "seen"]), ("lever", "blank", None, "2026-01-09", "x", True, []), ("lever", "odd", "soon", None, "x", True, ["seen"])]
RECORDS = "source string, source_ref string, source_job_id string, posted_at string, source_updated_at string, ordinal long, source_payload_hash string"


def records(spark, rows):
    return spark.createDataFrame([(*r, n, f"h{n}") for n, r in enumerate(rows)], RECORDS)


def test_state_rules_out_what_was_seen(spark):
    state = spark.createDataFrame(STATE, sync.STATE)
    rows = [("lever", "acme", "seen", "2026-01-20", None), ("lever", "acme", " seen ", None, None), ("lever", "acme", "a", "2026-01-05", None), ("lever", "acme", "b", "2026-01-01", "2026-01-06"), ("lever", "acme", "c", "soon", None), ("lever", "acme", None, "2026-01-06", None), ("lever", "blank", "d", "2026-01-01", None), ("lever", "odd", "e", "2026-01-01", None), ("ashby", "acme", "seen", "2020-01-01", None)]
    assert [r.ordinal for r in sync.unseen(records(spark, rows), state).orderBy("ordinal").collect()] == [3, 4, 5, 6, 7, 8]
    assert sync.unseen(records(spark, rows), state.limit(0)).count() == len(rows)


def test_state_after_a_pull(spark, monkeypatch):
    monkeypatch.setattr(sync, "REMEMBERED", 4)
    state = spark.createDataFrame(STATE, sync.STATE)
    came = records(spark, [("lever", "acme", "n1", "2026-01-04", "2026-02-01T05:00:00+05:00"), ("lever", "acme", None, "soon", None), ("lever", "acme", "n2", None, None), ("lever", "acme", "n1", None, None)]).repartition(3)
    runs = spark.createDataFrame([("lever", "acme", "t", False), ("new", "b", "t", True), ("lever", "odd", "t", True)], "source string, source_ref string, at string, complete boolean")
    after = {(r.source, r.source_ref): r for r in sync.state_after(state, came, runs).collect()}
    assert tuple(after["lever", "acme"])[2:] == ("2026-01-05T00:00:00+00:00", "2026-02-01T00:00:00+00:00", "t", False, ["seen", "n1", "n2", "n1"])
    assert tuple(after["new", "b"])[2:] == (None, None, "t", True, []) and after["lever", "odd"].high_posted_at == "soon"
    assert after["lever", "blank"].last_success_at_utc == "x" and len(after) == 4


def board(spark, rows):
    return spark.createDataFrame([(n, json.dumps({"id": i, "title": t, "absolute_url": u, "updated_at": d, "company_name": "C", "content": "text", "location": {"name": "Oslo"}})) for n, (i, t, u, d) in enumerate(rows)], "ordinal long, raw string")


ROWS = [("1", "A", "https://x/j?gh_jid=1&utm=a", "2026-01-02T00:00:00+00:00"), ("1", "A later", "https://x/j?utm=b&gh_jid=1", "2026-01-02T00:00:00+00:00"), ("2", "B", "https://x/j?gh_jid=2", "2026-01-03T00:00:00+00:00")]


def test_filter_comes_before_dedup(spark):
    """Of two records of one posting, one old, the one above the watermark stays, whatever their hashes and order."""
    state = spark.createDataFrame([("greenhouse", "acme", "2026-01-02T12:00:00+00:00", None, "x", True, ["9"])], sync.STATE)
    none = spark.createDataFrame([], sync.CATALOG)
    rows = [("1", "old", "https://x/1", "2026-01-01T00:00:00+00:00"), ("1", "new", "https://x/1", "2026-01-03T00:00:00+00:00")]
    for order in (rows, rows[::-1]):
        done = sync.synced(sync.Pull("greenhouse", "acme", board(spark, order)), none, state, AT)
        assert [r.title for r in done.records.collect()] == ["new"] and done.completeness.first().rows == 1


def test_pulls_in_a_row(spark, tmp_path):
    folder = f"file://{tmp_path}"
    pull = sync.Pull("greenhouse", "acme", board(spark, ROWS), requests=2, max_pages=2)
    first = sync.sync_board(spark, pull, folder, "2026-01-14T00:00:00+00:00")
    assert (first["status"], first["normalized_count"], first["dedup_dropped"], first["new_count"], first["rows_written"], first["coverage_complete"]) == ("pass", 3, 1, 2, 2, False)
    assert "INGEST_TRUNCATED" in first["check_codes"] and first["high_watermark_after"] == "2026-01-03T00:00:00+00:00"
    latest = files.read_catalog(spark, f"{folder}/greenhouse/acme/latest", "id string, title string, remote boolean, posted_at string")
    assert [(r.id, r.title) for r in latest.collect()] == [("1", "A"), ("2", "B")]  # the first one that arrived, in key order
    second = sync.sync_board(spark, pull, folder, AT)
    assert (second["skipped_by_state"], second["new_count"], second["unchanged_count"], second["rows_written"]) == (3, 0, 0, 2)
    third = sync.sync_board(spark, pull, folder, AT, full_refresh=True)
    assert (third["skipped_by_state"], third["unchanged_count"], third["rows_written"]) == (0, 2, 2)
    assert files.read_json(spark, f"{folder}/greenhouse/acme/report.json")["unchanged_count"] == 2


def test_strict_gate_keeps_everything_as_it_was(spark, tmp_path):
    folder = f"file://{tmp_path}"
    bad = sync.Pull("greenhouse", "acme", board(spark, [("1", None, "https://x/1", "2026-01-02T00:00:00+00:00")]))
    report = sync.sync_board(spark, bad, folder, AT, strict=True)
    assert report["status"] == "fail" and report["rows_written"] == 0 and report["error"]["type"] == "QualityGateError" and "INGEST_QUALITY_NULL_RATE_TITLE" in report["check_codes"]
    assert files.read_catalog(spark, f"{folder}/state", sync.STATE).count() == 0 and files.read_catalog(spark, f"{folder}/greenhouse/acme/catalog", sync.CATALOG).count() == 0
    assert sync.sync_board(spark, bad, folder, AT)["status"] == "pass"


def test_a_board_whose_rows_fail(spark, tmp_path):
    """The error shows only when rows are computed; the board is listed as failed, the others are written."""
    folder = f"file://{tmp_path}"
    good = sync.Pull("greenhouse", "acme", board(spark, ROWS))
    broken = sync.Pull("lever", "acme", spark.range(3).select(F.raise_error(F.lit("row is broken")).cast("string").alias("raw"), F.col("id").alias("ordinal")))
    out = sync.sync_boards(spark, [broken, good], folder, AT)
    assert (out["status"], out["pass_count"], out["fail_count"], out["total_sources"], out["total_rows_written"], out["total_fetched_count"]) == ("fail", 1, 1, 2, 2, 3)
    assert [r["status"] for r in out["sources"]] == ["fail", "pass"] and "row is broken" in out["sources"][0]["error"]["message"]
    assert out["quality_summary"]["fail"] >= 1 and out["key_field_completeness"]["company_non_null_pct"] == 100.0
    assert len(sync.sync_boards(spark, [broken, good], folder, AT, fail_fast=True)["sources"]) == 1


def test_coverage():
    whole = sync.Pull("lever", "acme", None)
    assert not whole.complete() and whole.complete(10) and not whole.complete(5000)  # nobody counted: not whole
    assert sync.Pull("lever", "acme", None, page_repeated=True).warnings(3) == ["INGEST_PAGE_REPEAT_DETECTED", "INGEST_TRUNCATED"]
    assert sync.Pull("lever", "acme", None, requests=25).warnings(3) == ["INGEST_TRUNCATED"] and whole.warnings(3) == []


def test_whole_pull_of_a_large_board(spark, tmp_path):
    """A whole pull of more records than the usual limit still says what is gone from the board."""
    assert sync.Pull("lever", "acme", None, max_jobs=None).complete(5000) and not sync.Pull("lever", "acme", None, max_jobs=None).complete()
    spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.is_active, r.change): r["count"] for r in queries.QUERIES["ingest_sync"](spark, str(tmp_path)).groupBy("is_active", "change").count().collect()}
    assert got == {(True, "unchanged"): 1800, (True, "updated"): 1800, (True, "new"): 1800, (False, "tombstoned"): 400}


def test_skipped_records_can_stay_active(spark):
    none = spark.createDataFrame([], sync.STATE)
    pull = sync.Pull("greenhouse", "acme", board(spark, ROWS))
    one = sync.synced(pull, spark.createDataFrame([], sync.CATALOG), none, AT)
    known, state = one.catalog.drop("change").cache(), one.state.cache()
    assert {r.change for r in sync.synced(pull, known, state, AT).catalog.collect()} == {"tombstoned"}
    stay = sync.synced(pull, known, state, AT, skipped_stay=True).catalog.collect()
    assert {(r.change, r.is_active) for r in stay} == {("kept", True)}


def test_two_writers_of_a_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    assert files.write_catalog(spark.range(2), path) == 1
    before = files._pointers(spark, path)
    files.write_catalog(spark.range(3), path)
    with monkeypatch.context() as m:
        m.setattr(files, "_pointers", lambda *_: before)  # a writer that began from the version before
        with pytest.raises(RuntimeError, match="meanwhile"):
            files.write_catalog(spark.range(9), path)
    assert files.read_catalog(spark, path, "id long").count() == 3
    (tmp_path / "t/version-dead").mkdir()
    monkeypatch.setattr(files, "ABANDONED_MS", -1)
    files.write_catalog(files.read_catalog(spark, path, "id long").where("id > 0"), path)
    assert not (tmp_path / "t/version-dead").exists() and files.read_catalog(spark, path, "id long").count() == 2


@pytest.mark.parametrize("size", ["700b", "128m"])
def test_ordinals_follow_the_files(spark, tmp_path, size):
    """Numbers are the same however the files are dealt to tasks; first of a key, heads and samples follow them."""
    draw = random.Random(1)
    lines = [f"{draw.randrange(50)},{'x' * draw.randrange(60)},{n}" for n in range(600)]
    for part in range(3):
        (tmp_path / f"part-{part}.txt").write_text("\n".join(lines[200 * part : 200 * part + 200]) + "\n")
        spark.createDataFrame([(200 * part + n,) for n in range(200)], "n long").coalesce(1).write.parquet(f"{tmp_path}/p/{part}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = ordinals.lines_in_order(spark, f"{tmp_path}/part-*.txt").collect()
        assert sorted((r.ordinal, r.value) for r in got) == list(enumerate(lines))
        rows = ordinals.parquet_in_order(spark, *[f"{tmp_path}/p/{k}" for k in range(3)]).collect()
        assert sorted((r.ordinal, r.n) for r in rows) == [(n, n) for n in range(600)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    table = spark.createDataFrame([(r.ordinal, *r.value.split(",")) for r in got], "ordinal long, k string, x string, n string")
    first = {r.k: int(r.n) for r in catalog.keep_first(table, "k", "ordinal").collect()}
    assert first == {k: min(n for n, t in enumerate(lines) if t.split(",")[0] == k) for k in first} and len(first) == 50
    assert sorted(int(r.n) for r in ordinals.first_rows(table, 7).collect()) == list(range(7))


def test_rows_of_one_file_stay_in_many_tasks(spark, tmp_path):
    """Numbering doesn't bring the rows of a file together in one task."""
    pq.write_table(pa.table({"n": list(range(8000))}), f"{tmp_path}/one.parquet", row_group_size=1000)
    changed = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        rows = ordinals.parquet_in_order(spark, f"{tmp_path}/one.parquet").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in changed:
            spark.conf.unset(k)
    assert all(r.ordinal == r.n for r in rows) and len(rows) == 8000 and len({r.task for r in rows}) > 3


def test_dates_by_format(spark):
    values = ["2026-1-5", "05/1/2026", "2026-01-05T7:08:09", "2026-01-05 07:8:9", "5.1.2026", "31/02/2026", "2026-01-5x", "026-01-05", "005/01/2026", " ", "N/A", None]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    out, errors = contract.adapt(df, {"posted_at": contract.Field(("d",), "date_string")})
    assert [r.posted_at for r in out.collect()] == ["2026-01-05", "05/01/2026", "2026-01-05T07:08:09", "2026-01-05 07:08:09", *[None] * 8]
    assert errors.first().posted_at_errors == 5
