"""The job-posting operators: every query against its SQL, and hand-made rows for nulls and odd values."""

import glob
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from postlark.functions import text
from postlark.operators import catalog, contract, matching, profile, stages
from postlark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(f"{float(v):.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(plain, got.select(*names).collect()))) == sorted(map(repr, map(plain, rows)))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def one(spark, values, kind, expression):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return [r[0] for r in df.select(expression(F.col("c"))).collect()]


def test_text_functions(spark):
    assert one(spark, ["  a\t", None], "string", text.strip) == ["a", None]
    assert one(spark, ["140,000", "10d", "1e3", "", None], "string", text.number) == [140000.0, None, 1000.0, None, None]
    assert one(spark, [float("nan"), float("inf"), 2.0, -1.0, None], "double", text.clipped) == [0.0, 0.0, 1.0, 0.0, 0.0]
    assert [v is not None for v in one(spark, ["2026", "2026-01-02", "2026-01-02T03:04:05Z", "x"], "string", text.timestamp)] == [False, True, True, False]
    assert one(spark, ["https://A.b/c/?x=1#f", "plain/", None], "string", text.url_key) == ["https://a.b/c", "plain/", None]


def test_stages_on_odd_rows(spark):
    rows = [("1", None, None, None, None), ("2", " ", "A", "text", "<b></b>"), ("3", "Intern", None, " x ", "<p>html</p>"), ("4", "International Sales", "B", None, None)]
    df = contract.conform(spark.createDataFrame(rows, "id string, title string, company string, description_text string, description_html string"))
    out = {r.id: r for r in stages.rate(stages.label(stages.clean(df))).collect()}
    assert set(out) == {"3", "4"} and out["3"].description_text == "html" and out["4"].label_seniority == "junior" and out["4"].rate_quality == 0.0
    assert stages.match(stages.rate(stages.clean(df)), top_k=1).first().fit_rank == 1 and df.schema["remote"].dataType.simpleString() == "boolean"


def test_merge_drops_blank_keys_and_prunes(spark):
    cols = "stable_key string, first_seen_at_utc string, last_seen_at_utc string, is_active boolean, last_payload_hash string, latest_posted_at string, latest_updated_at string, latest_record_json string"
    old = spark.createDataFrame([("a", "2025-01-01", "2025-01-01", True, "h1", None, "2025-01-01", "{}"), ("b", "2024-01-01", "2024-01-01", False, "h", None, None, "{}"), ("c", "2025-12-01", "2025-12-01", True, "h", None, None, "{}"), (" ", "x", "x", True, "h", None, None, "{}")], cols)
    new = spark.createDataFrame([("a", "h2", None, "2026-01-01", "{1}")], "stable_key string, payload_hash string, posted_at string, updated_at string, record_json string")
    out = {r.stable_key: (r.is_active, r.change) for r in catalog.merge(old, new, "2026-01-15", True).collect()}
    assert out == {"a": (True, "updated"), "c": (False, "tombstoned")}


def test_feedback_order_matters(spark):
    rows = [("p", k, k, e) for k, e in enumerate(["interviewed"] * 8 + ["not_relevant"])]
    out = {r.signal: r.weight for r in matching.feedback_weights(spark.createDataFrame(rows, "profile_id string, recorded_at long, event_id long, event string")).collect()}
    assert abs(out["skills"] - 1.5 * 0.95) < 1e-12 and abs(out["recency"] - 1.0) < 1e-12


def test_feedback_of_a_hot_profile_is_split(spark):
    """Most events are one profile's: they go to many tasks, and the maps of these give the same weights as one by one."""
    rng = random.Random(4)
    kinds = [*matching.FACTORS, "seen", None]
    rows = [(p, None if rng.random() < 0.01 else rng.randrange(5000), k, rng.choice(kinds)) for k in range(30_000) for p in ["hot" if k % 20 else rng.choice(["a", "b", None, "z"])]]
    want = defaultdict(lambda: [1.0] * len(matching.WEIGHTS))
    for p, _, _, e in sorted((r for r in rows if r[3] in matching.FACTORS), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[p] = [max(matching.LOWEST, min(matching.HIGHEST, w * f)) for w, f in zip(want[p], matching.FACTORS[e], strict=True)]
    events = spark.createDataFrame(rows, "profile_id string, recorded_at long, event_id long, event string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = Counter(r.profile_id for r in matching.feedback_maps(events).collect())
        out = {(r.profile_id, r.signal): r.weight for r in matching.feedback_weights(events).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 4 <= pieces["hot"] <= 8 and set(pieces) == set(want)
    assert out.keys() == {(p, s) for p in want for s in matching.WEIGHTS}
    assert all(abs(out[p, s] - v) < 1e-9 for p, w in want.items() for s, v in zip(matching.WEIGHTS, w, strict=True))


def test_feedback_maps_neither_overflow_nor_vanish(spark):
    """Thousands of equal events: their product alone would run over or under."""
    rows = [(e, k, k, e) for e in matching.FACTORS for k in range(30_000)]
    out = {(r.profile_id, r.signal): r.weight for r in matching.feedback_weights(spark.createDataFrame(rows, "profile_id string, recorded_at long, event_id long, event string")).collect()}
    assert out["interviewed", "skills"] == 1.5 and out["not_relevant", "skills"] == 0.5 and out["applied", "recency"] == 1.0


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "title string, company string, posted_at string, source string, x double")
    assert profile.quality_score(empty).first().score_percent == 100.0 and profile.deciles(empty, ["x"]).count() == 0
    with pytest.raises(ValueError):
        contract.check(empty)
