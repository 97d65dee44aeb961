"""What the composites do with empty frames, odd rows and wrong configurations."""

from functools import partial

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.functions import text
from postlark.operators import contract, eda, guards, inference, ingest, matching, plugins, profile, publish, run
from postlark.plans.jobs import jobs
from postlark.plans.records import AT

SF = "/root/testdata/sf0.001"
NOW = "2026-01-15 00:00:00"


def test_empty_frames(spark):
    none = jobs(spark, SF).limit(0)
    some = jobs(spark, SF)
    assert {r.null_pct for r in profile.null_percentages(none).collect()} == {0.0}
    assert profile.null_diff(none, some).count() == len(some.columns)
    assert profile.stability_index(none, some, "salary_min").first().psi is None and profile.stability_index(some, none, "salary_min").first().psi is None
    assert profile.jensen_shannon(none, some, "location").first().jsd is None and eda.drift(none, some).count() == 0
    assert profile.quality_score(none).first().score_percent == 100.0
    assert {r.status for r in ingest.quality_checks(none.withColumn("source_ref", F.lit("x")), NOW).where("n = 1").collect()} == {"fail"}
    assert ingest.key_completeness(none).first().company_non_null_pct == 0.0 and matching.index_summary(none).first().row_count == 0
    assert [r.title for r in eda.findings(none, none).collect()] == ["Low posted_at coverage"]


def test_deciles_of_skewed_values(spark):
    """One far value doesn't put all others into one range, and ties keep their ranks."""
    rows = [(float(k % 37),) for k in range(2000)] + [(1e15,)]
    got = [r.value for r in profile.deciles(spark.createDataFrame(rows, "v double"), ["v"]).orderBy("quantile").collect()]
    ordered = sorted(v for v, in rows)
    assert got == [ordered[int(q / 10 * 2000 + 0.5)] for q in range(11)]


def test_matching_of_odd_jobs(spark):
    rows = [("1", "C", None, None), ("2", None, ["C++", " Machine Learning "], "Full Time"), ("3", "c plus", ["r"], "full-time")]
    df = spark.createDataFrame(rows, "id string, title string, skills array<string>, employment_type string").withColumns({c: F.lit(None).cast("string") for c in ("company", "location", "description_text", "description_html", "posted_at", "apply_url", "source", "remote")}).withColumns({c: F.lit(None).cast("double") for c in ("salary_min", "salary_max")})
    wish = matching.Candidate(skills=("c++", "machine learning"), titles=("C", "D"))
    index = matching.index_jobs(df)
    assert {r.job_id: r.employment_type for r in index.collect()} == {"1": "unknown", "2": "unknown", "3": "full_time"}
    found = {r.job_id: r for r in matching.scored(index, wish, NOW).collect()}
    assert found["1"].signal_title == 0.0 and found["2"].signal_skills == 1.0 and found["2"].required_missing_skills == [] and found["3"].required_missing_skills == ["c++", "machine learning"]
    live, features = publish.job_features(df)
    assert publish.ranked_jobs(live, features, matching.Candidate(), NOW).count() == 3
    assert publish.candidate_from_json('{"salary_targets": {"minimum": "lots"}}', '{"weights": {"skills": -1}, "reason_limit": 0}') == (matching.Candidate(), matching.Policy({**matching.WEIGHTS, "skills": 0.0}, 1))


def test_blocks_of_the_index(spark):
    index = spark.range(500).select(F.col("id").cast("string").alias("job_id"), F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id"))).alias("tokens"))
    rows = matching.postings(index, block=64).collect()
    the = [r for r in rows if r.token == "the"]
    assert len(the) > 4 and max(len(r.job_ids) for r in the) < 128 and sorted(j for r in the for j in r.job_ids) == sorted(map(str, range(500)))
    assert len(rows) == 500 + len(the)


def test_profile_cache(spark):
    cache = spark.createDataFrame([("a", "1", "2026-02-01 00:00:00"), ("b", "2", "2026-01-01 00:00:00"), ("c", "3", "2026-02-01 00:00:00")], "profile_id string, payload string, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    out = publish.cached_profiles(cache, spark.createDataFrame([("a", "9")], "profile_id string, payload string"), NOW, 30)
    assert sorted((r.profile_id, r.payload) for r in out.collect()) == [("a", "9"), ("c", "3")]


def test_ingest_of_what_is_no_record(spark):
    raw = spark.createDataFrame([("[1]",), ("not json",), (None,), ("{}",)], "raw string")
    for source in (*ingest.SOURCES, "other"):
        rows = ingest.normalized(raw, source, "ref", AT).collect()
        assert len(rows) == 4 and {(r.id, r.company, r.work_mode, r.remote, r.posted_at) for r in rows} == {(None, "ref", "unknown", None, None)}
    assert [r[0] for r in spark.createDataFrame([("2026-01-02",), ("2026-01-02T03:04:05.5+02:00",), ("2026-1-2",), (None,)], "c string").select(text.iso_utc(F.col("c"))).collect()] == ["2026-01-02T00:00:00+00:00", "2026-01-02T01:04:05.500000+00:00", None, None]


def good(df: DataFrame, context: plugins.Context) -> DataFrame:
    return df


def bare(df, context):
    return df


def broken(df: DataFrame, context: plugins.Context) -> DataFrame:
    return df.drop("title")


def test_plugins(spark):
    item = {"name": "x", "kind": "label", "callable": good}
    for wrong in ([item, item], [item | {"kind": "sort"}], [item | {"callable": bare}], [item | {"callable": "no.such:thing"}], [item | {"callable": "nothing"}], [item | {"color": 1}], [item | {"callable": partial(good)}]):
        with pytest.raises(plugins.PluginError):
            plugins.load(wrong)
    loaded = plugins.load([item | {"name": "b", "order": 2}, item | {"name": "a", "order": 2}, item | {"name": "c", "order": 1}, item | {"kind": "filter", "settings": {"a": [1, {"b": 2}]}}])
    assert [p.name for p in loaded] == ["x", "c", "a", "b"] and loaded[0].settings["a"][1]["b"] == 2
    with pytest.raises(TypeError):
        loaded[0].settings["a"] = 1
    df = contract.conform(jobs(spark, SF))
    with pytest.raises(plugins.PluginError, match="title"):
        plugins.apply(df, plugins.load([item | {"callable": broken}]), "label")
    assert plugins.apply(df, plugins.load([item]), "label").columns == df.columns


def test_runs(spark):
    done = run.run(jobs(spark, SF), run.Config(filter={"remote_only": True}, top_k=7))
    assert done.scored.count() == 7 and done.applications.columns[0] == "fit_rank"
    for wrong in (run.Config(top_k=0), run.Config(stages=("clean", "sort"))):
        with pytest.raises(ValueError):
            run.run(jobs(spark, SF), wrong)
    with pytest.raises(ValueError):
        run.run(spark.range(3))
    all_tables = eda.tables(jobs(spark, SF), jobs(spark, SF), 3)
    assert len(all_tables) == 9 and all_tables["top_values_source"].count() == 3
    assert set(eda.diff((jobs(spark, SF),) * 2, (jobs(spark, SF),) * 2)) == {"diff_null_percentages", "diff_source_profile", "drift_metrics", "findings_delta"}


def test_guards_and_inference(spark):
    assert guards.read_only(" select 1 ") == "select 1"
    for wrong in ("", "drop table x", "select 1; select 2", "with a as (select 1) delete from b", "/* select */ insert into x", "explain select 1"):
        with pytest.raises(ValueError):
            guards.read_only(wrong)
    with pytest.raises(ValueError):
        guards.table_name("a-b")
    raw = spark.createDataFrame([("1,200", "yes", "2026-01-02", [1])], "min_salary string, wfh string, created_at string, odd array<int>")
    fields, missing = inference.inferred(raw)
    assert fields["salary_min"].sources[0] == "min_salary" and fields["remote"].sources == ("wfh",) and "title" in missing
    assert 'cast = "float"' in inference.as_toml(fields) and contract.adapt(raw, fields)[0].first().salary_min == 1200.0
