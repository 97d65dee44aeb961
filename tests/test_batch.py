"""Many candidates at once give what each gives alone."""

import random

import pytest
from pyspark.sql import functions as F

from postlark.operators import batch, matching

NOW = "2026-01-15 00:00:00"
JOBS = "id string, title string, company string, location string, remote boolean, description_text string, description_html string, skills array<string>, salary_min double, salary_max double, apply_url string, posted_at string, employment_type string, score double, candidate long"
WISHES = "profile_id string, skills array<string>, titles array<string>, locations array<string>, work_modes array<string>, seniority array<string>, employment array<string>, salary_minimum double, requires_sponsorship boolean, authorized_locations array<string>"


def offers(spark, n=250, seed=1):
    draw = random.Random(seed)
    words = ["python", "sql", "java", "rust", "go", "no sponsorship", "aws"]
    rows = []
    for i in range(n):
        day = None if draw.random() < 0.1 else f"202{draw.choice('3455555')}-{draw.randrange(1, 13):02d}-{draw.randrange(1, 29):02d}"
        pay = draw.choice([None, 10.0, 50.0, 90.0])
        rows.append((f"j{i:04d}", draw.choice(["Senior Data Engineer", "Data Analyst", "Go", "Staff ML engineer", "", None]), draw.choice(["Acme", None]), draw.choice(["Berlin", "Remote", "berlin, de", "Oslo", None]), draw.choice([True, False, None]), " ".join(draw.sample(words, draw.randrange(4))), None, draw.choice([None, [], ["Machine Learning"]]), pay, None, "u", day, draw.choice([None, "full-time", "contract"]), 0.5, 7))
    return matching.index_jobs(spark.createDataFrame(rows, JOBS))


def wishes(n=16, seed=2):
    draw = random.Random(seed)
    some = lambda *of: tuple(draw.sample(of, draw.choice([0, 1, min(3, len(of))])))
    return [matching.Candidate(some("python", "sql", "rust", "machine learning", "berlin", "haskell"), some("data engineer", "ML", "x"), some("berlin", "oslo", "remote", "mars"), some("remote", "onsite", "unknown"), some("senior", "mid", "staff"), some("full_time", "contract", "unknown"), draw.choice([None, 0.0, 50.0, 1000.0]), draw.choice([None, True, False]), some("remote", "berlin"), f"c{i}") for i in range(n)]


@pytest.mark.parametrize("top_k", [7])
def test_batch_equals_each_alone(spark, top_k):
    index, people = offers(spark).cache(), wishes()
    rows = [(c.profile_id, list(c.skills), list(c.titles), list(c.locations), list(c.work_modes), list(c.seniority), list(c.employment), c.salary_minimum, c.requires_sponsorship, list(c.authorized_locations)) for c in people]
    weights = spark.createDataFrame([("c1", "skills", 1.5), ("c1", "recency", 0.5), ("c2", "title", 1.3)], "profile_id string, signal string, weight double")
    found = batch.best_matches(index, spark.createDataFrame(rows, WISHES), NOW, top_k, multipliers=weights).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.profile_id, r["rank"])):
        by.setdefault(r.profile_id, []).append((r.job_id, r.score, [x.code for x in r.match_reasons], r.required_missing_skills, r.quality_flags))
    for c in people:
        own = {"c1": {"skills": 1.5, "recency": 0.5}, "c2": {"title": 1.3}}.get(c.profile_id)
        alone = matching.best_matches(index, c, NOW, top_k, multipliers=own).collect()
        assert by.get(c.profile_id, []) == [(r.job_id, r.score, [x.code for x in r.match_reasons], r.required_missing_skills, r.quality_flags) for r in alone], c


def test_lists_that_cannot_matter_are_not_read(spark):
    """A candidate with one rare skill needs no old job without it."""
    rows = [(f"j{i}", "Clerk", "A", "Oslo", False, "haskell" if i % 100 == 0 else "sql", None, None, None, None, "u", f"20{10 + i % 16}-01-05", None, 0.0, 0) for i in range(1600)]
    index = matching.index_jobs(spark.createDataFrame(rows, JOBS))
    people = spark.createDataFrame([("p", ["haskell"])], "profile_id string, skills array<string>")
    asked = batch._prepared(batch.candidates_of(people), None)
    table = batch.job_table(index, NOW)
    assert batch._tokens_of(asked, matching.WEIGHTS).collect()[0].ahead == pytest.approx(0.35)
    assert {r.key for r in batch._paths_of(asked, table).collect()} == {f"m:{m}" for m in matching.MODES}
    found = batch.best_matches(index, people, NOW, 5).collect()
    assert len(found) == 5 and all(r.score > 0.6 for r in found)


def test_odd_tables(spark):
    index, none = offers(spark, 30), spark.createDataFrame([], WISHES)
    people = spark.createDataFrame([(None, "x"), ("a", "x"), ("a", "x")], "profile_id string, job string")
    assert batch.best_matches(index, none, NOW).count() == 0
    assert batch.best_matches(index.limit(0), people, NOW).count() == 0
    assert batch.best_matches(index, people, NOW, 2).count() == 6
    with pytest.raises(ValueError):
        batch.best_matches(index, people, NOW, 0)
    cases = people.withColumn("relevant", F.when(F.col("profile_id") == "a", F.array(F.lit(" j0001 "), F.lit("j0001"), F.lit(""), F.lit(None))))
    measured = batch.evaluated(index, cases, NOW, (30, 1))
    assert [(r.k, r.recall) for r in measured.orderBy("k").collect()][1] == (30, 1.0)
    assert batch.evaluated(index, cases.where("profile_id is null"), NOW).count() == 0


def test_matching_against_a_written_index(spark, tmp_path):
    index, people = offers(spark, 60), spark.createDataFrame([("a", ["python"]), ("b", ["go", "sql"])], "profile_id string, skills array<string>")
    manifest = batch.write_index(index, NOW, f"file://{tmp_path}/i")
    assert manifest["summary"] == {"now": NOW, "jobs": 60}
    shown = lambda df: sorted((r.profile_id, r["rank"], r.job_id, r.score) for r in df.collect())
    assert shown(batch.matches_of_index(spark, f"file://{tmp_path}/i", people, 5)) == shown(batch.best_matches(index, people, NOW, 5))
    keys = [r.key for r in spark.read.parquet(f"{tmp_path}/i/tables/lists.parquet").collect()]
    assert len(keys) > 100


@pytest.mark.parametrize("recency", [0.0, 0.1])
def test_like_jobs_and_like_candidates(spark, monkeypatch, recency):
    """Of jobs that differ in dates, ids and unasked words only the first ones are paired, with each set of wishes once; the rows stay those of each alone."""
    days = ["2026-01-05", "2026-01-04", None, "2027-05-01", "2025-12-31", "2027-06-01"]
    rows = [(f"j{n:03d}", "Clerk", "A", ["Oslo", "Oslo, NO"][n % 2], False, f"python word{n}", None, None, 50.0 + n, None, "u", days[n % 6], None, 0.0, 0) for n in range(240)]
    index = matching.index_jobs(spark.createDataFrame(rows, JOBS)).cache()
    people = spark.createDataFrame([(f"p{n}", ["python", "sql"][:: 1 - 2 * (n % 2)], ["oslo"], 60.0) for n in range(30)], "profile_id string, skills array<string>, locations array<string>, salary_minimum double")
    policy, sizes = matching.Policy({**matching.WEIGHTS, "recency": recency}), {}
    plain = batch.kept
    monkeypatch.setattr(batch, "kept", lambda df, name: sizes.setdefault(name, []).append(plain(df, name)) or sizes[name][-1])
    found = {}
    for r in batch.best_matches(index, people, NOW, 4, policy).orderBy("profile_id", "rank").collect():
        found.setdefault(r.profile_id, []).append((r.job_id, r.score, r.required_missing_skills))
    alone = matching.best_matches(index, matching.Candidate(("python", "sql"), (), ("oslo",), salary_minimum=60.0), NOW, 4, policy=policy).collect()
    expected = [(r.job_id, r.score, r.required_missing_skills) for r in alone]
    assert found == {f"p{n}": expected for n in range(30)}
    assert sizes["wishes"][0].count() == 1
    assert sizes["leading"][0].count() == 14  # four of each: with a date and without one, paying enough and not (two without a date only)
