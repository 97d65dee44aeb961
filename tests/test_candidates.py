"""Candidates as JSON texts: what is read, and what is wrong."""

import json

import pytest

from postlark.operators import batch, candidates, matching, publish


def parsed(spark, *texts):
    rows = [(n, t if t is None or isinstance(t, str) else json.dumps(t), "mine") for n, t in enumerate(texts)]
    out = candidates.parsed_candidates(spark.createDataFrame(rows, "n int, raw string, skills string"))
    return [r for r in sorted(out.collect(), key=lambda r: r.n)]


def errors(row):
    return [(e.field, e.problem) for e in row.errors]


def test_good_candidates(spark):
    whole = {"profile_id": " ME ", "skills": ["SQL", " sql", "", "C++"], "titles": None, "years_experience": "7.5", "locations": [], "work_mode_preferences": ["Remote", "unknown"], "seniority_targets": ["mid"], "salary_targets": {"minimum": 10, "maximum": 1e5, "currency": "usd ", "interval": "Year"}, "visa_work_auth": {"requires_sponsorship": False, "authorized_locations": ["EU"]}, "employment_type_preferences": ["full_time"], "more": {"x": [1, "a"]}}
    a, b = parsed(spark, whole, {"profile_id": "x", "salary_targets": "", "visa_work_auth": None, "skills": ""})
    assert errors(a) == errors(b) == [] and (a.profile_id, a.skills, a.titles, a.years_experience, a.work_modes, a.salary_minimum, a.salary_maximum) == ("me", ["sql", "c++"], [], 7.5, ["remote", "unknown"], 10.0, 100000.0)
    assert (a.salary_currency, a.salary_interval, a.requires_sponsorship, a.authorized_locations, a.employment, a.seniority) == ("USD", "year", False, ["eu"], ["full_time"], ["mid"])
    assert (b.skills, b.salary_minimum, b.requires_sponsorship, b.raw) == ([], None, None, '{"profile_id": "x", "salary_targets": "", "visa_work_auth": null, "skills": ""}')


def test_what_is_wrong(spark):
    rows = parsed(
        spark, None, "", "[1]", "{", {}, {"profile_id": 3}, {"profile_id": " "}, {"profile_id": "a", "skills": {"x": 1}}, {"profile_id": "a", "skills": ["x", None]}, {"profile_id": "a", "titles": ["x", ["y"]]},
        {"profile_id": "a", "years_experience": ""}, {"profile_id": "a", "years_experience": False}, {"profile_id": "a", "salary_targets": 3, "visa_work_auth": [1]}, {"profile_id": "a", "salary_targets": {"currency": 1, "maximum": [1]}},
        {"profile_id": "a", "employment_type_preferences": ["gig", "contract", "Gig ", "aaa"], "seniority_targets": ["boss"]}, {"profile_id": "a", "visa_work_auth": {"requires_sponsorship": "true", "authorized_locations": "EU"}},
    )
    array, entries = "must be an array of strings", "entries must be strings"
    assert [errors(r) for r in rows] == [
        [("", "must be an object")], [("", "must be an object")], [("", "must be an object")], [("", "must be an object")], [("profile_id", "must be a string")], [("profile_id", "must be a string")], [("profile_id", "must be non-empty")],
        [("skills", array)], [("skills", entries)], [("titles", entries)], [("years_experience", "must be numeric")], [("years_experience", "must be numeric")], [("salary_targets", "must be an object"), ("visa_work_auth", "must be an object")],
        [("salary_targets.maximum", "must be numeric"), ("salary_targets.currency", "must be a string")], [("seniority_targets", "contains unsupported values: boss"), ("employment_type_preferences", "contains unsupported values: aaa, gig")],
        [("visa_work_auth.requires_sponsorship", "must be boolean"), ("visa_work_auth.authorized_locations", array)],
    ]
    assert rows[14].employment == [] and rows[8].skills == []


def test_texts_to_matches(spark):
    """Good candidates go straight into matching."""
    jobs = spark.createDataFrame([("j1", "Data Engineer", "Acme", "Oslo", "python", None), ("j2", "Cook", "Acme", "Oslo", "soup", None)], "id string, title string, company string, location string, description_text string, skills array<string>")
    for c in ("description_html", "posted_at", "remote"):
        jobs = jobs.selectExpr("*", f"cast(null as string) as {c}")
    index = matching.index_jobs(jobs.selectExpr("*", "cast(null as double) as salary_min", "cast(null as double) as salary_max"))
    texts = spark.createDataFrame([('{"profile_id": "p", "skills": ["python"]}',), ('{"profile_id": "q", "skills": "python"}',)], "raw string")
    good = candidates.parsed_candidates(texts).where("size(errors) = 0")
    assert [(r.profile_id, r.job_id) for r in batch.best_matches(index, good, "2026-01-15 00:00:00", 1).collect()] == [("p", "j1")]
    with pytest.raises(ValueError):
        publish.candidate_from_json('{"seniority_targets": "senior"}')
