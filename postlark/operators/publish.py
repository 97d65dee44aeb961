"""The published index and its own ranking of jobs for a candidate, a second scorer beside ``matching``.

It differs on purpose: a title counts fully as soon as one token agrees, the place signal follows the
exclusions, excluded jobs may be listed (last, with score 0), and a profile's learned multipliers come from
a table in which they expire.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, text_or_null, tokens
from .matching import HIGHEST, LOWEST, NO_VISA, WEIGHTS, Candidate, Policy, index_jobs, missing_skills, offered, quality_flags, reasons

_NUMBER, _COUNT = re.compile(r"-?[0-9]+(\.[0-9]+)?"), re.compile("[0-9]+")


def job_features(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live jobs, features): two tables by job_id, as they are published."""
    indexed = index_jobs(jobs)
    text = F.lower(F.concat_ws(" ", *[F.coalesce(text_or_null(F.col(c)), F.lit("")) for c in ("title", "description_text", "description_html")]))
    live = indexed.select("job_id", "title", "company", "location", "work_mode", "seniority", "employment_type", "salary_min", "salary_max", "apply_url", F.col("posted").alias("posted_at"), "source", F.lit(True).alias("is_active"))
    features = indexed.select("job_id", F.array_sort(tokens(F.col("title"))).alias("title_tokens"), "skill_tokens", quality_flags("posted").alias("quality_flags"), contains_any(text, list(NO_VISA)).alias("visa_no_sponsorship"))
    return live, features


def candidate_from_json(text: str, policy: str = "{}") -> tuple[Candidate, Policy]:
    """A candidate and a policy from JSON; lists are lower-cased, numbers that don't read as such are left out.

    What should be a list and isn't is an error. See ``candidates`` for many candidates, and for checks of every field.
    """
    raw, more = json.loads(text), json.loads(policy)

    def low(value) -> tuple[str, ...]:
        if value is not None and not isinstance(value, list):
            raise ValueError(f"a list is due, not {value!r}")
        return tuple(str(x).lower() for x in value or ())

    def number(value, default):
        said = str(value) if value is not None and not isinstance(value, bool) else ""
        return float(said) if _NUMBER.fullmatch(said) else default

    visa = raw.get("visa_work_auth") or {}
    sponsor = {"true": True, "false": False}.get(str(visa.get("requires_sponsorship", "")).lower())
    candidate = Candidate(
        skills=low(raw.get("skills")), titles=low(raw.get("titles")), locations=low(raw.get("locations")), work_modes=low(raw.get("work_mode_preferences")),
        seniority=low(raw.get("seniority_targets")), employment=low(raw.get("employment_type_preferences")), salary_minimum=number((raw.get("salary_targets") or {}).get("minimum"), None),
        requires_sponsorship=sponsor, authorized_locations=low(visa.get("authorized_locations")), profile_id=str(raw.get("profile_id") or "").lower(),
    )
    given = more.get("weights") or {}
    limit = str(more.get("reason_limit", ""))
    return candidate, Policy({k: max(0.0, number(given.get(k), w)) for k, w in WEIGHTS.items()}, max(1, int(limit)) if _COUNT.fullmatch(limit) else 3)


def multipliers_of(weights: DataFrame, profile_id: str, now: str) -> DataFrame:
    """One row: a profile's multipliers that haven't expired, clamped; 1 where there is none.

    weights: profile_id, multipliers (map of doubles), expires_at (null: never).
    """
    own = weights.where((F.col("profile_id") == profile_id) & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))))
    return own.agg(*[F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.coalesce(F.max(F.try_element_at("multipliers", F.lit(k))), F.lit(1.0)))).alias(f"m_{k}") for k in WEIGHTS])


def _exclusions(c: Candidate) -> Column:
    place, places = F.lower(F.coalesce("location", F.lit(""))), c.places()
    inside = contains_any(place, [p for p in places if p]) | (F.coalesce(F.col("work_mode") == "remote", F.lit(False)) & F.lit("remote" in places))
    paid = F.coalesce(offered() >= F.lit(c.salary_minimum or 0.0), F.lit(c.salary_minimum is not None and c.salary_minimum <= -1e18))
    fails = {
        "FILTER_LOCATION": ~inside if places else None,
        "FILTER_WORK_MODE": ~F.lower(F.coalesce("work_mode", F.lit("unknown"))).isin(*c.work_modes) if c.work_modes else None,
        "FILTER_EMPLOYMENT_TYPE": ~F.lower(F.coalesce("employment_type", F.lit("unknown"))).isin(*c.employment) if c.employment else None,
        "FILTER_SALARY": ~paid if c.salary_minimum is not None else None,
        "FILTER_VISA": F.coalesce("visa_no_sponsorship", F.lit(False)) if c.requires_sponsorship else None,
    }
    asked = [F.when(f, code) for code, f in fails.items() if f is not None]
    return F.array_compact(F.array(*asked)) if asked else F.array().cast("array<string>")


def _signals(c: Candidate, now: str) -> dict[str, Column]:
    have = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    out, pay, half = F.col("exclude_reasons"), c.salary_minimum, F.lit(0.5)
    asked = sorted({t for title in c.titles for t in re.sub("[^a-z0-9 ]", " ", title).split()})
    both = F.array_contains(out, "FILTER_LOCATION") & F.array_contains(out, "FILTER_WORK_MODE")
    age = (F.lit(now).cast("timestamp").cast("double") - F.col("posted_at").cast("double")) / 86400.0 / 90.0
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return {
        "skills": F.size(F.filter(have(c.skills), lambda s: F.array_contains("skill_tokens", s))) / float(len(c.skills)) if c.skills else half,
        "title": F.when(F.arrays_overlap(have(asked), F.col("title_tokens")), 1.0).otherwise(0.0) if c.titles else half,
        "location_work_mode": F.when(F.size(out) == 0, 1.0).when(both, 0.0).otherwise(0.5) if c.places() or c.work_modes else half,
        "seniority": F.when(F.lower(F.coalesce("seniority", F.lit("mid"))).isin(*c.seniority), 1.0).otherwise(0.0) if c.seniority else half,
        "recency": F.coalesce(unit(F.exp(-math.log(2.0) * age)), F.lit(0.0)),
        "compensation": half if pay is None else F.when(offered().isNull(), 0.0).when(offered() >= pay, 1.0).when(F.lit(pay <= 0), 0.0).otherwise(unit(offered() / (pay or 1.0))),
    }


def ranked_jobs(live: DataFrame, features: DataFrame, c: Candidate, now: str, policy: Policy | None = None, profile_weights: DataFrame | None = None, top_k: int = 25, include_excluded: bool = False) -> DataFrame:
    """The best jobs for a candidate: job_id, score, match_reasons, required_missing_skills, apply_url, posted_at, source, quality_flags, excluded, exclude_reasons.

    Active jobs are joined with their features. Jobs that fail a filter come last with score 0, if at all;
    otherwise by score (6 places), newest first, then job_id, at most ``top_k`` in all.
    """
    policy = policy or Policy()
    jobs = live.where("is_active").join(features, "job_id").withColumn("exclude_reasons", _exclusions(c))
    jobs = jobs.withColumns({f"signal_{k}": v for k, v in _signals(c, now).items()})
    weights: dict[str, Column | float] = dict(policy.normalized())
    if profile_weights is not None:
        jobs = jobs.crossJoin(F.broadcast(multipliers_of(profile_weights, c.profile_id, now)))  # one row
        weights = {k: F.lit(w) * F.col(f"m_{k}") for k, w in weights.items()}
    excluded = F.size("exclude_reasons") > 0
    total = sum((F.col(f"signal_{k}") * w for k, w in weights.items()), F.lit(0.0))
    score = F.when(excluded, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6))
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    out = jobs.select("job_id", score.alias("score"), reasons(weights, policy.reason_limit).alias("match_reasons"), missing_skills(c).alias("required_missing_skills"), "apply_url", "posted_at", "source", flags.alias("quality_flags"), excluded.alias("excluded"), "exclude_reasons")
    kept = out if include_excluded else out.where(~F.col("excluded"))
    return kept.orderBy("excluded", F.desc("score"), F.desc_nulls_last("posted_at"), "job_id").limit(max(1, top_k))


def cached_profiles(cache: DataFrame, entries: DataFrame, now: str, ttl_days: int) -> DataFrame:
    """A cache by profile_id after new entries, which expire after so many days; expired ones go.

    cache and entries have profile_id and payload, the cache expires_at too.
    """
    until = F.lit(now).cast("timestamp") + F.make_interval(days=F.lit(ttl_days))
    fresh = entries.withColumn("expires_at", until)
    alive = cache.where(F.col("expires_at") > F.lit(now).cast("timestamp"))
    return fresh.unionByName(alive.join(entries.select("profile_id"), "profile_id", "left_anti").select(*fresh.columns))
