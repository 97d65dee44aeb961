"""Candidate profiles from résumé texts, as expressions over a column of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, once, strip

#: Words that are looked for, anywhere in the lower-cased text.
SKILLS = ("python", "sql", "java", "javascript", "typescript", "go", "rust", "aws", "gcp", "docker", "kubernetes", "react", "node", "machine learning")
TITLES = ("software engineer", "backend engineer", "frontend engineer", "full stack engineer", "data engineer", "data scientist", "product manager", "analyst", "designer")
PLACES = ("new york", "san francisco", "london", "berlin", "lisbon", "europe", "united states", "usa")
LEVELS = ("junior", "mid", "senior", "staff", "principal")
#: How years of experience and sums of money are written.
YEARS, MONEY = r"(\d{1,2})\+?\s+years", r"\$\s*([0-9]{2,3})(?:[, ]?([0-9]{3}))?"


def parsed_resumes(df: DataFrame, text: str = "text", profile_id: str = "profile_id") -> DataFrame:
    """One row for each text: profile_id, skills, titles, locations, work_modes, seniority, years_experience, salary_minimum, requires_sponsorship, confidence, unknown.

    Blank and null texts give no row. The id is lower-cased.
    """
    low = df.where(strip(F.col(text)) != "").select(F.lower(strip(F.col(profile_id).cast("string"))).alias("profile_id"), F.lower(strip(F.col(text))).alias("t"))
    t = F.col("t")
    among = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: t.contains(w))
    modes = F.array_compact(F.array(F.when(t.contains("remote"), "remote"), F.when(t.contains("hybrid"), "hybrid"), F.when(contains_any(t, ["onsite", "on-site"]), "onsite")))
    group = lambda pattern, n: F.nullif(F.regexp_extract(t, pattern, n), F.lit(""))

    def salary() -> Column:
        return once(F.struct(group(MONEY, 1).alias("a"), group(MONEY, 2).alias("b")), lambda m: F.when(m["b"].isNotNull(), F.concat(m["a"], m["b"]).cast("double")).otherwise(m["a"].cast("double") * 1000))

    sponsor = F.when(contains_any(t, ["no sponsorship", "does not require sponsorship"]), False).when(contains_any(t, ["requires sponsorship", "need sponsorship"]), True)
    unclear = F.when(t.contains("sponsorship") & ~t.contains("require") & ~t.contains("no sponsorship"), "visa_signal_ambiguous")
    per = F.when(t.contains("$") & ~contains_any(t, ["year", "annual"]), "salary_interval_unspecified")
    found = low.select(
        "profile_id", among(SKILLS).alias("skills"), among(TITLES).alias("titles"), among(PLACES).alias("locations"), modes.alias("work_modes"), among(LEVELS).alias("seniority"),
        group(YEARS, 1).cast("double").alias("years_experience"), salary().alias("salary_minimum"), sponsor.alias("requires_sponsorship"), F.array_compact(F.array(unclear, per)).alias("unknown"),
    )
    has = lambda c, gain: F.when(F.size(c) > 0, gain).otherwise(0.0)
    sure = 0.25 + has("skills", 0.30) + has("titles", 0.20) + has("locations", 0.15) + F.when(F.col("years_experience").isNotNull(), 0.10).otherwise(0.0)
    return found.withColumn("confidence", F.round(F.least(F.lit(1.0), sure), 4))
