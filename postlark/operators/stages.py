"""The stages of a run: clean, filter, label, rate, match. Each is one projection or filter on the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clipped, strip

#: Words of a title and of a text that labels look for.
JUNIOR, SENIOR = "(?i)intern|junior|entry", "(?i)senior|staff|principal"
ROLES = (("data", "(?i)data"), ("ml", "(?i)machine learning|ml|ai"), ("backend", "(?i)backend|platform|infra"))
STACK = "python|sql|aws|gcp|java|rust|typescript|docker"
RATED, FULL_LENGTH = ("title", "company", "description_text", "apply_url"), 1500.0
EFFORT = {"senior": 25, "junior": 12, "other": 15}


def plain_text(html: Column) -> Column:
    """Tags become blanks; white space inside stays as it is."""
    return strip(F.regexp_replace(html, "(?is)<[^>]*>", " "))


def clean(df: DataFrame, strip_html: bool = True, drop_untitled: bool = True) -> DataFrame:
    text = strip(F.col("description_text"))
    if strip_html:
        text = F.when(F.coalesce(strip(F.col("description_html")), F.lit("")) != "", plain_text(F.col("description_html"))).otherwise(text)
    out = df.withColumn("description_text", text)
    return out.where(strip(F.col("title")) != "") if drop_untitled else out


def _said() -> Column:
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description_text", F.lit(""))))


def keep(df: DataFrame, remote_only: bool = False, min_salary: float | None = None, keywords: tuple[str, ...] = ()) -> DataFrame:
    """Rows that meet all conditions; rows in which one is unknown go."""
    if remote_only:
        df = df.where(F.col("remote"))
    if min_salary is not None:
        df = df.where(F.coalesce("salary_min", "salary_max") >= min_salary)
    for word in (k.strip().lower() for k in keywords):
        if word:
            df = df.where(_said().contains(word))
    return df


def label(df: DataFrame) -> DataFrame:
    title = F.col("title")
    role = None
    for name, pattern in ROLES:
        role = F.when(title.rlike(pattern), name) if role is None else role.when(title.rlike(pattern), name)
    return df.withColumns({
        "label_seniority": F.when(title.rlike(JUNIOR), "junior").when(title.rlike(SENIOR), "senior").otherwise("mid"),
        "label_role_category": role.otherwise("other"),
        "label_tech_stack": F.array_sort(F.array_distinct(F.regexp_extract_all(_said(), F.lit(STACK), 0))),
    })


def rate(df: DataFrame, completeness_weight: float = 0.5, quality_weight: float = 0.5) -> DataFrame:
    there = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1.0).otherwise(0.0) for c in RATED), F.lit(0.0)) / len(RATED)
    rated = df.withColumns({"rate_completeness": clipped(there), "rate_quality": clipped(F.length(F.coalesce("description_text", F.lit(""))) / FULL_LENGTH)})
    total = completeness_weight + quality_weight
    both = (F.col("rate_completeness") * completeness_weight + F.col("rate_quality") * quality_weight) / total if total > 0 else F.lit(0.0)
    return rated.withColumn("rate_composite", clipped(both))


def match(df: DataFrame, top_k: int = 100, tie: str = "id") -> DataFrame:
    """The top_k rows by score, ties by ``tie``, ranked from 1. The limit comes first, so ranking sees top_k rows."""
    score = clipped(F.col("rate_composite").try_cast("double")) if "rate_composite" in df.columns else F.lit(0.0)
    label_ = F.col("label_seniority") if "label_seniority" in df.columns else F.lit(None).cast("string")
    top = df.withColumns({"fit_score": score, "label_seniority": label_}).orderBy(F.desc("fit_score"), F.asc_nulls_last(tie)).limit(top_k)
    ranked = top.withColumn("fit_rank", F.row_number().over(Window.orderBy(F.desc("fit_score"), F.asc_nulls_last(tie))))
    return ranked.select("fit_rank", *[c for c in ranked.columns if c != "fit_rank"])


def plan(ranked: DataFrame) -> DataFrame:
    level = F.lower(strip(F.col("label_seniority")))
    effort = F.when(level == "senior", EFFORT["senior"]).when(level == "junior", EFFORT["junior"]).otherwise(EFFORT["other"])
    return ranked.select("fit_rank", "title", "company", "apply_url", "fit_score", effort.alias("estimated_effort_minutes"))
