"""A dataset's profile as a set of tables, findings with severities, what changed between two profiles, and a gate.

Every table is a plan over the frames, so a profile costs a few aggregations and holds no rows on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile
from .profile import consistency_of_both, quality_by_source

SEVERITIES = ("P0", "P1", "P2")
CATEGORIES = ("source", "remote", "location", "company")


@dataclass(frozen=True)
class Rules:
    """Limits of findings, of drift, and of the gate."""

    low_score: float = 90.0
    target_score: float = 95.0
    title_is_company_pct: float = 5.0
    posted_at_pct: float = 80.0
    unknown_place_pct: float = 30.0
    psi_warn: float = 0.10
    psi_fail: float = 0.25
    jsd_warn: float = 0.10
    jsd_fail: float = 0.20
    numeric: tuple[str, ...] = ("salary_min", "salary_max")
    categorical: tuple[str, ...] = CATEGORIES
    fail_on: tuple[str, ...] = ("P0",)
    warn_on: tuple[str, ...] = ("P1",)
    max_p0: int = 0
    max_p1: int = 999_999

    def limit(self, severity: str) -> int:
        return {"P0": self.max_p0, "P1": self.max_p1}.get(severity, 999_999)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def source_figures(raw: DataFrame, runtime: DataFrame) -> DataFrame:
    """Rows of both frames by source, per cent of raw rows with a date and of runtime rows that are remote."""
    a = profile.source_profile(raw).select("source", F.col("rows").alias("rows_raw"), "posted_at_pct")
    b = profile.source_profile(runtime).select("source", F.col("rows").alias("rows"), "remote_pct")
    return a.join(b, "source", "left").na.fill(0, ["rows"]).na.fill(0.0, ["remote_pct"])


def tables(raw: DataFrame, runtime: DataFrame, top_k: int = 10) -> dict[str, DataFrame]:
    """The nine tables of a profile. ``raw`` is the input as read, ``runtime`` what it became on the canonical columns."""
    if top_k < 1:
        raise ValueError("top_k must be 1 or more")
    top = lambda df, c, blanks: profile.top_values(df, c, top_k, blanks).orderBy(F.desc("count"), "value")
    return {
        "null_percentages": profile.null_percentages(runtime).orderBy(F.desc("null_pct"), "column"),
        "column_profile": profile.column_profile(raw).orderBy(F.desc("null_count"), "column"),
        "source_profile": source_figures(raw, runtime).orderBy(F.desc("rows_raw"), "source"),
        "top_values_source": top(raw, "source", True),
        "top_values_company": top(raw, "company", False),
        "top_values_title": top(raw, "title", False),
        "top_values_location": top(runtime, "location", False),
        "numeric_quantiles": profile.deciles(runtime, ["salary_min", "salary_max"]).orderBy("column", "quantile"),
        "categorical_distribution": _union([profile.distribution_with_rest(runtime, c).select(F.lit(c).alias("column"), "value", "count") for c in CATEGORIES]).orderBy("column", F.desc("count"), "value"),
    }


def _found(severity: Column | str, title: str, value: Column, when: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(level.alias("severity"), F.lit(title).alias("title"), F.round(value.cast("double"), 4).alias("value")))


def _score_finding(title_low: str, title_target: str, rules: Rules) -> list[Column]:
    score = F.col("score_percent")
    return [_found("P1", title_low, score, score < rules.low_score), _found("P2", title_target, score, (score >= rules.low_score) & (score < rules.target_score))]


def findings(raw: DataFrame, runtime: DataFrame, rules: Rules | None = None, weights: dict[str, float] | None = None, top_k: int = 10) -> DataFrame:
    """(severity, source, title, value): what is wrong with the whole (source null) and with single sources.

    The share of unknown places counts only if "unknown" is among the top_k places.
    """
    rules = rules or Rules()
    n = F.count(F.lit(1))
    pct = lambda c: F.coalesce(F.try_divide(F.count_if(c) * 100.0, n), F.lit(0.0))
    same = profile.strip(F.col("title")) == profile.strip(F.col("company"))
    place = profile.top_values(runtime, "location", top_k, blanks=False).where(F.lower(F.trim("value")) == "unknown").agg(F.coalesce(F.max("pct"), F.lit(0.0)).alias("unknown_pct"))
    ones = [
        profile.quality_score(runtime, weights),
        raw.agg(pct(same).alias("title_pct")),
        runtime.agg(F.count_if(F.col("salary_min") > F.col("salary_max")).alias("inverted"), pct(F.col("posted_at").isNotNull()).alias("posted_pct")),
        place,
    ]
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), ones)  # one row each
    whole = F.array_compact(F.array(
        *_score_finding("Low weighted quality score", "Quality score below target", rules),
        _found("P0", "Invalid salary ranges detected", F.col("inverted"), F.col("inverted") > 0),
        _found("P1", "Title appears to contain company names", F.col("title_pct"), F.col("title_pct") >= rules.title_is_company_pct),
        _found("P1", "Low posted_at coverage", F.col("posted_pct"), F.col("posted_pct") < rules.posted_at_pct),
        _found("P1", "Large unknown location share", F.col("unknown_pct"), F.col("unknown_pct") >= rules.unknown_place_pct),
    ))
    by_source = consistency_of_both(raw, runtime).join(quality_by_source(runtime, weights=weights).select("source", "score_percent"), "source", "full")
    each = F.array_compact(F.array(
        *_score_finding("Low source quality score", "Source quality below target", rules),
        _found("P0", "Invalid salary ranges in source", F.col("salary_inverted"), F.col("salary_inverted") > 0),
        _found("P1", "Title/company contamination in source", F.col("title_is_company_pct"), F.col("title_is_company_pct") >= rules.title_is_company_pct),
    ))
    out = row.select(F.lit(None).cast("string").alias("source"), F.explode(whole).alias("f")).unionByName(by_source.select("source", F.explode(each).alias("f")))
    return out.select("f.severity", "source", "f.title", "f.value")


def severity_counts(found: DataFrame) -> DataFrame:
    """(severity, count) of all three severities."""
    row = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return profile.long_form(row, list(SEVERITIES), "severity", "count")


def drift(base: DataFrame, candidate: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(column, kind, metric, value, warn_threshold, fail_threshold, status) of the columns that both frames have values of."""
    rules = rules or Rules()
    there = [c for c in base.columns if c in candidate.columns]

    def table(df: DataFrame, column: str, kind: str, metric: str, warn: float, fail: float) -> DataFrame:
        v = F.round(metric, 4)
        return df.where(F.col(metric).isNotNull()).select(F.lit(column).alias("column"), F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), v.alias("value"), F.lit(warn).alias("warn_threshold"), F.lit(fail).alias("fail_threshold"), F.when(F.col(metric) >= fail, "fail").when(F.col(metric) >= warn, "warn").otherwise("pass").alias("status"))

    parts = [table(profile.stability_index(base, candidate, c), c, "numeric", "psi", rules.psi_warn, rules.psi_fail) for c in rules.numeric if c in there]
    parts += [table(profile.jensen_shannon(base, candidate, c), c, "categorical", "jsd", rules.jsd_warn, rules.jsd_fail) for c in rules.categorical if c in there]
    return _union(parts)


def diff(base: tuple[DataFrame, DataFrame], candidate: tuple[DataFrame, DataFrame], rules: Rules | None = None) -> dict[str, DataFrame]:
    """The four tables of what changed between two (raw, runtime) pairs."""
    rules = rules or Rules()
    counts = [severity_counts(findings(*side, rules)).withColumnRenamed("count", f"{n}_count") for n, side in (("base", base), ("candidate", candidate))]
    nulls = profile.null_diff(base[1], candidate[1])
    return {
        "diff_null_percentages": nulls.withColumn("abs_delta_pct", F.abs("delta_pct")).orderBy(F.desc("abs_delta_pct"), "column"),
        "diff_source_profile": profile.source_diff(source_figures(*base), source_figures(*candidate)).orderBy("source"),
        "drift_metrics": drift(base[1], candidate[1], rules).orderBy("kind", "column"),
        "findings_delta": counts[0].join(counts[1], "severity").withColumn("delta_count", F.col("candidate_count") - F.col("base_count")).orderBy("severity"),
    }


def gate(found: DataFrame, drifted: DataFrame | None = None, rules: Rules | None = None) -> DataFrame:
    """(level, type, subject, value, threshold): a row for each failure and warning; no failure means that the gate is passed.

    Findings fail where a severity's count is above its limit; a severity that may fail isn't warned of.
    """
    rules = rules or Rules()
    counts = severity_counts(found)
    limit = F.element_at(F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.lit(float(rules.limit(s))))]), F.col("severity"))
    fails = F.col("severity").isin(*rules.fail_on)
    level = F.when(fails & (F.col("count") > limit), "failure").when(~fails & F.col("severity").isin(*rules.warn_on) & (F.col("count") > 0), "warning")
    out = counts.select(level.alias("level"), F.lit("finding_count").alias("type"), F.col("severity").alias("subject"), F.col("count").cast("double").alias("value"), limit.alias("threshold")).where("level is not null")
    if drifted is None:
        return out
    status = F.col("status")
    moved = drifted.where(status != "pass").select(F.when(status == "fail", "failure").otherwise("warning").alias("level"), F.lit("drift").alias("type"), F.col("column").alias("subject"), "value", F.when(status == "fail", F.col("fail_threshold")).otherwise(F.col("warn_threshold")).alias("threshold"))
    return out.unionByName(moved)
