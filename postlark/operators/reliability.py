"""Checks before a run: can the input be read, does it meet the contract and a policy."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_utc, text_or_null
from .contract import CANONICAL, check, conform, resolve_aliases


@dataclass(frozen=True)
class Policy:
    """The default policy."""

    min_rows: int = 1
    required: tuple[str, ...] = ("title", "description_text")
    max_null_pct: dict[str, float] = field(default_factory=lambda: {"title": 10.0, "description_text": 15.0})
    freshness_column: str = "posted_at"
    max_age_days: int = 30


def evaluate(df: DataFrame, now: str, policy: Policy | None = None, sample_rows: int | None = None) -> DataFrame:
    """(n, code, status, value): the checks in order, from one aggregation over the frame (or its first rows, if so asked).

    value is what was measured: rows, missing columns, the number of columns above their limit, days.
    """
    policy = policy or Policy()
    sample = df if sample_rows is None else df.limit(sample_rows)
    named, _ = resolve_aliases(sample)
    try:
        ready, contract_ok = conform(check(named)), True
    except ValueError:
        ready, contract_ok = conform(named), False
    missing = [c for c in policy.required if c not in named.columns]
    n = F.count(F.lit(1))
    nulls = [F.coalesce(F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, n) > limit, F.lit(False)).cast("int") for c, limit in policy.max_null_pct.items() if c in ready.columns]
    dated = policy.freshness_column in ready.columns
    when = F.max(F.unix_seconds(F.to_timestamp(iso_utc(F.col(policy.freshness_column))))) if dated else F.lit(None).cast("long")
    described = F.count_if(text_or_null(F.col("title")).isNotNull() & (text_or_null(F.col("description_text")).isNotNull() | text_or_null(F.col("description_html")).isNotNull()))
    row = ready.agg(n.alias("rows"), sum(nulls, F.lit(0)).alias("over"), F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - when) / 86400).alias("age"), described.alias("described"))
    rows, age = F.col("rows"), F.col("age")
    status = lambda ok, bad: F.when(ok, "pass").otherwise(bad)
    checks = [
        ("ENV_PYTHON_VERSION", status(F.lit(sys.version_info >= (3, 11)), "fail"), F.lit(float(sys.version_info.minor))),
        ("INPUT_SAMPLE_READ", F.lit("pass"), rows),
        ("INPUT_CANONICAL_CONTRACT", status(F.lit(contract_ok), "fail"), F.lit(float(sum(c not in named.columns for c in CANONICAL)))),
        ("INPUT_CONTENT_READINESS", status(F.col("described") > 0, "fail"), F.col("described")),
        ("POLICY_MIN_ROWS", F.when(rows == 0, "fail").when(rows < policy.min_rows, "warn").otherwise("pass"), rows),
        ("POLICY_REQUIRED_COLUMNS", status(F.lit(not missing), "warn"), F.lit(float(len(missing)))),
        ("POLICY_NULL_RATE", F.when((rows == 0) | (F.col("over") > 0), "warn").otherwise("pass"), F.col("over")),
        ("POLICY_FRESHNESS", status(F.coalesce(age <= policy.max_age_days, F.lit(False)), "warn"), age),
    ]
    each = [F.struct(F.lit(k).alias("n"), F.lit(code).alias("code"), state.alias("status"), value.cast("double").alias("value")) for k, (code, state, value) in enumerate(checks)]
    return row.select(F.explode(F.array(*each)).alias("c")).select("c.*")
