"""What callers' texts may say: read-only queries and names of tables; and the records of past runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_utc

_COMMENT, _WRITES = re.compile(r"(?is)/\*.*?\*/|--[^\n]*"), re.compile(r"(?i)\b(?:insert|update|delete|drop|alter|create|attach)\b")


def read_only(query: str) -> str:
    """The query without blanks at its ends; anything but one SELECT (or WITH) without a semicolon is refused."""
    text = query.strip()
    bare = _COMMENT.sub(" ", text)
    if not re.match(r"(?i)\s*(?:select|with)\b", bare) or ";" in text or _WRITES.search(bare):
        raise ValueError("only one read-only SELECT or WITH query is allowed")
    return text


def table_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name.strip()):
        raise ValueError(f"{name!r} can't be a table's name")
    return name.strip()


def select(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """A read-only query over named frames; their names live in this query only."""
    return spark.sql(read_only(query), **{table_name(n): f for n, f in frames.items()})


def past_runs(records: DataFrame, limit: int, status: str | None = None, command: str | None = None, since: str | None = None, code: str | None = None) -> DataFrame:
    """Records of runs (status, command, started_at_utc, check_codes), newest first; with ``since``, those whose start can't be read go."""
    out = records
    for column, value in (("status", status), ("command", command)):
        out = out if value is None else out.where(F.col(column) == value)
    if since is not None:
        out = out.where(iso_utc(F.col("started_at_utc")) >= iso_utc(F.lit(since)))
    if code:
        out = out.where(F.array_contains("check_codes", code))
    return out.orderBy(F.desc_nulls_last("started_at_utc")).limit(limit)
