"""Guessing which columns of a source stand for canonical ones: by name, by type, and by how much of them parses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contract import CANONICAL, DATES, FALSE, NULL, TRUE, Field, coerced
from ..functions.text import strip

#: Other names of canonical columns, and the weights of the three scores.
SYNONYMS = {
    "location": ("location", "location_raw", "job_location", "city", "geo_location"),
    "remote": ("remote", "remote_flag", "is_remote", "work_from_home", "wfh"),
    "description_text": ("description", "description_text", "job_description", "details"),
    "description_html": ("description_html", "job_html", "html_description"),
    "apply_url": ("apply_url", "application_url", "url", "job_url"),
    "posted_at": ("posted_at", "date_posted", "published_at", "posted_date", "created_at"),
    "salary_min": ("salary_min", "min_salary", "comp_min", "salary_from"),
    "salary_max": ("salary_max", "max_salary", "comp_max", "salary_to"),
}
BY_NAME, BY_TYPE, BY_PARSING = 0.5, 0.2, 0.3
CASTS = {"remote": "bool", "salary_min": "float", "salary_max": "float", "posted_at": "date_string"}
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def name_score(canonical: str, column: str) -> float:
    if canonical == column:
        return 1.0
    if column.lower() in SYNONYMS.get(canonical, ()):
        return 0.95
    a, b = ({t for t in re.split("[^a-z0-9]+", x.lower()) if t} for x in (canonical, column))
    return min(0.9, len(a & b) / max(len(a), len(b), 1))


def type_score(cast: str, kind: str) -> float:
    number, text = kind.startswith(_NUMBERS), kind == "string"
    if cast == "bool":
        return 1.0 if kind == "boolean" else 0.7 if number or text else 0.2
    if cast == "float":
        return 1.0 if number else 0.6 if text else 0.2
    if cast == "date_string":
        return 1.0 if kind.startswith(("date", "timestamp")) else 0.8 if text else 0.3
    return 1.0 if text else 0.6


def suggestions(df: DataFrame, sample_rows: int = 50_000) -> DataFrame:
    """(field, column, score, name_score, type_score, parse_score) of every canonical field and every other column.

    The first ``sample_rows`` rows are looked at, in one aggregation; columns of arrays, maps and structs count
    as half parseable.
    """
    if sample_rows < 1:
        raise ValueError("sample_rows must be 1 or more")
    sample, types = df.limit(sample_rows), dict(df.dtypes)
    plain = [c for c in df.columns if not types[c].startswith(("array", "map", "struct"))]
    counts = [F.count(F.col(f"`{c}`")).alias(f"n:{c}") for c in df.columns]
    for c in plain:
        text = strip(F.col(f"`{c}`").cast("string"))
        counts.append(F.count_if(text.isNotNull() & ~F.lower(text).isin(*NULL)).alias(f"said:{c}"))
        counts += [F.count(coerced(F.col(f"`{c}`"), Field((c,), cast))[0]).alias(f"{cast}:{c}") for cast in sorted(set(CASTS.values()))]
    row = sample.agg(*counts)

    def parse_score(cast: str, c: str):
        if cast == "string":
            return F.when(F.col(f"`n:{c}`") == 0, 0.5).otherwise(1.0)
        if c not in plain:
            return F.lit(0.5)
        said = F.col(f"`said:{c}`")
        return F.when(said > 0, F.least(F.lit(1.0), F.col(f"`{cast}:{c}`") / F.nullif(said, F.lit(0)))).otherwise(0.5)

    each = []
    for field in CANONICAL:
        cast = CASTS.get(field, "string")
        for c in df.columns:
            if c == field:
                continue
            by_name, by_type, by_parsing = name_score(field, c), type_score(cast, types[c]), parse_score(cast, c)
            total = F.lit(BY_NAME * by_name + BY_TYPE * by_type) + BY_PARSING * by_parsing
            each.append(F.struct(F.lit(field).alias("field"), F.lit(c).alias("column"), F.round(total, 4).alias("score"), F.lit(round(by_name, 4)).alias("name_score"), F.lit(by_type).alias("type_score"), F.round(by_parsing, 4).alias("parse_score")))
    return row.select(F.explode(F.array(*each)).alias("s")).select("s.*")


def inferred(df: DataFrame, sample_rows: int = 50_000, top: int = 3, least: float = 0.55) -> tuple[dict[str, Field], list[str]]:
    """The adapter's fields (of each the best columns that reach the least score), and canonical columns without any.

    A few rows of scores come to the driver: fields times columns.
    """
    if top < 1 or not 0 <= least <= 1:
        raise ValueError("top must be 1 or more and the least score between 0 and 1")
    rows = suggestions(df, sample_rows).where(F.col("score") >= least).orderBy("field", F.desc("score"), "column").collect()
    fields = {f: Field(tuple(r.column for r in rows if r.field == f)[:top], CASTS.get(f, "string")) for f in CANONICAL if any(r.field == f for r in rows)}
    return fields, sorted(set(CANONICAL) - set(fields))


def as_toml(fields: dict[str, Field], on_error: str = "null_warn") -> str:
    """The adapter as a fragment of a configuration file."""
    quoted = lambda values: "[" + ", ".join(f'"{v}"' for v in values) + "]"
    lines = ["[input.adapter]", "enabled = true", f'on_error = "{on_error}"', ""]
    for name in (c for c in CANONICAL if c in fields):
        f = fields[name]
        lines += [f"[input.adapter.fields.{name}]", f"from = {quoted(f.sources)}", f'cast = "{f.cast}"']
        if f.cast == "bool":
            lines += [f"true_values = {quoted(f.true or TRUE)}", f"false_values = {quoted(f.false or FALSE)}"]
        if f.cast == "date_string":
            lines.append(f"datetime_formats = {quoted(f.formats or DATES)}")
        lines.append("")
    return "\n".join(lines).strip() + "\n"
