"""Raw records of job boards, one JSON object a row, brought onto the ingested schema.

A record is parsed once as a variant; a field is then an expression on it. As on the boards' side, the first
field that says anything wins: a missing field, null, an empty text, zero, false and an empty list or object
say nothing. Where none does, the last of them is taken as it is, a zero too.
"""

from __future__ import annotations

import hashlib
import html
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import contains_any, iso_of, iso_utc, once, text_or_null
from .contract import truth

SOURCES = ("greenhouse", "lever", "ashby", "workable")
#: Where each board says when a record was posted, the first that says anything.
POSTED = {
    "greenhouse": ("first_published", "updated_at", "created_at"),
    "lever": ("createdAt", "updatedAt"),
    "ashby": ("publishedAt", "publishedDate", "updatedAt", "postedAt"),
    "workable": ("published_on", "published", "updated_at", "created_at"),
    "": ("posted_at", "updated_at", "created_at"),
}
#: From this number on an epoch counts milliseconds.
MILLISECONDS_FROM = 1e12


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references resolved; the table of names has no counterpart among Spark's functions."""
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def payload_hash(records: pd.Series) -> pd.Series:
    """SHA-256 of a record as canonical JSON, keys sorted; null for what isn't an object."""

    def of(text: str | None) -> str | None:
        try:
            raw = json.loads(text)
        except (TypeError, ValueError):
            return None
        return hashlib.sha256(json.dumps(raw, sort_keys=True).encode()).hexdigest() if isinstance(raw, dict) else None

    return records.map(of)


class Record:
    """Expressions on the fields of a parsed record."""

    def __init__(self, parsed: Column):
        self.parsed = parsed

    def field(self, path: str) -> Column:
        """(kind, text) of a field; truth values are written with a capital."""
        kind = F.schema_of_variant(F.try_variant_get(self.parsed, f"$.{path}", "variant"))
        raw = F.try_variant_get(self.parsed, f"$.{path}", "string")
        return F.struct(kind.alias("kind"), F.when(kind == "BOOLEAN", F.initcap(raw)).otherwise(raw).alias("text"))

    def kind(self, path: str) -> Column:
        return self.field(path)["kind"]

    def said(self, path: str) -> Column:
        return self.field(path)["text"]

    def text(self, path: str) -> Column:
        return text_or_null(self.said(path))

    def telling(self, path: str) -> Column:
        """The field as text if it says anything."""

        def of(f: Column) -> Column:
            raw, kind = f["text"], f["kind"]
            nothing = (raw == "") | ((kind == "BOOLEAN") & (raw == "False")) | (~kind.isin("STRING", "BOOLEAN") & ((raw.try_cast("double") == 0) | raw.isin("[]", "{}")))
            return F.when(~nothing, raw)

        return once(self.field(path), of)

    def first(self, *paths: str) -> Column:
        """The first of the fields that says anything, else the last as it is; without blanks at its ends."""
        return text_or_null(F.coalesce(*[self.telling(p) for p in paths[:-1]], self.said(paths[-1])))

    def truth(self, path: str) -> Column:
        return truth(self.said(path))

    def number(self, path: str) -> Column:
        raw = F.when(self.kind(path) == "BOOLEAN", F.when(self.said(path) == "True", "1").otherwise("0")).otherwise(self.text(path))
        return once(raw, lambda x: F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double")))

    def is_number(self, path: str) -> Column:
        return F.coalesce(self.kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.lit(False))


class Fetched(Record):
    """Fields that an earlier projection has fetched, each once; ``paths`` says which are asked for."""

    def __init__(self, parsed: Column):
        super().__init__(parsed)
        self.paths: list[str] = []

    def field(self, path: str) -> Column:
        if path not in self.paths:
            self.paths.append(path)
        return F.col(f"`{path}`")


def epoch_iso(seconds: Column) -> Column:
    return iso_of(F.timestamp_micros(F.round(seconds * 1e6).cast("long")))


def when_said(text: Column) -> Column:
    """A date and time as UTC in ISO form; text that can't be read stays."""
    return F.coalesce(iso_utc(text), text_or_null(text))


def mode_of(c: Column) -> Column:
    return once(F.lower(F.coalesce(c, F.lit(""))), lambda low: F.when(low.contains("remote"), "remote").when(low.contains("hybrid"), "hybrid").when(contains_any(low, ["onsite", "on-site"]), "onsite").otherwise("unknown"))


def far_of(c: Column) -> Column:
    """Whether a text says remote (true), hybrid or on site (false), or nothing of it (null)."""
    return once(mode_of(c), lambda mode: F.when(mode == "remote", True).when(mode != "unknown", False))


def plain_description(text: Column, html_text: Column) -> Column:
    """The text, else the markup without tags, references resolved and white space collapsed."""
    bare = F.regexp_replace(text_or_null(html_text), "<[^>]+>", " ")
    resolved = F.when(bare.contains("&"), unescaped(bare)).otherwise(bare)
    return F.coalesce(text_or_null(text), text_or_null(F.regexp_replace(resolved, r"(?U)\s+", " ")))


# The names of fields in each board's records, and the order in which they are asked, down to ``_any``.


def _greenhouse(r: Record) -> dict[str, Column]:
    place = r.text("location.name")
    return {
        "id": r.text("id"), "title": r.text("title"), "company": r.first("company_name", "company", "office"), "location": place, "remote": far_of(place), "mode": place,
        "description_text": r.text("content"), "description_html": r.text("content"), "apply_url": r.text("absolute_url"), "posted_at": when_said(r.first("first_published", "updated_at", "created_at")),
        "source_updated_at": when_said(r.text("updated_at")), "salary_currency": r.text("currency"), "employment_type": r.text("employment_type"), "seniority": r.text("seniority"), "job_url": r.text("absolute_url"),
    }


def _lever(r: Record) -> dict[str, Column]:
    place, kind, url = r.text("categories.location"), r.text("workplaceType"), r.first("hostedUrl", "applyUrl")

    def changed(path: str) -> Column:
        n = r.number(path)
        return F.when(r.is_number(path), epoch_iso(F.when(F.abs(n) > MILLISECONDS_FROM, n / 1000.0).otherwise(n))).otherwise(when_said(r.text(path)))

    return {
        "id": r.text("id"), "title": r.first("text", "title"), "company": F.coalesce(r.text("company"), r.text("categories.organization"), r.text("categories.team")), "location": place,
        "remote": F.coalesce(far_of(kind), far_of(place)), "mode": F.coalesce(kind, place), "description_text": r.first("descriptionPlain", "description"), "description_html": r.text("description"),
        "apply_url": url, "posted_at": F.when(r.is_number("createdAt"), epoch_iso(r.number("createdAt") / 1000.0)).otherwise(when_said(r.text("createdAt"))),
        "source_updated_at": F.when(r.telling("updatedAt").isNotNull(), changed("updatedAt")).otherwise(changed("createdAt")), "salary_currency": r.text("salaryCurrency"), "salary_interval": r.text("salaryInterval"),
        "employment_type": r.text("categories.commitment"), "seniority": r.text("categories.level"), "job_url": url,
    }


def _ashby(r: Record) -> dict[str, Column]:
    place, kind, url = r.first("location", "locationName", "locationLabel"), r.text("workplaceType"), r.first("jobUrl", "jobPostUrl", "applyUrl")
    return {
        "id": r.first("id", "jobId"), "title": r.first("title", "jobTitle"), "company": F.coalesce(r.text("companyName"), r.text("organizationName"), r.text("team.name")), "location": place,
        "remote": F.coalesce(r.truth("isRemote"), far_of(kind), far_of(place)), "mode": F.coalesce(kind, place), "description_text": r.first("descriptionPlain", "descriptionText", "description"),
        "description_html": r.first("descriptionHtml", "description"), "salary_min": r.number("salaryMin"), "salary_max": r.number("salaryMax"), "apply_url": url,
        "posted_at": when_said(r.first("publishedAt", "publishedDate", "updatedAt", "postedAt")), "source_updated_at": when_said(r.first("updatedAt", "publishedAt")),
        "salary_currency": r.text("salaryCurrency"), "salary_interval": r.text("salaryInterval"), "employment_type": r.text("employmentType"), "seniority": r.text("seniority"), "job_url": url,
    }


def _workable_place(r: Record) -> Column:
    """A place as such, else city, state and country, else the labels of all places."""
    one = F.when(r.kind("location").startswith("OBJECT"), r.first("location.location_str", "location.city", "location.country")).otherwise(r.text("location"))
    composed = F.concat_ws(", ", *[r.text(p) for p in ("city", "state", "country")])
    listed = F.transform(F.try_variant_get(r.parsed, "$.locations", "array<variant>"), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), Record(v).first("location_str", "name", "city")).otherwise(text_or_null(F.try_variant_get(v, "$", "string"))))
    return F.coalesce(one, F.nullif(composed, F.lit("")), F.nullif(F.array_join(F.array_compact(listed), ", "), F.lit("")))


def _workable(r: Record) -> dict[str, Column]:
    place, url, far = _workable_place(r), r.first("url", "apply_url"), r.truth("telecommuting")
    return {
        "id": r.first("code", "shortcode", "id"), "title": r.text("title"), "company": r.first("account", "company"), "location": place, "remote": F.coalesce(far, far_of(place)),
        "mode": F.when(far, "remote").otherwise(place), "description_text": r.first("description", "description_plain"), "description_html": r.text("description"), "salary_min": r.number("salary_min"), "salary_max": r.number("salary_max"),
        "apply_url": F.coalesce(r.text("application_url"), url), "posted_at": when_said(r.first("published_on", "published", "updated_at", "created_at")),
        "source_updated_at": when_said(r.first("updated_at", "created_at", "published_on")), "salary_currency": r.text("salary_currency_code"), "salary_interval": r.text("salary_interval"),
        "employment_type": r.text("employment_type"), "seniority": r.first("experience_level", "experience"), "job_url": F.coalesce(r.first("url", "shortlink"), url),
    }


def _any(r: Record) -> dict[str, Column]:
    url, place = r.first("apply_url", "url"), r.text("location")
    return {
        "id": r.text("id"), "title": r.text("title"), "company": r.text("company"), "location": place, "remote": far_of(place), "mode": place, "description_text": r.first("description_text", "description"),
        "description_html": r.first("description_html", "description"), "salary_min": r.number("salary_min"), "salary_max": r.number("salary_max"), "apply_url": url, "posted_at": when_said(r.text("posted_at")),
        "source_updated_at": when_said(r.text("updated_at")), "salary_currency": r.text("salary_currency"), "salary_interval": r.text("salary_interval"), "employment_type": r.text("employment_type"), "seniority": r.text("seniority"), "job_url": url,
    }


FIELDS = "id title company location remote mode description_text description_html salary_min salary_max apply_url posted_at source_updated_at salary_currency salary_interval employment_type seniority job_url".split()
_KINDS = {"remote": "boolean", "salary_min": "double", "salary_max": "double"}


def normalized(records: DataFrame, source: str, source_ref: str, at: str, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of one board (a column of JSON texts) in the ingested schema of 24 columns.

    Rows that aren't JSON objects have nulls but for the source's own columns. The company falls back on
    source_ref, the description on the markup, remote and work_mode on the place, and posted_at on the
    board's other dates. ``at`` is the time of the run. Columns of the records named in ``keep`` stay.
    """
    extract = {"greenhouse": _greenhouse, "lever": _lever, "ashby": _ashby, "workable": _workable}.get(source, _any)
    parsed = records.select(F.col(raw).alias("_raw"), F.try_parse_json(raw).alias("_json"), *keep)
    r = Fetched(F.col("_json"))
    found = extract(r)
    typed = {c: found.get(c, F.lit(None)).cast(_KINDS.get(c, "string")) for c in FIELDS}
    late = F.coalesce(*[when_said(r.text(p)) for p in POSTED.get(source, POSTED[""])])
    fetched = parsed.select("_raw", "_json", *keep, *[Record(F.col("_json")).field(p).alias(p) for p in r.paths])
    base = fetched.select("_raw", *keep, *[v.alias(c) for c, v in typed.items()], late.alias("_late"))
    mode = mode_of(F.col("mode"))
    described = plain_description(F.col("description_text"), F.col("description_html"))
    return base.select(
        "id", "title", F.coalesce("company", text_or_null(F.lit(source_ref))).alias("company"), "location", F.coalesce("remote", far_of(F.col("mode")), far_of(F.col("location"))).alias("remote"),
        described.alias("description_text"), "description_html", F.array().cast("array<string>").alias("skills"), "salary_min", "salary_max", "apply_url", F.coalesce("posted_at", "_late").alias("posted_at"),
        F.lit(source).alias("source"), F.lit(source_ref).alias("source_ref"), F.col("id").alias("source_job_id"), F.coalesce("job_url", "apply_url").alias("job_url"), F.lit(at).alias("ingested_at_utc"),
        payload_hash(F.col("_raw")).alias("source_payload_hash"), "source_updated_at", F.when(mode != "unknown", mode).otherwise(mode_of(F.col("location"))).alias("work_mode"),
        "salary_currency", "salary_interval", "employment_type", "seniority", *keep,
    )


# -- quality of what came in --------------------------------------------------------------------------

#: The default policy.
REQUIRED = ("id", "title", "apply_url", "posted_at", "source", "source_ref", "source_job_id", "source_payload_hash")
NULL_LIMITS = {"id": 0.0, "title": 0.0, "apply_url": 0.0, "source_job_id": 0.0, "company": 0.05, "description_text": 0.10, "posted_at": 0.10}
SIGNAL_LEAST, MIN_ROWS = 0.85, 1
MAX_AGE_DAYS = {"posted_at": 365, "source_updated_at": 730}


def has_place(df: DataFrame) -> Column:
    """A place, a remote flag, or a known mode of work."""
    mode = F.lower(text_or_null(F.col("work_mode"))).isin("remote", "hybrid", "onsite") if "work_mode" in df.columns else F.lit(False)
    return text_or_null(F.col("location")).isNotNull() | F.col("remote").isNotNull() | F.coalesce(mode, F.lit(False))


def quality_checks(df: DataFrame, now: str, required: tuple[str, ...] = REQUIRED, min_rows: int = MIN_ROWS, null_limits: dict[str, float] | None = None, signal_least: float = SIGNAL_LEAST, max_age_days: dict[str, int] | None = None) -> DataFrame:
    """(n, code, value, limit, status): the checks of one pull, in order, from one aggregation.

    Of an empty table all null rates are 1 and the share with a place is 0. A date column that isn't there
    or has no readable date fails its freshness check, whose value is null.
    """
    null_limits, max_age_days = null_limits or NULL_LIMITS, max_age_days or MAX_AGE_DAYS
    n = F.count(F.lit(1))
    have = lambda c: text_or_null(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    share = lambda count, empty: F.when(n > 0, count / F.nullif(n, F.lit(0))).otherwise(empty).cast("double")
    values: list[tuple[str, Column, float | None, str]] = [
        ("REQUIRED_COLUMNS", F.lit(float(sum(c not in df.columns for c in required))), 0.0, "most"),
        ("MIN_ROWS", n.cast("double"), float(min_rows), "least"),
        *[(f"NULL_RATE_{c.upper()}", share(F.count_if(have(c).isNull()), 1.0), limit, "most") for c, limit in sorted(null_limits.items())],
        ("LOCATION_OR_REMOTE_SIGNAL", share(F.count_if(has_place(df)), 0.0), signal_least, "least"),
    ]
    for c, days in max_age_days.items():
        when = iso_utc(have(c))
        newest = F.max(F.unix_seconds(F.to_timestamp(when)))
        values += [
            (f"{c.upper()}_PARSEABLE", F.count_if(have(c).isNotNull() & when.isNull()).cast("double"), 0.0, "most"),
            (f"{c.upper()}_FRESHNESS", F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - newest) / 86400).cast("double"), float(days), "most"),
        ]
    row = df.agg(*[v.alias(f"v{k}") for k, (_, v, _, _) in enumerate(values)])
    ok = lambda v, limit, way: F.coalesce(v <= limit if way == "most" else v >= limit, F.lit(False))
    checks = [F.struct(F.lit(k).alias("n"), F.lit(f"INGEST_QUALITY_{code}").alias("code"), F.col(f"v{k}").alias("value"), F.lit(limit).alias("limit"), F.when(ok(F.col(f"v{k}"), limit, way), "pass").otherwise("fail").alias("status")) for k, (code, _, limit, way) in enumerate(values)]
    return row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def key_completeness(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows and per cent (3 places) with a company, a date, a description, and a place or remote signal; 0 of an empty table."""
    n = F.count(F.lit(1))
    pct = lambda c: F.round(F.coalesce(F.count_if(c) * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)), 3)
    figures = [n.alias("rows"), *[pct(text_or_null(F.col(c)).isNotNull()).alias(f"{c}_non_null_pct") for c in ("company", "posted_at", "description_text")], pct(has_place(df)).alias("location_or_remote_signal_pct")]
    return df.groupBy(*by).agg(*figures) if by else df.agg(*figures)


def completeness_over_sources(each: DataFrame) -> DataFrame:
    """One row: the figures of several pulls, weighed by their rows (3 places)."""
    names = [c for c in each.columns if c.endswith("_pct")]
    return each.where("rows > 0").agg(*[F.round(F.sum(F.col(c) * F.col("rows")) / F.sum("rows"), 3).alias(c) for c in names])


def watermarks(df: DataFrame) -> DataFrame:
    """One row: the latest posted_at and source_updated_at that can be read, as text."""
    return df.agg(*[F.max(iso_utc(F.col(c))).alias(f"high_{c}") for c in ("posted_at", "source_updated_at")])
