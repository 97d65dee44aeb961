"""Expressions on text and numbers that the operators share. Each takes and gives a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that identify a posting.
IDENTITY_PARAMETERS = ("gh_jid", "job_id", "jobid", "posting_id", "position_id")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; Spark's own trim takes blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_null(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


def clipped(c: Column) -> Column:
    """Between 0 and 1; null, NaN and infinite values count as 0."""
    value = c.cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.0)


def number(c: Column) -> Column:
    """A double from text such as ``140,000``; null for anything else, Java's suffixes (``10d``) included."""
    plain = F.regexp_replace(strip(c.cast("string")), ",", "")
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def timestamp(c: Column) -> Column:
    """A UTC timestamp from a date or an ISO date and time; null for partial dates that Spark alone would take."""
    plain = strip(c.cast("string"))
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), plain.try_cast("timestamp"))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def iso_utc(c: Column) -> Column:
    """A date, ISO date and time (without a zone: UTC) or timestamp as ISO text in UTC, whatever the session's zone; null if unreadable."""
    clock = r"[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"

    def zoned(plain: Column) -> Column:
        day = r"^\d{4}-\d{2}-\d{2}"
        return F.when(plain.rlike(day + "$"), F.concat(plain, F.lit("T00:00:00Z"))).when(plain.rlike(day + clock + "$"), F.concat(plain, F.lit("Z"))).when(plain.rlike(day + clock + r"(Z|[+-]\d{2}:?\d{2})$"), plain)

    return iso_of(once(strip(c.cast("string")), zoned).try_cast("timestamp"))


def iso_of(c: Column) -> Column:
    """A timestamp as ISO text in UTC."""

    def shown(micros: Column) -> Column:
        within = F.pmod(micros, F.lit(86_400_000_000))
        date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int")), "yyyy-MM-dd")
        two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
        fraction = F.pmod(within, F.lit(1_000_000))
        clock = F.concat(two(within / 3_600_000_000), F.lit(":"), two(F.pmod(within, F.lit(3_600_000_000)) / 60_000_000), F.lit(":"), two(F.pmod(within, F.lit(60_000_000)) / 1_000_000))
        return F.concat(date, F.lit("T"), clock, F.when(fraction > 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))

    return once(F.unix_micros(c), shown)


def tokens(c: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of two characters or more; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def url_key(c: Column) -> Column:
    """What identifies an address: no fragment, only identity parameters (sorted), no trailing slash, lower case."""
    plain = strip(c)
    full = plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
    bare = F.regexp_replace(plain, r"#.*$", "")
    path, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.lower(F.element_at(F.split(p, "=", 2), 1)).alias("k"), F.trim(F.coalesce(F.try_element_at(F.split(p, "=", 2), F.lit(2)), F.lit(""))).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: p["k"].isin(*IDENTITY_PARAMETERS) & (p["v"] != "")))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.when(joined != "", F.concat(path, F.lit("?"), joined)).otherwise(path)
    return F.when(plain != "", F.when(full, F.lower(F.regexp_replace(whole, "/+$", ""))).otherwise(F.lower(plain)))


def dedup_key(url: str = "apply_url", job_url: str = "job_url") -> Column:
    """The address of a posting, else its source's id, else a hash of what it says."""
    norm = lambda n: F.lower(F.coalesce(strip(F.col(n).cast("string")), F.lit("")))
    of_url = lambda n: F.concat(F.lit("url:"), F.nullif(url_key(F.col(n)), F.lit("")))
    by_id = F.when((norm("source") != "") & (norm("source_job_id") != ""), F.concat(F.lit("source-id:"), norm("source"), F.lit(":"), norm("source_job_id")))
    said = F.concat(F.lit("fallback:"), F.sha2(F.concat_ws("|", *[norm(n) for n in ("title", "company", "location", "posted_at")]), 256))
    return F.coalesce(of_url(url), of_url(job_url), by_id, said)
