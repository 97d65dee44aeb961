"""Bringing any source onto the canonical columns: mapped fields, aliases, casts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number, strip

CANONICAL = {
    "id": "string", "title": "string", "company": "string", "location": "string", "remote": "boolean", "description_text": "string", "description_html": "string",
    "skills": "array<string>", "salary_min": "double", "salary_max": "double", "apply_url": "string", "posted_at": "string",
}
#: Words for true, false and nothing, and formats of dates.
TRUE, FALSE, NULL = ("true", "1", "yes", "y", "remote"), ("false", "0", "no", "n", "onsite", "on-site"), ("", "null", "none", "n/a", "na")
DATES = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y")
#: Parts of a date's format: how text may have them, and Java's letters for reading and for writing them.
_PARTS = {"%Y": ("[0-9]{4}", "yyyy", "yyyy"), "%m": ("[0-9]{1,2}", "M", "MM"), "%d": ("[0-9]{1,2}", "d", "dd"), "%H": ("[0-9]{1,2}", "H", "HH"), "%M": ("[0-9]{1,2}", "m", "mm"), "%S": ("[0-9]{1,2}", "s", "ss")}
#: Why a value is wrong, by its cast.
REASONS = {"string": "string_parse_failed", "bool": "bool_parse_failed", "float": "float_parse_failed", "int": "int_parse_failed", "date_string": "date_parse_failed"}
ALIASES = {"location": ("location_raw",), "remote": ("remote_flag",)}


def truth(c: Column) -> Column:
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def skills(c: Column, is_array: bool) -> Column:
    """Trimmed items, blank ones dropped; null gives an empty array."""
    items = c if is_array else F.split(c.cast("string"), ",")
    clean = F.filter(F.transform(items, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(clean, F.array().cast("array<string>"))


def conform(df: DataFrame) -> DataFrame:
    """Adds missing canonical columns as null and casts the others, what doesn't parse to null; other columns stay."""
    types = dict(df.dtypes)
    out = {}
    for name, kind in CANONICAL.items():
        c = F.col(name) if name in types else F.lit(None)
        if name == "skills":
            out[name] = skills(c, types.get(name, "").startswith("array")) if name in types else F.array().cast(kind)
        elif kind == "boolean":
            out[name] = c if types.get(name) == "boolean" else truth(c)
        elif kind == "double":
            out[name] = number(c) if types.get(name) == "string" else c.try_cast("double")
        else:
            out[name] = c.cast("string")
    return df.withColumns(out)


def check(df: DataFrame) -> DataFrame:
    """Refuses a frame without a title or any description; looks at the schema only."""
    if "title" not in df.columns or not {"description_text", "description_html"} & set(df.columns):
        raise ValueError("a title and a description column are needed")
    return df


@dataclass(frozen=True)
class Field:
    """How a canonical column is made: the first of ``sources`` that is there, cast."""

    sources: tuple[str, ...]
    cast: str = "string"
    true: tuple[str, ...] = TRUE
    false: tuple[str, ...] = FALSE
    null: tuple[str, ...] = NULL
    formats: tuple[str, ...] = DATES


def _format(fmt: str) -> tuple[str, str, str]:
    """A pattern for text in a date's format, and Java's formats for reading and writing it. Months, days and times may have one digit or two."""
    parts = re.split("(%[YmdHMS])", fmt)
    if any("%" in p for p in parts[::2]):
        raise ValueError(f"a date's format that isn't known: {fmt!r}")
    quoted = lambda p: "'" + p.replace("'", "''") + "'" if p else ""
    shape = "".join(_PARTS[p][0] if k % 2 else "".join("\\" + x if not x.isalnum() else x for x in p) for k, p in enumerate(parts))
    return f"^{shape}$", *("".join(_PARTS[p][n] if k % 2 else quoted(p) for k, p in enumerate(parts)) for n in (1, 2))


def date_text(c: Column, formats: tuple[str, ...]) -> Column:
    """The date in the first format that reads it, written in that format with all its digits; null if none does."""
    found = []
    for shape, reading, writing in map(_format, formats):
        when = F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(reading)))
        found.append(F.date_format(when, writing))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def coerced(c: Column, f: Field) -> tuple[Column, Column]:
    """The cast value, and whether there was something that didn't parse."""
    plain = strip(c.cast("string"))
    nothing = plain.isNull() | F.lower(plain).isin(*f.null)
    if f.cast == "bool":
        word = F.lower(plain)
        value = F.when(word.isin(*f.true), True).when(word.isin(*f.false), False)
    elif f.cast == "float":
        value = number(plain)
    elif f.cast == "int":
        value = F.when(F.regexp_replace(plain, ",", "").rlike("^[+-]?[0-9]+$"), F.regexp_replace(plain, ",", "").try_cast("bigint"))
    elif f.cast == "date_string":
        value = date_text(plain, f.formats)
    else:
        value = plain
    return F.when(~nothing, value), ~nothing & value.isNull()


def adapt(df: DataFrame, fields: dict[str, Field]) -> tuple[DataFrame, DataFrame]:
    """The frame with mapped columns, and one row of counters: <name>_errors and <name>_conflicts.

    A canonical column that is there already stays as it is; rows in which a source disagrees are counted.
    """
    added, counts = {}, []
    for name, f in fields.items():
        source = next((s for s in f.sources if s in df.columns), None)
        if source is None:
            continue
        value, wrong = coerced(F.col(source), f)
        counts.append(F.count_if(wrong).alias(f"{name}_errors"))
        if name in df.columns:
            counts.append(F.count_if(value.cast("string") != F.col(name).cast("string")).alias(f"{name}_conflicts"))
        else:
            added[name] = value
    return df.withColumns(added) if added else df, df.agg(*counts) if counts else df.limit(0)


def error_samples(df: DataFrame, fields: dict[str, Field], order: str, limit: int = 20) -> DataFrame:
    """(field, source, value, reason): what didn't parse, at most ``limit`` in all; fields in their order, then rows by ``order``.

    ``order`` is a column such as sources.ordinals gives. Each task passes on ``limit`` rows at the most.
    """
    wrong = []
    for n, (name, f) in enumerate(fields.items()):
        source = next((s for s in f.sources if s in df.columns), None)
        if source is not None:
            wrong.append(F.when(coerced(F.col(source), f)[1], F.struct(F.lit(n).alias("n"), F.lit(name).alias("field"), F.lit(source).alias("source"), strip(F.col(source).cast("string")).alias("value"), F.lit(REASONS[f.cast]).alias("reason"))))
    each = df.select(F.col(order).alias("_order"), F.explode(F.array_compact(F.array(*wrong))).alias("s"))
    return each.orderBy("s.n", "_order").limit(limit).select("s.field", "s.source", "s.value", "s.reason")


@dataclass(frozen=True)
class Aliases:
    names: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def candidates(self, column: str) -> list[str]:
        return list(dict.fromkeys([*self.names.get(column, ()), *ALIASES.get(column, ())]))


def _comparable(column: str, c: Column) -> Column:
    word = F.lower(strip(c.cast("string")))
    if column != "remote":
        return word
    return F.when(word.isin(*TRUE), "true").when(word.isin(*FALSE), "false").when(word.isin(*NULL), F.lit(None)).otherwise(F.concat(F.lit("__invalid__:"), word))


def resolve_aliases(df: DataFrame, aliases: Aliases | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical columns taken from aliases where they are absent, and one row of conflicts per column."""
    aliases = aliases or Aliases()
    added, counts = {}, []
    for column in CANONICAL:
        there = [a for a in aliases.candidates(column) if a in df.columns]
        if not there:
            continue
        chosen, *others = [column, *there] if column in df.columns else there
        if chosen != column:
            added[column] = F.col(chosen)
        differ = [_comparable(column, F.col(chosen)) != _comparable(column, F.col(o)) for o in others]
        counts.append(sum([F.count_if(d) for d in differ], F.lit(0)).cast("long").alias(f"{column}_conflicts"))
    return df.withColumns(added) if added else df, df.agg(*counts) if counts else df.limit(0)
