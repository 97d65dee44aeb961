"""Candidates as JSON texts, many at once: read, cleaned and checked; what is wrong with one stays with it.

Everything is an expression on the parsed text. A field that is wrong is empty (or null) in the result and named in
``errors``, so good candidates can be matched while the others are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .matching import EMPLOYMENT, MODES

#: What lists of a candidate may hold.
ALLOWED = {"work_mode_preferences": MODES, "seniority_targets": ("junior", "mid", "senior", "staff", "principal"), "employment_type_preferences": (*EMPLOYMENT, "unknown")}
_NONE = "array<string>"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


class _Field:
    """A field of a parsed candidate and what kind of value it has."""

    def __init__(self, path: str):
        self.path = path
        self.kind = F.schema_of_variant(F.try_variant_get(F.col("_json"), f"$.{path}", "variant"))
        self.text = F.try_variant_get(F.col("_json"), f"$.{path}", "string")
        self.says = self.kind.isNotNull() & (self.kind != "VOID")
        self.blank = ~F.coalesce(self.says, F.lit(False)) | ((self.kind == "STRING") & (self.text == ""))

    def error(self, wrong: Column, problem: Column | str) -> Column:
        said = F.lit(problem) if isinstance(problem, str) else problem
        return F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(self.path).alias("field"), said.alias("problem")))

    def is_a(self, *kinds: str) -> Column:
        """Whether the value is of a kind, as far as its name goes: OBJECT<...> is an OBJECT."""
        return F.regexp_extract(F.coalesce(self.kind, F.lit("")), "^[A-Z]+", 0).isin(*kinds)


def _words(path: str) -> tuple[Column, list[Column]]:
    """A list of texts, stripped, in lower case, each once; and what is wrong with it."""
    f = _Field(path)
    items = F.try_variant_get(F.col("_json"), f"$.{path}", "array<variant>")
    odd = F.exists(items, lambda v: F.coalesce(F.schema_of_variant(v) != "STRING", F.lit(True)))
    cleaned = F.array_distinct(F.filter(F.transform(F.try_variant_get(F.col("_json"), f"$.{path}", _NONE), lambda x: F.lower(strip(x))), lambda x: x != ""))
    good = f.is_a("ARRAY") & ~F.coalesce(odd, F.lit(False))
    errors = [f.error(~f.blank & ~f.is_a("ARRAY"), "must be an array of strings"), f.error(f.is_a("ARRAY") & odd, "entries must be strings")]
    value = F.coalesce(F.when(good, cleaned), F.array().cast(_NONE))
    if path in ALLOWED:
        bad = F.array_sort(F.array_except(value, F.array(*[F.lit(x) for x in ALLOWED[path]])))
        errors.append(f.error(F.size(bad) > 0, F.concat(F.lit("contains unsupported values: "), F.array_join(bad, ", "))))
        value = F.when(F.size(bad) > 0, F.array().cast(_NONE)).otherwise(value)
    return value, errors


def _number(path: str) -> tuple[Column, list[Column]]:
    f = _Field(path)
    plain = strip(f.text)
    number = F.when(f.is_a("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), f.text.try_cast("double")).when(f.is_a("STRING") & plain.rlike(_NUMBER), plain.try_cast("double"))
    return number, [f.error(f.says & number.isNull(), "must be numeric")]


def _text(path: str, change) -> tuple[Column, list[Column]]:
    f = _Field(path)
    return F.when(~f.blank & f.is_a("STRING"), change(strip(f.text))), [f.error(~f.blank & ~f.is_a("STRING"), "must be a string")]


def _object(path: str) -> list[Column]:
    f = _Field(path)
    return [f.error(~f.blank & ~f.is_a("OBJECT"), "must be an object")]


def parsed_candidates(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """The rows with the columns that batch.best_matches takes, years_experience, the rest of the salary, and ``errors`` (field, problem).

    Errors come in the order of the fields; a candidate is good if there are none. A text that isn't a JSON object has one
    error, under an empty field. Absent fields, null and empty texts are fine but for profile_id. Columns of the rows stay unless they have the name of
    a result; a null text isn't an object.
    """
    whole = F.try_parse_json(raw)
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    # a field of what isn't an object isn't looked for
    base = rows.withColumn("_json", F.when(is_object, whole))
    name = _Field("profile_id")
    named = strip(name.text)
    lists = {"skills": "skills", "titles": "titles", "locations": "locations", "work_modes": "work_mode_preferences", "seniority": "seniority_targets", "employment": "employment_type_preferences", "authorized_locations": "visa_work_auth.authorized_locations"}
    words = {c: _words(p) for c, p in lists.items()}
    years, least, most = _number("years_experience"), _number("salary_targets.minimum"), _number("salary_targets.maximum")
    currency, interval = _text("salary_targets.currency", F.upper), _text("salary_targets.interval", F.lower)
    sponsor = _Field("visa_work_auth.requires_sponsorship")
    errors = [
        name.error(F.col("_json").isNotNull() & ~name.is_a("STRING"), "must be a string"), name.error(name.is_a("STRING") & (named == ""), "must be non-empty"),
        *words["skills"][1], *words["titles"][1], *years[1], *words["locations"][1], *words["work_modes"][1], *words["seniority"][1],
        *_object("salary_targets"), *least[1], *most[1], *currency[1], *interval[1],
        *_object("visa_work_auth"), sponsor.error(sponsor.says & ~sponsor.is_a("BOOLEAN"), "must be boolean"), *words["authorized_locations"][1], *words["employment"][1],
    ]
    not_object = F.array(F.struct(F.lit("").alias("field"), F.lit("must be an object").alias("problem")))
    out = {
        "profile_id": F.when(name.is_a("STRING"), F.nullif(F.lower(named), F.lit(""))), **{c: v for c, (v, _) in words.items()}, "years_experience": years[0], "salary_minimum": least[0], "salary_maximum": most[0],
        "salary_currency": currency[0], "salary_interval": interval[0], "requires_sponsorship": F.when(sponsor.is_a("BOOLEAN"), sponsor.text.try_cast("boolean")),
        "errors": F.when(F.col("_json").isNull(), not_object).otherwise(F.array_compact(F.array(*errors))),
    }
    stay = [F.col(f"`{c}`") for c in rows.columns if c not in out]
    return base.select(*stay, *[v.alias(c) for c, v in out.items()])
