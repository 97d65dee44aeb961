"""Whole runs: a configured run from any source to ranked postings; pulls of records are in ``sync``."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import contract, plugins, stages
from ..functions.text import clipped


@dataclass(frozen=True)
class Config:
    """What a run does; the defaults are those of an empty configuration."""

    fields: Mapping[str, contract.Field] = field(default_factory=dict)
    aliases: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    clean: Mapping = field(default_factory=dict)
    filter: Mapping = field(default_factory=dict)
    rate: Mapping = field(default_factory=dict)
    top_k: int = 100
    stages: tuple[str, ...] = ("clean", "filter", "label", "rate", "match")
    plugins: tuple[plugins.Plugin, ...] = ()


@dataclass(frozen=True)
class Run:
    """The scored frame, the plan of applications, counters of the adapter and of aliases, and rows of each stage.

    Counters are frames of one row; stage rows are observed while the result is computed, and can be read
    (``rows()``) after the first action on it.
    """

    scored: DataFrame
    applications: DataFrame | None
    adapter: DataFrame | None
    alias_conflicts: DataFrame
    observed: Mapping[str, Observation]

    def rows(self) -> dict[str, int]:
        return {name: o.get["rows"] for name, o in self.observed.items()}


def run(source: DataFrame, config: Config | None = None) -> Run:
    """Adapt, resolve aliases, conform, clean, filter, label, rate and match, as one plan; no job is started."""
    config = config or Config()
    if config.top_k < 1:
        raise ValueError("top_k must be 1 or more")
    adapted, errors = contract.adapt(source, dict(config.fields)) if config.fields else (source, None)
    named, conflicts = contract.resolve_aliases(adapted, contract.Aliases(dict(config.aliases)))
    df = contract.conform(contract.check(named))
    observed: dict[str, Observation] = {}

    def seen(name: str, frame: DataFrame) -> DataFrame:
        observed[name] = Observation(name)
        return frame.observe(observed[name], F.count(F.lit(1)).alias("rows"))

    df, applications = seen("input", df), None
    for stage in config.stages:
        if stage == "clean":
            df = stages.clean(df, **config.clean)
        elif stage == "filter":
            df = plugins.apply(stages.keep(df, **config.filter), config.plugins, "filter", config.filter)
        elif stage == "label":
            df = plugins.apply(stages.label(df), config.plugins, "label")
        elif stage == "rate":
            df = plugins.apply(stages.rate(df, **config.rate), config.plugins, "rate", config.rate)
            df = df.withColumns({c: clipped(F.col(c)) for c in ("rate_completeness", "rate_quality", "rate_composite") if c in df.columns})
        elif stage == "match":
            df = stages.match(df, config.top_k)
            applications = stages.plan(df)
        else:
            raise ValueError(f"no stage {stage!r}")
        df = seen(stage, df) if stage != "match" else df
    return Run(df, applications, errors, conflicts, observed)
