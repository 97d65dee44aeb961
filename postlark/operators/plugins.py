"""Table-to-table plugins: functions named by ``module:function`` that run after a stage's own steps, in order."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import get_type_hints

from pyspark.sql import DataFrame

from .contract import CANONICAL

KINDS = ("filter", "label", "rate")


class PluginError(ValueError):
    """A plugin that can't be loaded, has the wrong signature, fails, or gives no valid frame."""


@dataclass(frozen=True)
class Context:
    """What a plugin is told: its own name and kind, its settings (which it can't change) and the stage's options."""

    name: str
    kind: str
    settings: Mapping
    options: Mapping


@dataclass(frozen=True)
class Plugin:
    name: str
    kind: str
    run: Callable[[DataFrame, Context], DataFrame]
    order: int = 0
    settings: Mapping = field(default_factory=dict)


def frozen(value):
    """The same value with mappings, lists and sets that can't be changed."""
    if isinstance(value, Mapping):
        return MappingProxyType({k: frozen(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return tuple(map(frozen, value))
    return frozenset(value) if isinstance(value, (set, frozenset)) else value


def resolve(reference: str) -> Callable:
    module, _, name = reference.partition(":")
    if not module or not name:
        raise PluginError(f"{reference!r} isn't module:function")
    try:
        found = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise PluginError(f"can't load {reference!r}: {e}") from e
    if not callable(found):
        raise PluginError(f"{reference!r} isn't a function")
    return found


def checked(name: str, kind: str, f: Callable) -> Callable:
    """Refuses functions that aren't (DataFrame, Context) -> DataFrame by their annotations."""
    if kind not in KINDS:
        raise PluginError(f"plugin {name!r} has no known kind: {kind!r}")
    try:
        hints, parameters = get_type_hints(f), list(inspect.signature(f).parameters.values())
    except Exception as e:
        raise PluginError(f"plugin {name!r} has annotations that can't be read: {e}") from e
    positional = [p for p in parameters[:2] if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    if len(positional) < 2:
        raise PluginError(f"plugin {name!r} must take a frame and a context")
    if [hints.get(p.name) for p in positional] != [DataFrame, Context] or hints.get("return") is not DataFrame:
        raise PluginError(f"plugin {name!r} must be annotated (DataFrame, Context) -> DataFrame")
    return f


def load(manifest: list[Mapping]) -> tuple[Plugin, ...]:
    """Plugins by kind, order and name. An entry has name, kind, callable, and maybe enabled, order, settings.

    Disabled entries are dropped unseen; two of one kind and name are refused.
    """
    out: dict[tuple[str, str], Plugin] = {}
    for item in manifest:
        if unknown := set(item) - {"name", "kind", "callable", "enabled", "order", "settings"}:
            raise PluginError(f"unknown keys of a plugin: {sorted(unknown)}")
        name, kind = item["name"], item["kind"]
        if (kind, name) in out:
            raise PluginError(f"two {kind} plugins are named {name!r}")
        if item.get("enabled", True):
            run = item["callable"] if callable(item["callable"]) else resolve(item["callable"])
            out[kind, name] = Plugin(name, kind, checked(name, kind, run), int(item.get("order", 0)), frozen(item.get("settings", {})))
    return tuple(sorted(out.values(), key=lambda p: (p.kind, p.order, p.name)))


def apply(df: DataFrame, plugins: tuple[Plugin, ...], kind: str, options: Mapping | None = None) -> DataFrame:
    """The frame after all plugins of a kind.

    What a plugin returns is looked at by its schema: it must be a frame that keeps the canonical columns with
    their types. Errors of single rows only show when the plan runs.
    """
    for p in plugins:
        if p.kind != kind:
            continue
        before = dict(df.dtypes)
        try:
            out = p.run(df, Context(p.name, kind, p.settings, frozen(options or {})))
        except Exception as e:
            raise PluginError(f"{kind} plugin {p.name!r} failed: {e}") from e
        if not isinstance(out, DataFrame):
            raise PluginError(f"{kind} plugin {p.name!r} gave no frame but {type(out).__name__}")
        after = dict(out.dtypes)
        if wrong := [c for c in CANONICAL if c in before and after.get(c) != before[c]]:
            raise PluginError(f"{kind} plugin {p.name!r} lost or changed {wrong}")
        df = out
    return df
