"""Models that a caller may plug in where the library has a plain default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

#: embed: text -> array<double>; ner: text -> array of entities (operators.anonymise.ENTITY); severity: text -> struct<severity, score>
NAMES = ("embed", "ner", "severity")
HOOKS: dict[str, Callable[[Column], Column]] = {}


def register_hook(name: str, f: Callable[[Column], Column] | None) -> None:
    """Use f, a function of a text column (say, a pandas UDF), wherever the library asks for this model; None removes it."""
    if name not in NAMES:
        raise ValueError(f"no hook is named {name}")
    HOOKS[name] = f
    if f is None:
        del HOOKS[name]


def hook(name: str, default: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return HOOKS.get(name, default)
