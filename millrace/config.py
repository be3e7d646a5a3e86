"""Strict configuration of a corpus mix: unknown, missing and repeated entries raise."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import MISSING, dataclass, fields
from typing import Any

#: Record kinds, told apart by `kind` and not by a source's name.
KINDS = ("hf", "schemapile", "synsql")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    target_tokens: int
    path: str = ""
    text_field: str = "text"
    data_dir: str | None = None
    subset: str | None = None
    sample_docs: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ConfigError(f"{self.name}: kind must be one of {', '.join(KINDS)}")
        if self.target_tokens < 0 or self.sample_docs is not None and self.sample_docs < 0:
            raise ConfigError(f"{self.name}: budgets must not be negative")
        if self.data_dir and self.subset:
            raise ConfigError(f"{self.name}: give data_dir or subset, not both")


@dataclass(frozen=True)
class Mix:
    sources: tuple[Source, ...]

    def __post_init__(self) -> None:
        names = [s.name for s in self.sources]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise ConfigError(f"repeated sources: {', '.join(sorted(twice))}")


@dataclass(frozen=True)
class EvalSet:
    """A JSON array of examples, whole or a member of a zip file, whose fields are held out."""

    name: str
    path: str
    fields: tuple[str, ...]
    member: str | None = None
    expected_examples: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        if not self.fields:
            raise ConfigError(f"{self.name}: at least one field is needed")
        if self.expected_examples is not None and self.expected_examples < 0:
            raise ConfigError(f"{self.name}: expected_examples must not be negative")


def build(kind: type, given: Mapping[str, Any]) -> Any:
    """An instance of a dataclass out of a mapping with exactly its keys, those with a default optional."""
    known = {f.name: f for f in fields(kind)}
    unknown = sorted(set(given) - set(known))
    missing = sorted(n for n, f in known.items() if n not in given and f.default is MISSING and f.default_factory is MISSING)
    if unknown or missing:
        raise ConfigError(f"{kind.__name__}: unknown keys {unknown}, missing keys {missing}")
    return kind(**given)


def _entries(path: str) -> list[Mapping[str, Any]]:
    import yaml

    with open(path, encoding="utf-8") as file:
        data = yaml.safe_load(file)
    if not isinstance(data, Mapping) or set(data) != {"sources"} or not isinstance(data["sources"], list):
        raise ConfigError("a configuration holds one list, `sources`")
    return data["sources"]


def load_mix(path: str) -> Mix:
    return Mix(tuple(build(Source, s) for s in _entries(path)))


def load_eval_sets(path: str) -> tuple[EvalSet, ...]:
    found = tuple(build(EvalSet, s) for s in _entries(path))
    names = [s.name for s in found]
    if len(set(names)) < len(names):
        raise ConfigError("repeated evaluation sets")
    return found
