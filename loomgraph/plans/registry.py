"""The catalogue: named questions with their defaults and required parameters, and the registered queries with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` as a query, and its DuckDB twin."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            from loomgraph.plans import standin

            ORACLES[name] = standin.with_base(sql)
        return f

    return add


@dataclass(frozen=True)
class Question:
    """A question over (nodes, edges, ns): what it needs, what it takes by default, and how far numbers may go."""

    name: str
    run: Callable[..., DataFrame]
    defaults: Mapping[str, Any] = field(default_factory=dict)
    requires_one_of: tuple[str, ...] = ()
    clamps: Mapping[str, tuple[int, int]] = field(default_factory=dict)

    def __call__(self, nodes: DataFrame, edges: DataFrame, ns: str, /, **params: Any) -> DataFrame:
        # every question takes a limit and a version; those that have no use for them answer in full
        params = {k: v for k, v in params.items() if k in self.defaults or k not in ("limit", "version")}
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise TypeError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        merged = {**self.defaults, **params}
        if self.requires_one_of and not any(merged.get(k) not in (None, "") for k in self.requires_one_of):
            raise KeyError(f"{self.name} needs one of: {', '.join(self.requires_one_of)}")
        for k, (low, high) in self.clamps.items():
            try:
                merged[k] = max(low, min(int(merged[k]), high))
            except (TypeError, ValueError):
                merged[k] = self.defaults[k]
        return self.run(nodes, edges, ns, **merged)


class Catalogue:
    """Questions by name; an unknown name raises KeyError."""

    def __init__(self) -> None:
        self.questions: dict[str, Question] = {}

    def question(self, name: str, /, *, requires_one_of: tuple[str, ...] = (), clamps: Mapping[str, tuple[int, int]] | None = None, **defaults: Any):
        def add(f):
            self.questions[name] = Question(name, f, defaults, requires_one_of, clamps or {})
            return f

        return add

    def __getitem__(self, name: str) -> Question:
        if name not in self.questions:
            raise KeyError(f"unknown question {name!r}; known: {', '.join(sorted(self.questions))}")
        return self.questions[name]

    def ask(self, name: str, nodes: DataFrame, edges: DataFrame, ns: str, /, **params: Any) -> DataFrame:
        return self[name](nodes, edges, ns, **params)

    def describe(self) -> list[dict[str, Any]]:
        return [{"name": q.name, "params": dict(q.defaults), "requires_one_of": list(q.requires_one_of)} for q in self.questions.values()]


def parameter(text: str) -> None | bool | int | float | str:
    """A typed value from its text: null, true/false, whole number, number, or the text itself."""
    low = text.strip().lower()
    if low in ("null", "none"):
        return None
    if low in ("true", "false"):
        return low == "true"
    if re.fullmatch(r"[+-]?\d+", low):
        return int(low)
    try:
        return float(low)
    except ValueError:
        return text
