"""Differential dependencies and attribute thresholds: values that the planner works on."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

STRING, INT = "STRING", "INT"
OPERATORS = ("<=", ">")


@dataclass(frozen=True)
class Atom:
    """`attr` within (<=) or beyond (>) a distance."""

    attr: str
    op: str
    threshold: float

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"{self.attr}: operator {self.op!r} is none of {OPERATORS}")

    @property
    def near(self) -> bool:
        return self.op == "<="

    @property
    def equality(self) -> bool:
        """Distances are whole numbers, so a threshold from 0 to below 1 asks for distance 0."""
        return 0 <= self.threshold < 1


@dataclass(frozen=True)
class Dependency:
    """If all left atoms hold for two rows, the right one must. The left order matters to error selection."""

    left: tuple[Atom, ...]
    right: Atom

    @property
    def attrs(self) -> tuple[str, ...]:
        """Attributes in the order left, right; each once."""
        return tuple(dict.fromkeys([*(a.attr for a in self.left), self.right.attr]))


def dependency(left: Mapping[str, tuple[str, float]], right: tuple[str, tuple[str, float]]) -> Dependency:
    return Dependency(tuple(Atom(a, op, float(t)) for a, (op, t) in left.items()), Atom(right[0], right[1][0], float(right[1][1])))


def equal(left: Iterable[str] | str, right: str) -> Dependency:
    """Equal left attributes ask for an equal right one."""
    names = [left] if isinstance(left, str) else list(left)
    return dependency({a: ("<=", 0.0) for a in names}, (right, ("<=", 0.0)))


def parse_dependencies(text: str) -> list[Dependency]:
    """A Python literal: [({attr: (op, threshold), ...}, (attr, (op, threshold))), ...]. Literals only; nothing is executed."""
    return [dependency(left, right) for left, right in ast.literal_eval(text.strip())]


def parse_thresholds(text: str) -> dict[str, float]:
    """A Python literal {attr: probability threshold}."""
    return {str(k): float(v) for k, v in ast.literal_eval(text.strip()).items()}


def threshold_index(dependencies: Iterable[Dependency]) -> dict[str, list[float]]:
    """Each attribute's distance thresholds, both sides, descending."""
    found: dict[str, set[float]] = {}
    for d in dependencies:
        for a in (*d.left, d.right):
            found.setdefault(a.attr, set()).add(a.threshold)
    return {k: sorted(v, reverse=True) for k, v in found.items()}


def validate(dependencies: Iterable[Dependency], kinds: Mapping[str, str], columns: Iterable[str], taus: Mapping[str, float] | None = None) -> None:
    """Raise for attributes that are missing, have no distance kind or, where taus are given, no threshold."""
    columns = set(columns)
    for d in dependencies:
        for a in d.attrs:
            if a not in columns:
                raise ValueError(f"no column {a}")
            if kinds.get(a) not in (STRING, INT):
                raise ValueError(f"{a}: distance kind {kinds.get(a)!r} is none of STRING, INT")
            if taus is not None and a not in taus:
                raise ValueError(f"{a}: no probability threshold")
