"""The closed algebra of plans, and what the parser and the compiler pass on."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

PRIORITIES = ("high", "medium_high", "medium", "low_medium", "low")
IMPACT = {"high": "large", "medium_high": "large", "medium": "medium", "low_medium": "medium", "low": "small"}
SEVERITY = {"large": "error", "medium": "warning", "small": "info"}
SEVERITIES = ("critical", "error", "warning", "info")


def impact_of(priority: str | None) -> str:
    return IMPACT.get(priority or "medium", "medium")


def severity_of(priority: str | None) -> str:
    return SEVERITY[impact_of(priority)]


def priority_of(impact: str) -> str:
    return {"large": "high", "medium": "medium", "small": "low"}[impact]


@dataclass(frozen=True)
class SourceRule:
    id: str
    text: str
    enabled: bool = True
    order: int = 0


@dataclass(frozen=True)
class Binding:
    token: str
    status: str  # resolved, ambiguous or missing
    key: str | None = None
    header: str | None = None
    semantic: str = "unknown"
    role: str = "target"
    candidates: tuple = ()


@dataclass(frozen=True)
class When:
    """Scope: clauses (token, values) all of which, or any of which, must hold."""

    clauses: tuple[tuple[str, tuple[str, ...]], ...]
    any_of: bool = False


@dataclass(frozen=True)
class Predicate:
    operator: str
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    forbidden: bool = False
    case_sensitive: bool = True


@dataclass(frozen=True)
class Check:
    """A check of the closed set: columns_exist, required, value_check, format, same_fields, duplicate_fields, unique_any, weighted_duplicate."""

    kind: str
    targets: tuple[str, ...]
    when: When | None = None
    mode: str = "any"
    predicate: Predicate | None = None
    format: str | None = None
    normalized: bool = True
    exact_fields: tuple[str, ...] = ()
    weights: tuple[tuple[str, float], ...] = ()
    threshold: float | None = None

    def tokens(self) -> tuple[str, ...]:
        named = [*self.targets, *self.exact_fields, *(t for t, _ in self.weights), *(t for t, _ in (self.when.clauses if self.when else ()))]
        return tuple(dict.fromkeys(named))


@dataclass(frozen=True)
class Matcher:
    key: str
    operations: tuple[str, ...] = ()
    algorithm: str | None = None
    threshold: float = 0.9


@dataclass(frozen=True)
class Plan:
    """``kind``: business, duplicate, validation, missing, uniqueness or consistency."""

    kind: str
    keys: tuple[str, ...] = ()
    operations: tuple[tuple[str, ...], ...] = ()
    validator: str | None = None
    matchers: tuple[Matcher, ...] = ()
    any_of: bool = False
    check: Check | None = None
    fields: dict[str, str] = field(default_factory=dict)


@dataclass
class Interpretation:
    id: str
    text: str
    category: str
    status: str  # valid, needs_mapping, needs_configuration or unsupported
    fields: list[Binding] = field(default_factory=list)
    normalizations: tuple[str, ...] = ()
    any_of: bool = False
    algorithm: str = "jaro_winkler"
    threshold: float = 0.9
    validator: str | None = None
    check: Check | None = None
    severity: str = "warning"
    priority: str | None = None
    action: str | None = None
    confidence: float = 0.0
    warnings: list[str] = field(default_factory=list)
    gate: Any = None


@dataclass
class CompiledRule:
    interpretation: Interpretation
    plan: Plan | None

    @property
    def id(self) -> str:
        return self.interpretation.id


@dataclass
class Compilation:
    rules: list[CompiledRule]
    issues: list[tuple[str, str, str]]  # rule id, code, message
    policies: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def can_run(self) -> bool:
        return any(r.plan for r in self.rules)
