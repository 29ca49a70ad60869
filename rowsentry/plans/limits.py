"""Limits of what a caller may hand in; whatever breaks one is refused before anything runs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import ROW

#: The most characters, entries or rows of each kind of input.
MOST = {"rules": 100_000, "disabled": 5_000, "action": 2_000, "token": 200, "values": 100, "value": 256, "rows": 1_100_000, "name": 100, "description": 500, "path": 4_096, "sheet": 200, "question": 1_000, "columns": 8}
PRIORITIES, IMPACTS = ("low", "low_medium", "medium", "medium_high", "high"), ("small", "medium", "large")
_RULE_ID, _FINDING_ID = re.compile(r"rule-[0-9]+-[0-9a-z]+"), re.compile(r"finding-[0-9a-z]+")


class InputError(ValueError):
    """An input is out of its limits."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InputError(what)


def text(value, kind: str, least: int = 0) -> str:
    """A text of ``least`` characters or more without the white space around it, and no more than its kind may have."""
    _need(isinstance(value, str), f"{kind} must be a text.")
    _need(len(value.strip()) >= least, f"{kind} must not be blank.")
    _need(len(value) <= MOST[kind], f"{kind} has {len(value):,} characters; {MOST[kind]:,} are allowed.")
    return value


def check_rules(rules: str, disabled: Sequence[str] = (), mappings: Mapping[str, str] | None = None, impacts: Mapping[str, str] | None = None) -> None:
    text(rules, "rules")
    _need(len(disabled) <= MOST["disabled"] and all(disabled), f"At most {MOST['disabled']:,} rules can be disabled, each by its id.")
    _need(all((mappings or {}).values()), "A mapping names no column.")
    for rule, impact in (impacts or {}).items():
        _need(_RULE_ID.fullmatch(rule) is not None and impact in IMPACTS, f"{rule}: an impact is one of {', '.join(IMPACTS)}.")


def check_configurations(configurations: Mapping[str, Mapping] | None) -> None:
    """Overrides by rule id: priority, action, values of conditions, similarity."""
    for rule, c in (configurations or {}).items():
        _need(_RULE_ID.fullmatch(rule) is not None, f"{rule} is not the id of a rule.")
        if c.get("priority") is not None:
            _need(c["priority"] in PRIORITIES, f"{rule}: a priority is one of {', '.join(PRIORITIES)}.")
        if c.get("action") is not None:
            text(c["action"], "action", 1)
        for token, values in (c.get("condition_values") or {}).items():
            text(token, "token", 1)
            _need(len(values) <= MOST["values"], f"{rule}: {token} has more than {MOST['values']} values.")
            for v in values:
                text(v, "value", 1)
        similarity = c.get("similarity") or {}
        parts = [*([similarity["threshold"]] if "threshold" in similarity else []), *(similarity.get("weights") or {}).values()]
        _need(all(isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1 for x in parts), f"{rule}: thresholds and weights lie between 0 and 1.")


def check_finding(finding: str, offset: int = 0) -> None:
    _need(isinstance(finding, str) and _FINDING_ID.fullmatch(finding) is not None, f"{finding!r} is not the id of a finding.")
    _need(isinstance(offset, int) and not isinstance(offset, bool) and offset >= 0, "An offset is a whole number from 0 on.")


def check_columns(keys: Sequence[str]) -> None:
    _need(len(keys) <= MOST["columns"] and len(set(keys)) == len(keys), f"At most {MOST['columns']} different columns can be shown.")
    for k in keys:
        text(k, "token", 1)


def check_project(name: str, description: str = "") -> None:
    text(name, "name", 1)
    text(description, "description")


def check_rows(rows: DataFrame) -> None:
    """Row numbers of a decision: whole numbers within a sheet, none named twice; counted on the cluster."""
    within = F.count_if(F.col(ROW).between(1, MOST["rows"]))
    n, good, kinds = rows.select(F.col(ROW).cast("long").alias(ROW)).groupBy(ROW).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), within, F.count(F.lit(1))).first()
    _need(good == kinds, f"Row numbers lie between 1 and {MOST['rows']:,}.")
    _need(n == kinds, "A row is named twice.")
