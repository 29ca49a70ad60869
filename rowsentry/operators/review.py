"""What a reviewer is told: who owns a finding, where it goes, what rules don't cover yet.

Routes and owners are DataFrame expressions. A model may choose among the routes that a finding
allows; without a sure and known choice the finding goes to a person.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import Compilation, Interpretation, priority_of
from ..sources.dataset import ROW, Dataset
from .profile import ColumnProfile

#: Fixed value: the confidence from which a model's choice counts.
SURE = 0.8
NEXT_STEPS = {
    "review_duplicate": "Compare the records with an authorized source before treating them as one.",
    "verify_source": "Check the value against an authorized source.",
    "complete_attribute": "Find the missing value in an authorized source and have it confirmed.",
    "check_relationship": "Check whether the records are related but distinct.",
    "review_rule": "Confirm the rule and its columns first.",
    "human_review": "Have a person look at the finding and its rows.",
}


def route(kind: str = "type") -> Column:
    """Where a finding goes without a model."""
    c = F.col(kind)
    return F.when(c.isin("DUPLICATE", "POSSIBLE_DUPLICATE"), "review_duplicate").when(c == "MISSING", "complete_attribute").when(c.isin("INVALID", "INCONSISTENT"), "verify_source").otherwise("human_review")


def owner(kind: str = "type") -> Column:
    c = F.col(kind)
    return F.when(c.isin("DUPLICATE", "POSSIBLE_DUPLICATE"), "Data steward and record owner").when(c.isin("MISSING", "INVALID"), "Record owner, with data steward review").otherwise("Data steward")


def effect(kind: str = "type") -> Column:
    """What a finding may spoil."""
    c = F.col(kind)
    return (
        F.when(c.isin("DUPLICATE", "POSSIBLE_DUPLICATE"), "Counts and sums may include a record twice.").when(c == "MISSING", "Processes that need the value may fail.")
        .when(c == "INVALID", "Processes that read the value may fail.").when(c.isin("INCONSISTENT", "UNIQUENESS_VIOLATION"), "Records may be grouped or reported wrongly.")
        .otherwise("The effect depends on the rule.")
    )


def guided(findings: DataFrame) -> DataFrame:
    out = findings.withColumn("route", route()).withColumn("owner", owner()).withColumn("effect", effect())
    steps = F.create_map(*[F.lit(x) for pair in NEXT_STEPS.items() for x in pair])
    return out.withColumn("next_step", steps[F.col("route")])


def allowed_routes(kind: str, differing: bool = False, rule_in_doubt: bool = False) -> list[str]:
    """The routes that a model may choose from; a person is always among them."""
    first = {"DUPLICATE": "review_duplicate", "POSSIBLE_DUPLICATE": "review_duplicate", "MISSING": "complete_attribute", "INVALID": "verify_source", "INCONSISTENT": "verify_source"}.get(kind, "human_review")
    more = ["verify_source"] if kind in ("MISSING", "DUPLICATE", "UNIQUENESS_VIOLATION", "NORMALIZATION_CONFLICT", "RULE_VIOLATION") else []
    more += ["check_relationship"] if kind == "POSSIBLE_DUPLICATE" and differing else []
    more += ["review_rule"] if rule_in_doubt else []
    return list(dict.fromkeys([first, *more, "human_review"]))


def chosen_route(choice, confidence, allowed: Sequence[str]) -> str:
    """A model's choice if it is allowed and sure, else a person."""
    sure = isinstance(confidence, (int, float)) and not isinstance(confidence, bool) and SURE <= confidence <= 1
    return choice if sure and choice in allowed else "human_review"


def comparison_signals(ds: Dataset, rows: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """For two rows: each column that both fill, and whether its values agree in lower case."""
    left, right = sorted(rows)
    text = F.create_map(*[x for k in keys for x in (F.lit(k), F.trim(ds.text(k)))])
    pair = ds.df.where(F.col(ROW).isin(left, right)).select(ROW, F.explode(text).alias("column", "value")).where(F.length("value") > 0)
    return pair.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("value")).alias("kinds")).where("n = 2").select("column", (F.col("kinds") == 1).alias("equal"))


def context_rows(ds: Dataset, rows: Sequence[int], keys: Sequence[str], most: int = 20, length: int = 300) -> DataFrame:
    """Some rows and columns for a reader, cells cut to ``length`` characters: a display, not an operator's input."""
    return ds.df.where(F.col(ROW).isin(list(rows)[:most])).select(ROW, *[F.substring(ds.text(k), 1, length).alias(k) for k in list(keys)[:most]]).orderBy(ROW)


@dataclass(frozen=True)
class Candidate:
    id: str
    kind: str
    label: str
    evidence: str


def coverage(profiles: Sequence[ColumnProfile], compilation: Compilation) -> list[Candidate]:
    """What a reviewer might look at next: up to three rules that don't run, three columns with blanks and two with many formats that no rule names; six in all."""
    named = {b.key for r in compilation.rules for b in r.interpretation.fields if b.status == "resolved"}
    free = [p for p in profiles if p.key not in named]
    blanks = sorted((p for p in free if p.non_empty and p.missing_rate >= 0.15), key=lambda p: -p.missing_rate)
    out = [Candidate(f"rule-{i}", "unresolved_rule", f"Rule {rule}", f"It doesn't run ({code.lower().replace('_', ' ')}).") for i, (rule, code, _) in enumerate(compilation.issues[:3])]
    out += [Candidate(f"missing-{p.key}", "unruled_missing", p.header, f"{round(100 * p.missing_rate)}% blank, and no rule names it.") for p in blanks[:3]]
    out += [Candidate(f"format-{p.key}", "format_variants", p.header, f"{len(p.format_variants)} formats, and no rule names it.") for p in [p for p in free if len(p.format_variants) >= 4][:2]]
    return out[:6]


def chosen_candidate(candidates: Sequence[Candidate], choice, confidence, truncated: bool = False) -> str | None:
    """A model's choice if it is a known candidate and sure."""
    sure = isinstance(confidence, (int, float)) and not isinstance(confidence, bool) and SURE <= confidence <= 1
    return choice if sure and not truncated and any(c.id == choice for c in candidates) else None


def current_finding(findings: DataFrame, finding: str, analysis: str, active: str):
    """A finding of the active analysis, or an error if the analysis has been run anew."""
    if analysis != active:
        raise LookupError("The analysis is no longer active.")
    found = findings.where(F.col("id") == finding).first()
    if found is None:
        raise LookupError("The finding is not part of the active analysis.")
    return found


def readiness(dataset: Dataset | None, rules: str, compilation: Compilation | None) -> dict[str, bool]:
    return {"dataset": dataset is not None, "rules": bool(rules.strip()), "plan": bool(compilation and compilation.can_run)}


def rule_messages(it: Interpretation, compilation: Compilation) -> list[str]:
    return list(dict.fromkeys([*it.warnings, *(m for rule, _, m in compilation.issues if rule == it.id)]))


def effective_priority(it: Interpretation, configuration: Mapping | None = None, impact: str | None = None) -> str:
    """The configured priority, else the impact's, else the rule's own, else medium."""
    return (configuration or {}).get("priority") or (priority_of(impact) if impact else it.priority or "medium")


def equal_weights(names: Sequence[str]) -> dict[str, float]:
    return {n: 1 / len(names) for n in names}


def condition_values(text: str) -> list[str]:
    """Values of a condition as typed: separated by commas, semicolons or lines."""
    return list(dict.fromkeys(v.strip() for v in text.replace(";", ",").replace("\n", ",").split(",") if v.strip()))
