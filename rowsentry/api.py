"""The public calls: profile, compile, analyze, review and export."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators import anomaly, findings
from .operators.executors import run_rules
from .operators.profile import ColumnProfile, profile
from .plans.compiler import compile_rules as compile_interpretations
from .plans.gate import IntentGate, admit
from .plans.language import interpret, parse_rules
from .plans.limits import check_configurations, check_finding, check_rules
from .plans.model import Compilation
from .sources.dataset import Dataset
from .sources.export import corrected_csv, reviewed_rows, reviewed_workbook
from .sources.versions import Sessions, SourceChangedError, check_source

__all__ = ["Analysis", "Dataset", "Sessions", "SourceChangedError", "analyze", "compile_rules", "corrected_csv", "finding_rows", "profile", "reviewed_rows", "reviewed_workbook", "scan_anomalies"]


class RuleError(ValueError):
    """Some rule can't run, so none does."""


@dataclass
class Analysis:
    dataset: Dataset
    compilation: Compilation
    findings: DataFrame
    warnings: list[str] = field(default_factory=list)

    def summary(self) -> DataFrame:
        return findings.summary(self.findings)

    def ordered(self) -> DataFrame:
        return findings.by_impact(self.findings)

    def groups(self) -> DataFrame:
        return findings.consolidate(self.findings)


def compile_rules(ds: Dataset, text: str, mappings: Mapping[str, str] | None = None, configurations: Mapping[str, Mapping] | None = None, disabled=(), gate: IntentGate | None = None) -> Compilation:
    """Parse, bind, review and compile; nothing runs. Inputs beyond their limits are refused."""
    check_rules(text, disabled, mappings)
    check_configurations(configurations)
    rules = [r for r in parse_rules(text, disabled) if r.enabled]
    its = [interpret(r, ds.headers, mappings, (configurations or {}).get(r.id), ds.semantic) for r in rules]
    if gate is not None:
        its = admit(its, gate)
    return compile_interpretations(its)


def analyze(ds: Dataset, text: str, gate: IntentGate, mappings: Mapping[str, str] | None = None, configurations: Mapping[str, Mapping] | None = None, on_progress: Callable[[str], None] | None = None, evidence_limit: int | None = None) -> Analysis:
    """Findings of all rules, lazily. A single rule with an issue stops the run, and so does a source whose files changed since it was loaded."""
    check_source(ds)
    compilation = compile_rules(ds, text, mappings, configurations, gate=gate)
    if compilation.issues or not compilation.can_run:
        raise RuleError("; ".join(f"{r}: {m}" for r, _, m in compilation.issues) or "No rule can run.")
    found = run_rules(ds, compilation.rules, evidence_limit, on_progress=on_progress)
    return Analysis(ds, compilation, found, ds.warnings)


def finding_rows(analysis: Analysis, finding: str, offset: int = 0) -> DataFrame:
    check_finding(finding, offset)
    check_source(analysis.dataset)
    return findings.source_rows(analysis.dataset, analysis.findings, finding, offset)


def scan_anomalies(ds: Dataset, profiles: list[ColumnProfile] | None = None) -> tuple[DataFrame, list[anomaly.Draft]]:
    return anomaly.scan(ds, profiles if profiles is not None else profile(ds))
