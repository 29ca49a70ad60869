"""Interpretations to plans: policies first, then one plan for each valid rule."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions.normalize import merge_operations
from .model import CompiledRule, Compilation, Interpretation, Matcher, Plan


def compile_rules(interpretations: Iterable[Interpretation]) -> Compilation:
    """Normalization rules have no plan; they say how the columns that they name are compared elsewhere."""
    interpretations = list(interpretations)
    policies: dict[str, tuple[str, ...]] = {}
    for it in interpretations:
        if it.category == "normalization" and it.status == "valid":
            for b in it.fields:
                policies[b.key] = merge_operations(b.semantic, policies.get(b.key, ()), it.normalizations)
    out = Compilation([], [], policies)
    for it in interpretations:
        plan = None
        if it.status == "valid":
            plan = plan_of(it, policies)
            if plan is None and it.category != "normalization":
                out.issues.append((it.id, "INVALID_RULE", "The rule has no complete plan."))
        elif it.status == "needs_mapping":
            out.issues += [(it.id, "AMBIGUOUS_FIELD" if b.status == "ambiguous" else "MISSING_FIELD", f"The column {b.token} is {b.status}.") for b in it.fields if b.status != "resolved"]
        else:
            out.issues.append((it.id, "INVALID_RULE" if it.status == "needs_configuration" else "UNSUPPORTED_RULE", " ".join(it.warnings)))
        out.rules.append(CompiledRule(it, plan))
    return out


def plan_of(it: Interpretation, policies: dict[str, tuple[str, ...]]) -> Plan | None:
    bound = [b for b in it.fields if b.status == "resolved"]
    if it.check is not None:
        fields = {b.token: b.key for b in bound}
        targets = [fields[t] for t in it.check.targets if t in fields]
        if len(set(targets)) < len(targets) and it.check.kind in ("same_fields", "duplicate_fields"):
            return None
        return Plan("business", fields=fields, check=it.check)
    ops = lambda b, *more: merge_operations(b.semantic, policies.get(b.key, ()), *more)
    if not bound:
        return None
    if it.category in ("duplicate", "similarity"):
        fuzzy = lambda b: it.algorithm if it.category == "similarity" and b.semantic == "name" else None
        return Plan("duplicate", matchers=tuple(Matcher(b.key, ops(b, it.normalizations), fuzzy(b), it.threshold) for b in bound), any_of=it.any_of)
    if it.category == "validation" and it.validator:
        return Plan("validation", (bound[0].key,), validator=it.validator)
    if it.category == "missing":
        return Plan("missing", (bound[0].key,))
    if it.category == "uniqueness":
        return Plan("uniqueness", (bound[0].key,), (ops(bound[0], it.normalizations),))
    if it.category == "consistency" and len(bound) > 1:
        return Plan("consistency", (bound[0].key, bound[1].key), (ops(bound[0]), ops(bound[1])))
    return None
