"""Rule executors: plans as lazy findings.

Row-local plans of a run are fused into one scan. Grouping plans shuffle on their keys once, with
partial aggregation. Fuzzy plans join within blocks behind sound bounds and close pairs
transitively.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.cells import trim_ws
from ..functions.normalize import business_literal, business_value, normalize
from ..functions.validate import REASONS, is_valid, matches_format, matches_predicate
from ..plans.model import Check, CompiledRule, Plan, When
from ..sources.dataset import ROW, Dataset
from ..sources.shared import materialize
from .findings import EVIDENCE, SCHEMA, evidence, finish
from .fuzzy_join import Field, similar_pairs
from .graph import connected_components
from .long_form import Bounded, LongFindings, collect_bounded, long_findings
from .ranks import numbered, running_sum
from .row_links import exact_links, weighted_links

PAIR_LIMIT, WEIGHTED_LIMIT, ONE_BLOCK = 2_000_000, 5_000_000, 5_000
#: Values of a field that are compared with each other one by one, at most. Pairs of classes that a task compares, and
#: that are compared without asking how many of them match; of more, one in ``WORTH`` has to. Classes that are asked.
FEW_VALUES, TASK_PAIRS, FREE_PAIRS, WORTH, ASKED = 1024, 1 << 19, 1 << 22, 20, 512
#: Pairs of rows that are counted without asking: they are compared together, not made.
FREE_COUNTED = 1 << 34
#: Tasks of a join of pairs, at least and at most: its tables are small and what it makes of them isn't.
LEAST_TASKS, MOST_TASKS = 64, 4096
#: Business checks that look at one row at a time.
ROW_LOCAL = ("required", "value_check", "format", "same_fields")


class PairLimitError(ValueError):
    """A weighted check would compare more pairs than its guard allows; nothing has been compared."""


def scope(ds: Dataset, when: When | None, fields: dict[str, str]) -> Column:
    if when is None:
        return F.lit(True)
    clauses = [business_value(ds.text(fields[t]), t).isin(*[business_literal(v, t) for v in values]) for t, values in when.clauses]
    return reduce((lambda a, b: a | b) if when.any_of else (lambda a, b: a & b), clauses)


def _struct(ds: Dataset, rule: CompiledRule, kind: str, flagged: Column, cells: list[tuple[str, Column, Column]], comparator: str, explanation: str) -> Column:
    """A finding of one row where ``flagged``; ``cells``: key, whether it is affected, normalized text."""
    it = rule.interpretation
    touched = F.filter(F.array(*[F.when(hit, evidence(ds, key, norm, comparator)) for key, hit, norm in cells]), lambda e: e.isNotNull())
    return F.when(flagged, F.struct(
        F.lit(rule.id).alias("rule_id"), F.lit(kind).alias("type"), F.lit(it.severity).alias("severity"), touched.cast(f"array<{EVIDENCE}>").alias("evidence"),
        F.lit(explanation).alias("explanation"), F.lit(it.priority).cast("string").alias("priority"), F.lit(it.action).cast("string").alias("action"),
    ))


def row_finding(ds: Dataset, rule: CompiledRule) -> Column:
    plan = rule.plan
    if plan.kind == "validation":
        key = plan.keys[0]
        return _struct(ds, rule, "INVALID", ~is_valid(plan.validator, ds.text(key)), [(key, F.lit(True), trim_ws(ds.text(key)))], plan.validator, REASONS[plan.validator])
    if plan.kind == "missing":
        key = plan.keys[0]
        return _struct(ds, rule, "MISSING", ds.missing(key), [(key, F.lit(True), F.lit(""))], "required", f"{ds.headers[key]} has no value.")
    check, fields = plan.check, plan.fields
    inside = scope(ds, check.when, fields)
    keys = [fields[t] for t in check.targets]
    shown = [business_value(ds.text(k), t) for t, k in zip(check.targets, keys, strict=True)]
    if check.kind == "required":
        gone = [F.length(v) == 0 for v in shown]
        flagged = reduce((lambda a, b: a & b) if check.mode == "all" else (lambda a, b: a | b), gone)
        return _struct(ds, rule, "MISSING", inside & flagged, list(zip(keys, gone, shown, strict=True)), "required", f"A value is required in {', '.join(check.targets)}.")
    if check.kind == "same_fields":
        texts = [trim_ws(ds.text(k)) for k in keys]
        flagged = F.size(F.array_distinct(F.array(*texts))) > 1
        return _struct(ds, rule, "INCONSISTENT", inside & flagged, [(k, F.lit(True), t) for k, t in zip(keys, texts, strict=True)], "same_fields", f"{', '.join(check.targets)} differ within the row.")
    if check.kind == "format":
        good = [matches_format(check.format, ds.text(k)) for k in keys]
        what = f"The value is not in the format {check.format}."
    else:
        p = check.predicate
        good = [matches_predicate(p.operator, ds.text(k), p.values, p.low, p.high, p.forbidden, not p.case_sensitive, ds.number(k)) for k in keys]
        what = "The value breaks the rule's condition."
    bad = [~g for g in good]
    return _struct(ds, rule, "INVALID", inside & reduce(lambda a, b: a | b, bad), list(zip(keys, bad, shown, strict=True)), check.kind, what)


def is_row_local(plan: Plan) -> bool:
    return plan.kind in ("validation", "missing") or plan.kind == "business" and plan.check.kind in ROW_LOCAL


def run_row_local(ds: Dataset, rules: Sequence[CompiledRule]) -> DataFrame:
    """All row-local rules in one scan, with only the columns that they name. Works on a stream as well."""
    from .findings import DEFAULT_ACTION, finding_id

    each = F.filter(F.array(*[row_finding(ds, r) for r in rules]), lambda f: f.isNotNull())
    found = ds.df.select(ROW, F.explode(each).alias("f")).select(ROW, "f.*")
    found = found.withColumn("rows", F.array(ROW)).withColumn("fields", F.transform("evidence", lambda e: e["column_header"]))
    return found.select(
        finding_id(F.col("type"), F.col("rule_id"), F.col("rows")).alias("id"), "rule_id", "type", "severity", F.lit("HIGH").alias("confidence"), F.lit("rows").alias("scope"),
        "rows", "fields", "evidence", "explanation", "priority", F.coalesce("action", F.lit(DEFAULT_ACTION)).alias("action"),
    )


def _collected(members: DataFrame, by: Sequence[str], headers: Sequence[str], evidence_limit: int | Bounded | None) -> DataFrame:
    """Groups as findings: sorted rows and their evidence, of at most ``evidence_limit`` rows if given.

    With a ``Bounded`` limit a group's row doesn't hold all its rows either; see ``long_form``.
    """
    if isinstance(evidence_limit, Bounded):
        out = collect_bounded(members, by, evidence_limit)
        return out.select(*by, "group", "n_rows", "rows", F.array(*map(F.lit, headers)).alias("fields"), F.flatten(F.transform("m", lambda x: x["cells"])).cast(f"array<{EVIDENCE}>").alias("evidence"))
    # the rows on their own, so that evidence that nobody reads is never gathered
    shown = F.array_sort(F.collect_list(F.struct(F.col(ROW).alias("row"), "cells")))
    out = members.groupBy(*by).agg(F.array_sort(F.collect_list(ROW)).alias("rows"), shown.alias("m"))
    cells = F.col("m") if evidence_limit is None else F.slice("m", 1, evidence_limit)
    return out.select(*by, "rows", F.array(*map(F.lit, headers)).alias("fields"), F.flatten(F.transform(cells, lambda x: x["cells"])).cast(f"array<{EVIDENCE}>").alias("evidence"))


def group_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose keys occur more than once. The counts are combined before the shuffle, and the rows are then joined to the few keys that repeat.

    Keys are counted by two hashes of 64 bits; whoever groups the rows does so by the keys themselves.
    """
    hashed = df.withColumns({"h1": F.xxhash64(*keys), "h2": F.xxhash64(F.lit("2"), *keys)})
    twice = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return hashed.join(twice, ["h1", "h2"], "left_semi").drop("h1", "h2")


def _same_key(ds: Dataset, rule: CompiledRule, keyed: list[tuple[str, Column]], kind: str, confidence: str, comparator: str, explanation: str, limit, id_key=None) -> DataFrame:
    names = [f"k{i}" for i in range(len(keyed))]
    if limit == 0:
        # nobody wants evidence: rows meet by two hashes of their keys, which are computed once and not shuffled
        df = ds.df.select(ROW, *[norm.alias(n) for n, (_, norm) in zip(names, keyed, strict=True)])
        filled = reduce(lambda a, b: a & b, [F.length(n) > 0 for n in names])
        # a filter before the hashes would compute the keys once more
        hashed = df.select(F.when(filled, F.col(ROW)).alias(ROW), F.xxhash64(*names).alias("h1"), F.xxhash64(F.lit("2"), *names).alias("h2"))
        groups = hashed.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(ROW)).alias("rows")).where(F.size("rows") > 1)
        groups = groups.select("rows", F.array(*[F.lit(ds.headers[k]) for k, _ in keyed]).alias("fields"), F.array().cast(f"array<{EVIDENCE}>").alias("evidence"))
        return finish(groups, rule, kind, confidence, explanation, id_key=id_key)
    cells = F.array(*[evidence(ds, key, norm, comparator) for key, norm in keyed])
    df = ds.df.select(ROW, *[norm.alias(n) for n, (_, norm) in zip(names, keyed, strict=True)], cells.alias("cells"))
    df = df.where(reduce(lambda a, b: a & b, [F.length(n) > 0 for n in names]))
    groups = _collected(group_members(df, names), names, [ds.headers[k] for k, _ in keyed], limit)
    return finish(groups, rule, kind, confidence, explanation, id_key=id_key)


def uniqueness(ds: Dataset, rule: CompiledRule, limit=None) -> DataFrame:
    key = rule.plan.keys[0]
    return _same_key(ds, rule, [(key, normalize(ds.text(key), rule.plan.operations[0]))], "UNIQUENESS_VIOLATION", "HIGH", "unique", f"{ds.headers[key]} repeats.", limit)


def consistency(ds: Dataset, rule: CompiledRule, limit=None) -> DataFrame:
    """Keys with more than one value of the dependent field (blanks apart); all rows of such a key."""
    (key, dep), (kops, dops) = rule.plan.keys, rule.plan.operations
    k, d = normalize(ds.text(key), kops), normalize(ds.text(dep), dops)
    cells = F.array(evidence(ds, key, k, "key"), evidence(ds, dep, d, "dependent"))
    df = ds.df.select(ROW, k.alias("k0"), d.alias("d"), cells.alias("cells")).where(F.length("k0") > 0)
    split = df.where(F.length("d") > 0).groupBy("k0").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").select("k0")
    groups = _collected(df.join(split, "k0", "left_semi"), ["k0"], [ds.headers[key], ds.headers[dep]], limit)
    return finish(groups, rule, "INCONSISTENT", "HIGH", f"One {ds.headers[key]} has different values of {ds.headers[dep]}.")


def unique_any(ds: Dataset, rule: CompiledRule, limit=None) -> DataFrame:
    """Each target on its own, all of them in one shuffle."""
    check, fields = rule.plan.check, rule.plan.fields
    each = [F.struct(F.lit(t).alias("token"), trim_ws(ds.text(fields[t])).alias("value"), F.array(evidence(ds, fields[t], trim_ws(ds.text(fields[t])), "unique_any")).alias("cells")) for t in check.targets]
    df = ds.df.select(ROW, F.explode(F.array(*each)).alias("x")).select(ROW, "x.*").where(F.length("value") > 0)
    groups = _collected(group_members(df, ["token", "value"]), ["token", "value"], [], limit)
    header = F.create_map(*[F.lit(x) for t in check.targets for x in (t, ds.headers[fields[t]])])
    groups = groups.withColumn("fields", F.array(header[F.col("token")]))
    out = finish(groups, rule, "UNIQUENESS_VIOLATION", "HIGH", "A value appears on more than one record.")
    return out


def duplicate_fields(ds: Dataset, rule: CompiledRule, limit=None) -> DataFrame:
    check, fields = rule.plan.check, rule.plan.fields
    keyed = [(fields[t], business_value(ds.text(fields[t]), t) if check.normalized else trim_ws(ds.text(fields[t]))) for t in check.targets]
    return _same_key(ds, rule, keyed, "DUPLICATE", "HIGH", "duplicate_fields", f"The combination of {' and '.join(check.targets)} repeats.", limit, f"{rule.id}:{'|'.join(check.targets)}")


def _stars(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges from every row of a repeating key to its first row."""
    first = materialize(df.groupBy(*keys).agg(F.min(ROW).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hubs")
    return df.join(first, list(keys)).select(F.col(ROW).alias("u"), "v").where("u <> v")


def _values(ds: Dataset, plan: Plan) -> tuple[DataFrame, list[str], list[str]]:
    """Rows with their matchers' values, without those that lack an exact one; the names of all and of the exact ones."""
    names = [f"m{i}" for i in range(len(plan.matchers))]
    exact = [n for n, m in zip(names, plan.matchers, strict=True) if not m.algorithm]
    df = materialize(ds.df.select(ROW, *[normalize(ds.text(m.key), m.operations).alias(n) for n, m in zip(names, plan.matchers, strict=True)]), "fuzzy")
    return df.where(reduce(lambda a, b: a & b, [F.length(n) > 0 for n in exact], F.lit(True))), names, exact


def _blocked(ds: Dataset, plan: Plan) -> tuple[DataFrame, list[str]]:
    """Rows with their matchers' values and the block within which a capped plan compares them: equal exact values, or one
    block for few rows, or the first letter and a quarter of the length of the first fuzzy value."""
    df, names, exact = _values(ds, plan)
    if exact:
        return df.withColumn("block", F.concat_ws("\u0000", *exact)), names
    lead = names[next(i for i, m in enumerate(plan.matchers) if m.algorithm)]
    few = df.count() <= ONE_BLOCK
    return df.withColumn("block", F.lit("all") if few else F.concat_ws(":", F.lower(F.substring(lead, 1, 1)), F.floor(F.length(lead) / 4).cast("string"))), names


def _matches(pairs: DataFrame, plan: Plan, names: list[str]) -> DataFrame:
    """Of pairs of rows (columns under ``l_`` and ``r_``) those that a fuzzy plan matches; cheap bounds come first."""
    tests, bounds = [], []
    for n, m in zip(names, plan.matchers, strict=True):
        a, b = F.col(f"l_{n}"), F.col(f"r_{n}")
        filled = (F.length(a) > 0) & (F.length(b) > 0)
        if m.algorithm == "token_jaccard":
            bound = test = sim.set_jaccard(F.col(f"l_w_{n}"), F.col(f"r_w_{n}")) >= m.threshold
        elif m.algorithm == "levenshtein":
            bound = test = sim.may_reach(m.algorithm, a, b, m.threshold)  # decides by itself
        elif m.algorithm:
            bound, test = sim.may_reach(m.algorithm, a, b, m.threshold), sim.reaches(m.algorithm, a, b, m.threshold)
        else:
            bound = test = a == b
        tests.append(filled & test)
        bounds.append(filled & bound)
    join = (lambda a, b: a | b) if plan.any_of else (lambda a, b: a & b)
    again = any(m.algorithm and m.algorithm not in ("levenshtein", "token_jaccard") for m in plan.matchers)
    pairs = pairs.where(reduce(join, bounds))
    return pairs.where(reduce(join, tests)) if again else pairs


def _with_words(df: DataFrame, plan: Plan, names: list[str]) -> DataFrame:
    """Words are split once a row, not once a pair."""
    return df.withColumns({f"w_{n}": sim.word_set(F.col(n)) for n, m in zip(names, plan.matchers, strict=True) if m.algorithm == "token_jaccard"})


def _capped(df: DataFrame, plan: Plan, names: list[str], pair_limit: int) -> DataFrame:
    """Pairs of rows within a block that match, of the first ``pair_limit`` pairs in the order of blocks and rows.

    A row whose first pair is beyond the limit doesn't enter the join, so no more pairs are made than
    the limit and one row's partners.
    """
    df = _with_words(df, plan, names)
    i, j, n = F.col("l_at").cast("long"), F.col("r_at").cast("long"), F.col("l_n")
    before = F.col("l_before") + i * (2 * n - i - 1) / 2
    left, right = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side in "lr")
    pairs = left.where(before < pair_limit).join(right, (F.col("l_block") == F.col("r_block")) & (F.col("l_at") < F.col("r_at")))
    return _matches(pairs.where(before + (j - i) <= pair_limit), plan, names)


def _all_matching(df: DataFrame, plan: Plan, names: list[str]) -> DataFrame:
    """All pairs of rows of ``df`` that match, ``(u, v)`` and both their ``rows`` if ``df`` has them: within equal exact values, else of all rows.

    Signatures find the candidates: of one fuzzy matcher after the other where all must match, of each alone where any may.
    """
    df = _with_words(df, plan, names)
    exact = [n for n, m in zip(names, plan.matchers, strict=True) if not m.algorithm]
    fields = sorted((Field(n, m.algorithm, m.threshold) for n, m in zip(names, plan.matchers, strict=True) if m.algorithm), key=lambda f: -f.threshold)
    swap, more = F.col(f"l_{ROW}") > F.col(f"r_{ROW}"), [c for c in ("rows",) if c in df.columns]
    ends = lambda c, u, v: (F.when(swap, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(u), F.when(swap, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(v))
    accept = lambda pairs: _matches(pairs, plan, names).select(*ends(ROW, "u", "v"), *[e for c in more for e in ends(c, f"{c}_u", f"{c}_v")])
    if not plan.any_of:
        return similar_pairs(df, fields, accept, exact)
    if exact:  # whoever shares the exact values matches by them
        return similar_pairs(df, [], accept, exact)
    return reduce(DataFrame.union, [similar_pairs(df.where(F.length(f.column) > 0), [f], accept) for f in fields]).distinct()


def duplicate_classes(ds: Dataset, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """A fuzzy plan over classes of rows with the same values, so that each pair of values is compared once.

    Returns the rows with the first row of their class, ``(_row, first)``, and the pairs of classes that match,
    ``(u, v, rows_u, rows_v)``. Rows of one class match each other. All matching pairs are found, of any number of rows.
    """
    df, names, _ = _values(ds, plan)
    filled = reduce((lambda a, b: a | b) if plan.any_of else (lambda a, b: a & b), [F.length(n) > 0 for n in names])
    df = df.where(filled)
    classes = materialize(df.groupBy(*names).agg(F.min(ROW).alias(ROW), F.count(F.lit(1)).alias("rows")), "classes")
    members = df.join(classes.select(*names, F.col(ROW).alias("first")), names).select(ROW, "first")
    return members, _all_matching(classes, plan, names).select("u", "v", "rows_u", "rows_v")


def duplicate_edges(ds: Dataset, plan: Plan, pair_limit: int | None = PAIR_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Edges that close a duplicate plan's groups, and whether the pair ceiling cut them short (one row).

    With a ceiling, fuzzy edges are the matching pairs of rows in the order of their blocks; without one, they are stars
    within classes of equal values and the matching pairs of classes.
    """
    none_cut = ds.df.sparkSession.range(1).select(F.lit(False).alias("cut"))
    if not any(m.algorithm for m in plan.matchers):
        names = [f"m{i}" for i in range(len(plan.matchers))]
        df = ds.df.select(ROW, *[normalize(ds.text(m.key), m.operations).alias(n) for n, m in zip(names, plan.matchers, strict=True)])
        if plan.any_of:
            return reduce(DataFrame.union, [_stars(df.where(F.length(n) > 0).select(ROW, n), [n]) for n in names]), none_cut
        return _stars(df.where(reduce(lambda a, b: a & b, [F.length(n) > 0 for n in names])), names), none_cut
    if pair_limit is None:
        members, pairs = duplicate_classes(ds, plan)
        return pairs.select("u", "v").union(members.where(F.col(ROW) != F.col("first")).select(F.col(ROW), "first")), none_cut
    df, names = _blocked(ds, plan)
    stats = df.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    stats, total = running_sum(stats, [F.col("first")], "pairs", "before")
    cut = ds.df.sparkSession.range(1).select(F.lit(total > pair_limit).alias("cut"))
    reached = stats.where(F.col("before") < pair_limit).select("block", "n", "before")
    df = numbered(df.join(reached, "block"), [F.col(ROW)], by=["block"], at="at", of="rows").drop("rows")
    edges = _capped(df, plan, names, pair_limit).select(F.col(f"l_{ROW}").alias("u"), F.col(f"r_{ROW}").alias("v"))
    return edges, cut


def duplicate_members(ds: Dataset, plan: Plan, pair_limit: int | None = PAIR_LIMIT) -> tuple[DataFrame, DataFrame]:
    """A line for each row of a duplicate plan's groups, ``(_row, label, cells)``, and whether the pair ceiling cut them short.

    ``label`` is the group's first row, with which each row is compared once; ``cells`` is the row's evidence. No line
    grows with its group.
    """
    edges, cut = duplicate_edges(ds, plan, pair_limit)
    labels = connected_components(edges)
    values = {f"m{i}": normalize(ds.text(m.key), m.operations) for i, m in enumerate(plan.matchers)}
    first = ds.df.join(labels.where("node = label"), F.col(ROW) == F.col("node")).select(F.col("label").alias("head"), *[v.alias(f"h_{n}") for n, v in values.items()])
    members = ds.df.withColumns(values).join(labels, F.col(ROW) == F.col("node")).join(materialize(first, "heads"), F.col("label") == F.col("head"))
    scores = {n: sim.similarity(m.algorithm, F.col(f"h_{n}"), F.col(n)) if m.algorithm else F.lit(1.0) for n, m in zip(values, plan.matchers, strict=True)}
    members = members.withColumns({f"s_{n}": s for n, s in scores.items()})
    cells = F.array(*[evidence(ds, m.key, F.col(n), m.algorithm or "equals", F.col(f"s_{n}")) for n, m in zip(values, plan.matchers, strict=True)])
    return members.select(ROW, "label", cells.alias("cells")), cut


def duplicate(ds: Dataset, rule: CompiledRule, limit=None, pair_limit: int | None = PAIR_LIMIT) -> DataFrame:
    plan = rule.plan
    fuzzy = [m for m in plan.matchers if m.algorithm]
    members, cut = duplicate_members(ds, plan, pair_limit)
    groups = _collected(members, ["label"], [ds.headers[m.key] for m in plan.matchers], limit)
    level = "HIGH" if not fuzzy else "LOW" if len(fuzzy) == len(plan.matchers) else "MEDIUM"
    said = f"Rows match on {', '.join(ds.headers[m.key] for m in plan.matchers)}."
    if fuzzy and pair_limit is not None and cut.first().cut:
        ds.warnings.append(f"Rule {rule.id}: the comparison stopped after {pair_limit:,} pairs; groups may be partial.")
    return finish(groups, rule, "POSSIBLE_DUPLICATE" if fuzzy else "DUPLICATE", level, said)


def _weighted_bounds(check: Check) -> list[list[tuple[str, float]]]:
    """Thresholds of single fields that a pair at the weighted threshold must meet: all of one list, of one list at least.

    A field can't be worth less than the threshold without the full weights of the others. Where that says little of each
    field, at least one field has the threshold's share of all weights.
    """
    whole = sum(w for _, w in check.weights)
    each = [(t, (check.threshold - whole + w) / w) for t, w in check.weights if w > 0]
    strong = sorted((x for x in each if x[1] > 0.82), key=lambda x: -x[1])
    return [strong] if strong else [[(t, check.threshold / whole)] for t, _ in each]


def _alike_values(classes: DataFrame, column: str, least: float) -> tuple[DataFrame, float]:
    """``(a, b, parts)`` of the values of a column with few values that are similar enough, both ways, and how many pairs of rows have them."""
    values = materialize(classes.groupBy(column).agg(F.count(F.lit(1)).alias("n")), "values")
    a, b = (values.select(F.col(column).alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    met = a.repartition(LEAST_TASKS).crossJoin(F.broadcast(b)).where(F.greatest(sim.jaro_winkler_bound(F.col("a"), F.col("b")), sim.jaro_winkler_bound(F.col("b"), F.col("a"))) >= least - 1e-9)
    met = met.where(F.greatest(sim.jaro_winkler(F.col("a"), F.col("b")), sim.jaro_winkler(F.col("b"), F.col("a"))) >= least - 1e-9)
    many = F.col("n_a").cast("double") * F.col("n_b")
    met = materialize(met.withColumn("parts", (F.floor(many / TASK_PAIRS) + 1).cast("int")), "value-pairs")
    return met, met.agg(F.sum(many)).first()[0] or 0.0


def _pairs_by_values(classes: DataFrame, column: str, least: float) -> tuple[DataFrame, float]:
    """Pairs of classes whose values of a column with few values are similar enough, each once, and how many they are at most.

    The values are compared with each other, and classes meet by pairs of values that pass. The sides of a frequent pair are dealt to several tasks.
    """
    met, total = _alike_values(classes, column, least)
    tasks = int(min(MOST_TASKS, max(LEAST_TASKS, total // TASK_PAIRS)))
    left, right = (classes.select(*[F.col(c).alias(f"{p}_{c}") for c in classes.columns]) for p in "lr")
    left = left.join(met.select("a", "b", "parts"), F.col(f"l_{column}") == F.col("a")).withColumn("salt", F.pmod(F.xxhash64(f"l_{ROW}"), F.col("parts")).cast("int")).drop("parts")
    right = right.join(met.select("a", "b", "parts"), F.col(f"r_{column}") == F.col("b")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met_by = ["a", "b", "salt"]
    pairs = left.repartition(tasks, *met_by).hint("shuffle_hash").join(right.repartition(tasks, *met_by), met_by)
    return pairs.where(F.col(f"l_{ROW}") < F.col(f"r_{ROW}")).drop(*met_by), total


def _candidates(classes: DataFrame, bounds: list[tuple[str, float]], accept) -> DataFrame:
    """Pairs of classes that ``accept`` takes, by the bounds of their columns, all of which such a pair meets.

    Signatures repeat a pair under many keys where most values are alike, as names with one beginning are. So a
    column with few values settles which classes meet, if these are few or, by a look at some of them, mostly match.
    """
    kinds = classes.agg(*[F.count_distinct(c).alias(c) for c, _ in bounds]).first()
    for column, least in sorted((b for b in bounds if kinds[b[0]] <= FEW_VALUES), key=lambda b: kinds[b[0]]):
        pairs, total = _pairs_by_values(classes, column, least)
        if total <= FREE_PAIRS:
            return accept(pairs)
        some = materialize(classes.orderBy(F.xxhash64(ROW)).limit(ASKED), "asked")
        asked, _ = _pairs_by_values(some, column, least)
        if accept(asked).count() * WORTH >= asked.count():
            return accept(pairs)
    return similar_pairs(classes, [Field(c, "jaro_winkler", least) for c, least in bounds], accept)


def weighted_classes(ds: Dataset, check: Check, fields: dict[str, str], pair_limit: int | None = WEIGHTED_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows with the first row of their class of equal values, ``(_row, first, rows)``, and linked classes, ``(u, v, score, exact)``.

    Classes are linked by equal exact fields (score 1), as stars around the first class, or by a weighted Jaro-Winkler
    sum at the threshold. Signatures of the fields find the candidates, so no pairs are made that no field bears out.
    """
    if pair_limit is not None:
        n = ds.df.count()
        if n * (n - 1) // 2 > pair_limit:
            raise PairLimitError(f"{n * (n - 1) // 2:,} pairs exceed the limit of {pair_limit:,}; no partial result has been made.")
    tokens = list(dict.fromkeys([*check.exact_fields, *(t for t, _ in check.weights)]))
    col = {t: f"w{i}" for i, t in enumerate(tokens)}
    df = materialize(ds.df.select(ROW, *[business_value(ds.text(fields[t]), t).alias(c) for t, c in col.items()]), "weighted")
    classes = materialize(df.groupBy(*col.values()).agg(F.min(ROW).alias(ROW), F.count(F.lit(1)).alias("rows")), "classes")
    members = df.join(classes.withColumnRenamed(ROW, "first"), list(col.values())).select(ROW, "first", "rows")
    none = ds.df.sparkSession.createDataFrame([], "u long, v long, score double, exact boolean")
    exact = [col[t] for t in check.exact_fields]
    stars = none
    if exact:
        stars = _stars(classes.where(reduce(lambda a, b: a & b, [F.length(c) > 0 for c in exact])), exact).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    if not check.weights:
        return members, stars
    filled = classes.drop("rows").where(reduce(lambda a, b: a & b, [F.length(col[t]) > 0 for t, _ in check.weights]))
    equal = reduce(lambda a, b: a & b, [(F.length(f"l_{c}") > 0) & (F.col(f"l_{c}") == F.col(f"r_{c}")) for c in exact], F.lit(bool(exact)))
    total = lambda f: reduce(lambda a, b: a + b, [f(F.col(f"l_{col[t]}"), F.col(f"r_{col[t]}")) * w for t, w in check.weights], F.lit(0.0))

    def accept(pairs: DataFrame) -> DataFrame:
        some = pairs.where(~equal & (total(sim.jaro_winkler_bound) + 1e-9 >= check.threshold)).withColumn("score", total(sim.jaro_winkler))
        return some.where(F.col("score") + 2.220446049250313e-16 >= check.threshold).select(F.col(f"l_{ROW}").alias("u"), F.col(f"r_{ROW}").alias("v"), "score", F.lit(False).alias("exact"))

    found = [_candidates(filled, [(col[t], least) for t, least in bounds], accept) for bounds in _weighted_bounds(check)]
    weighted = found[0] if len(found) == 1 else reduce(DataFrame.union, found).dropDuplicates(["u", "v"])
    return members, stars.union(materialize(weighted, "weighted-edges"))


def _within(classes: DataFrame, check: Check) -> DataFrame:
    """How the rows of one class are linked, ``(first, score, exact)``: by their exact fields, else by the full weights."""
    exact, whole = F.lit(bool(check.exact_fields)), F.lit(bool(check.weights))
    for i, t in enumerate(dict.fromkeys([*check.exact_fields, *(t for t, _ in check.weights)])):
        exact = exact & (F.length(f"w{i}") > 0) if t in check.exact_fields else exact
        whole = whole & (F.length(f"w{i}") > 0) if t in dict(check.weights) else whole
    full = float(sum(w for _, w in check.weights))
    return classes.where(exact | (whole & F.lit(full + 2.220446049250313e-16 >= check.threshold))).select(F.col(ROW).alias("first"), F.when(exact, 1.0).otherwise(full).alias("score"), exact.alias("exact"))


def weighted_edges(ds: Dataset, check: Check, fields: dict[str, str], pair_limit: int | None = WEIGHTED_LIMIT) -> DataFrame:
    """``(u, v, score, exact)`` of all pairs of rows with equal exact fields, or a weighted Jaro-Winkler sum at the threshold.

    This lists every pair, so it grows with the square of a group; ``weighted_duplicate`` closes groups without it.
    """
    members, links = weighted_classes(ds, check, fields, pair_limit)
    tokens = list(dict.fromkeys([*check.exact_fields, *(t for t, _ in check.weights)]))
    values = ds.df.select(ROW, *[business_value(ds.text(fields[t]), t).alias(f"w{i}") for i, t in enumerate(tokens)])
    exact = [f"w{i}" for i, t in enumerate(tokens) if t in check.exact_fields]
    parts = []
    if exact:
        keyed = values.where(reduce(lambda a, b: a & b, [F.length(c) > 0 for c in exact])).select(ROW, F.struct(*exact).alias("k"))
        left, right = keyed.withColumnRenamed(ROW, "u"), keyed.withColumnRenamed(ROW, "v")
        parts.append(left.join(right, "k").where("u < v").select("u", "v", F.lit(1.0).alias("score"), F.lit(True).alias("exact")))
    inner = _within(values.join(members.select(F.col("first").alias(ROW)).distinct(), ROW), check).where("NOT exact")
    rows = members.select(F.col(ROW).alias("row"), "first")
    same = inner.join(rows.withColumnRenamed("row", "u"), "first").join(rows.withColumnRenamed("row", "v"), "first").where("u < v").select("u", "v", "score", "exact")
    ends = lambda side: rows.select(F.col("row").alias(f"{side}_row"), F.col("first").alias(side))
    # few classes may hold many rows, so their pairs are dealt to tasks before they grow
    apart = links.where("NOT exact").repartition(LEAST_TASKS, "u", "v").join(ends("u"), "u").join(ends("v"), "v")
    parts += [same, apart.select(F.least("u_row", "v_row").alias("u"), F.greatest("u_row", "v_row").alias("v"), "score", "exact")]
    return reduce(DataFrame.union, parts)


def weighted_link_counts(ds: Dataset, check: Check, fields: dict[str, str]) -> DataFrame:
    """``(u, links, best)``: how many later rows ``weighted_edges`` links to a row, and the best of their scores.

    Where a column has few values, rows are compared in cells of two blocks and only counts leave a task: it holds no more than
    that, and a row is sent once for each block that it meets. The comparisons still grow with the square of a value's rows.
    Else the pairs are made and counted.
    """
    tokens = list(dict.fromkeys([*check.exact_fields, *(t for t, _ in check.weights)]))
    col = {t: f"w{i}" for i, t in enumerate(tokens)}
    add = lambda parts: parts.groupBy("u").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.max("best").alias("best"))
    bounds = _weighted_bounds(check) if check.weights else []
    if len(bounds) == 1:
        rows = materialize(ds.df.select(ROW, *[business_value(ds.text(fields[t]), t).alias(c) for t, c in col.items()]), "weighted")
        filled = rows.where(reduce(lambda a, b: a & b, [F.length(col[t]) > 0 for t, _ in check.weights]))
        kinds = filled.agg(*[F.count_distinct(col[t]).alias(col[t]) for t, _ in bounds[0]]).first()
        exact, weights = [col[t] for t in check.exact_fields], [(col[t], w) for t, w in check.weights]
        for column, least in sorted(((col[t], x) for t, x in bounds[0] if kinds[col[t]] <= FEW_VALUES), key=lambda b: kinds[b[0]]):
            met, total = _alike_values(filled, column, least)
            worth = total <= FREE_COUNTED
            if not worth:
                some = materialize(filled.orderBy(F.xxhash64(ROW)).limit(ASKED), "asked")
                near, pairs = _alike_values(some, column, least)
                hits = weighted_links(some, near, column, weights, exact, check.threshold).agg(F.sum("links")).first()[0] or 0
                worth = hits * 2 * WORTH >= pairs
            if worth:
                found = weighted_links(filled, met, column, weights, exact, check.threshold)
                return add(found.union(exact_links(rows, exact)) if exact else found)
    edges = weighted_edges(ds, check, fields, None)
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("links"), F.max("score").alias("best"))


def weighted_duplicate(ds: Dataset, rule: CompiledRule, limit=None, pair_limit: int | None = WEIGHTED_LIMIT) -> DataFrame:
    check, fields = rule.plan.check, rule.plan.fields
    members, edges = weighted_classes(ds, check, fields, pair_limit)
    members = materialize(members, "members")
    tokens = list(dict.fromkeys([*check.exact_fields, *(t for t, _ in check.weights)]))
    values = ds.df.select(ROW, *[business_value(ds.text(fields[t]), t).alias(f"w{i}") for i, t in enumerate(tokens)])
    repeated = members.where("rows > 1").select(F.col("first").alias(ROW)).distinct()
    inner = materialize(_within(values.join(repeated, ROW, "left_semi"), check), "within")
    labels = connected_components(edges.select("u", "v").union(inner.select(F.col("first").alias("u"), "first")))
    own = edges.select(F.col("u").alias("first"), "score", "exact").union(edges.select("v", "score", "exact")).union(inner)
    touched = own.groupBy("first").agg(F.min("score").alias("score"), F.max(F.col("exact").cast("int")).alias("by_exact"), F.max((~F.col("exact")).cast("int")).alias("by_weight"))
    # a class that is linked to no other stands for itself, if its rows are linked to each other
    rows = members.join(touched, "first").join(labels.withColumnRenamed("node", "first"), "first", "left")
    rows = rows.select(F.col(ROW).alias("row"), F.coalesce("label", "first").alias("label"), "score", "by_exact", "by_weight")
    members = ds.df.join(rows, F.col(ROW) == F.col("row"))
    cells = []
    weighted = [t for t, _ in check.weights]
    for t in tokens:
        hit = reduce(lambda a, b: a | b, [c for c, on in ((F.col("by_exact") == 1, t in check.exact_fields), (F.col("by_weight") == 1, t in weighted)) if on])
        cells.append(F.when(hit, evidence(ds, fields[t], business_value(ds.text(fields[t]), t), "weighted_duplicate", F.col("score"))))
    members = members.select(ROW, "label", F.filter(F.array(*cells), lambda e: e.isNotNull()).alias("cells"))
    groups = _collected(members, ["label"], [], limit).withColumn("fields", F.array_distinct(F.transform("evidence", lambda e: e["column_header"])))
    return finish(groups, rule, "POSSIBLE_DUPLICATE", "MEDIUM", "Rows are probably the same record.")


def columns_exist(ds: Dataset, rule: CompiledRule) -> DataFrame:
    """A worksheet finding, without rows, for each column that the dataset lacks."""
    it = rule.interpretation
    there = {h.strip().lower() for h in ds.headers.values()} | set(ds.keys)
    gone = [t for t in rule.plan.check.targets if t not in rule.plan.fields and t.strip().lower() not in there]
    rows = [(f"finding-{rule.id}-{i}", rule.id, "MISSING", it.severity, "HIGH", "worksheet", [], [t], [], f"The column {t} does not exist.", it.priority, it.action) for i, t in enumerate(gone)]
    return ds.df.sparkSession.createDataFrame(rows, SCHEMA)


def findings_in_long_form(ds: Dataset, rule: CompiledRule, evidence: int = 50, pair_limit: int | None = None) -> LongFindings:
    """A grouping rule's findings with rows of bounded size, whatever share of the table a key has; by default without a pair ceiling."""
    kind = rule.plan.kind if rule.plan.kind != "business" else rule.plan.check.kind
    execute = GROUPING.get(kind) or {"uniqueness": uniqueness, "consistency": consistency, "duplicate": duplicate}[kind]
    if kind in ("duplicate", "weighted_duplicate"):
        execute = partial(execute, pair_limit=pair_limit)
    return long_findings(ds, rule, execute, evidence)


GROUPING = {"unique_any": unique_any, "duplicate_fields": duplicate_fields, "weighted_duplicate": weighted_duplicate}


def run_rules(ds: Dataset, rules: Sequence[CompiledRule], evidence_limit: int | None = None, pair_limit: int | None = PAIR_LIMIT, on_progress=None) -> DataFrame:
    """Findings of all rules: one scan for those that look at single rows, a plan for each other rule.

    Without a ``pair_limit`` fuzzy and weighted rules find all pairs; ``evidence_limit`` bounds the rows whose evidence a group shows.
    """
    rules = [r for r in rules if r.plan]
    local = [r for r in rules if is_row_local(r.plan)]
    parts = [run_row_local(ds, local)] if local else []
    for rule in rules:
        if on_progress:
            on_progress(rule.id)
        kind = rule.plan.kind if rule.plan.kind != "business" else rule.plan.check.kind
        if rule in local:
            continue
        if kind == "columns_exist":
            parts.append(columns_exist(ds, rule))
        elif kind == "duplicate":
            parts.append(duplicate(ds, rule, evidence_limit, pair_limit))
        elif kind == "weighted_duplicate":
            parts.append(weighted_duplicate(ds, rule, evidence_limit, pair_limit and WEIGHTED_LIMIT))
        elif kind in GROUPING:
            parts.append(GROUPING[kind](ds, rule, evidence_limit))
        else:
            parts.append({"uniqueness": uniqueness, "consistency": consistency}[kind](ds, rule, evidence_limit))
    if not parts:
        return ds.df.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, parts)
