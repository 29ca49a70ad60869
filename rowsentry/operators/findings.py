"""Findings: their schema and ids, and the algebra over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import SEVERITIES
from ..sources.dataset import ROW, Dataset
from .graph import connected_components
from .long_form import page_of
from .ranks import numbered

EVIDENCE = "struct<row:bigint,column_key:string,column_header:string,original:string,normalized:string,comparator:string,score:double>"
SCHEMA = f"id string, rule_id string, type string, severity string, confidence string, scope string, rows array<bigint>, fields array<string>, evidence array<{EVIDENCE}>, explanation string, priority string, action string"
COLUMNS = ("id", "rule_id", "type", "severity", "confidence", "scope", "rows", "fields", "evidence", "explanation", "priority", "action")
DEFAULT_ACTION = "Review the flagged values with the accountable data owner."


def fnv1a36(text: Column) -> Column:
    """FNV-1a of ASCII text in base 36, without leaving the JVM."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * 16777619).bitwiseAND(4294967295)
    return F.lower(F.conv(F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), lambda h, c: F.when(F.length(c) == 0, h).otherwise(step(h, c))).cast("string"), 10, 36))


def finding_id(kind: Column, rule: Column, rows: Column) -> Column:
    """The id follows from the type, the rule and the sorted rows."""
    return F.concat(F.lit("finding-"), fnv1a36(F.concat_ws(":", kind, rule, F.array_join(F.transform(F.array_sort(rows), lambda r: r.cast("string")), ","))))


def identity() -> Column:
    """A finding's key for joins. Ids have 32 bits, so among some 10^5 findings two share one; these keys have 64."""
    return F.xxhash64(F.lit("f"), "id", "type", "rule_id", "scope", F.array_sort("rows"), "fields")


def evidence(ds: Dataset, key: str, normalized: Column, comparator: str, score: Column | None = None) -> Column:
    return F.struct(
        F.col(ROW).alias("row"), F.lit(key).alias("column_key"), F.lit(ds.headers.get(key, key)).alias("column_header"), ds.text(key).alias("original"),
        normalized.alias("normalized"), F.lit(comparator).alias("comparator"), (score if score is not None else F.lit(None).cast("double")).alias("score"),
    )


def finish(df: DataFrame, rule, kind: str, confidence: str, explanation: str, scope: str = "rows", id_key: str | None = None) -> DataFrame:
    """Findings from ``rows, fields, evidence`` of a rule's groups."""
    it = rule.interpretation
    more = [F.lit(id_key or rule.id).alias("id_key"), "group", "n_rows"] if "n_rows" in df.columns else []
    return df.select(
        finding_id(F.lit(kind), F.lit(id_key or rule.id), F.col("rows")).alias("id"), F.lit(rule.id).alias("rule_id"), F.lit(kind).alias("type"), F.lit(it.severity).alias("severity"),
        F.lit(confidence).alias("confidence"), F.lit(scope).alias("scope"), "rows", "fields", "evidence", F.lit(explanation).alias("explanation"),
        F.lit(it.priority).cast("string").alias("priority"), F.lit(it.action or DEFAULT_ACTION).alias("action"), *more,
    )


def severity_rank(col: str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(col))


def impact(findings: DataFrame) -> DataFrame:
    """``impact``: from the priority, and 3, 2, 1 as its rank."""
    level = F.when(F.col("priority").isin("high", "medium_high"), "large").when(F.col("priority") == "low", "small").otherwise("medium")
    out = findings.withColumn("impact", level)
    return out.withColumn("impact_rank", F.when(F.col("impact") == "large", 3).when(F.col("impact") == "medium", 2).otherwise(1))


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, then by first row; the id settles ties."""
    return findings.orderBy(severity_rank(), F.coalesce(F.array_min("rows"), F.lit(2**62)), "rule_id", "id")


def by_impact(findings: DataFrame) -> DataFrame:
    return impact(findings).orderBy(F.desc("impact_rank"), severity_rank(), F.coalesce(F.array_min("rows"), F.lit(2**62)), "rule_id", "id")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count(F.lit(1)).alias("findings"), F.sum(F.size("rows")).alias("affected"))


#: The counter of each type; any other type is a rule's violation.
COUNTERS = {"DUPLICATE": "duplicate_groups", "POSSIBLE_DUPLICATE": "possible_duplicate_groups", "INVALID": "invalid_values", "MISSING": "missing_values", "INCONSISTENT": "consistency_violations", "UNIQUENESS_VIOLATION": "uniqueness_violations"}


def counters(findings: DataFrame) -> DataFrame:
    """One row: all findings and those of each type, ``rule_violations`` being those of no type of their own."""
    kinds = [F.count_if(F.col("type") == kind).alias(name) for kind, name in COUNTERS.items()]
    return findings.agg(F.count(F.lit(1)).alias("total_findings"), *kinds, F.count_if(~F.col("type").isin(*COUNTERS)).alias("rule_violations"))


def grouped(findings: DataFrame) -> DataFrame:
    """By type and rule: how many, the highest rank, and how many distinct rows."""
    ranked = triage_rank(findings)
    heads = ranked.groupBy("type", "rule_id").agg(F.count(F.lit(1)).alias("findings"), F.max("rank").alias("rank"))
    rows = findings.select("type", "rule_id", F.explode("rows").alias("row")).distinct().groupBy("type", "rule_id").agg(F.count(F.lit(1)).alias("affected_rows"))
    return heads.join(rows, ["type", "rule_id"], "left").fillna(0, ["affected_rows"]).orderBy(F.desc("rank"), F.desc("findings"), "type", "rule_id")


def consolidate(findings: DataFrame) -> DataFrame:
    """Findings that share rows, transitively, as one review group; findings without rows stay alone.

    Returns ``group_id, head`` (the id of the finding with the highest impact), ``ids, types, fields, rows, explanations`` and
    ``keys``. Each finding has its id and its key (``identity``) there, in no common order; two findings with one id have it twice.
    """
    member = impact(findings).select("*", identity().alias("node"))
    edges = member.select(F.col("node").alias("u"), F.explode("rows").alias("row")).select("u", F.xxhash64(F.lit("r"), "row").alias("v"))
    labels = connected_components(edges).withColumnRenamed("node", "of")
    member = member.join(labels, member.node == labels.of, "left").withColumn("group_id", F.coalesce("label", "node"))
    first = F.struct((-F.col("impact_rank")).alias("i"), severity_rank().alias("s"), F.coalesce(F.array_min("rows"), F.lit(2**62)).alias("r"), "id")
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return member.groupBy("group_id").agg(
        F.min(first)["id"].alias("head"), F.array_sort(F.transform(F.collect_set(F.struct("node", "id")), lambda m: m["id"])).alias("ids"), F.array_sort(F.collect_set("type")).alias("types"),
        flat("fields").alias("fields"), flat("rows").alias("rows"), F.array_sort(F.collect_set("explanation")).alias("explanations"), F.array_sort(F.collect_set("node")).alias("keys"),
    )


def action_items(findings: DataFrame) -> DataFrame:
    """Per row: its distinct (rule, action), by priority, with their explanations."""
    each = findings.select(F.explode("rows").alias("row"), "rule_id", "action", "priority", "explanation")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("high", "medium_high", "medium", "low_medium", "low"))), F.coalesce("priority", F.lit("medium"))), F.lit(3))
    each = each.groupBy("row", "rule_id", "action").agg(F.min(rank).alias("rank"), F.concat_ws(" ", F.array_sort(F.collect_set("explanation"))).alias("explanation"))
    return each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "action", "explanation"))).alias("items"))


def source_rows(ds: Dataset, findings: DataFrame, finding: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the rows of a finding: the first two columns and the affected ones, in sheet order.

    Rows are numbered on the cluster and the page is read by places; the driver sees the names of fields only.
    """
    found = findings.where(F.col("id") == finding)
    hit = found.select("id", "fields", F.array_distinct(F.transform("evidence", lambda e: e["column_key"])).alias("keys")).first()
    if hit is None:
        raise KeyError(finding)
    wanted = set(ds.keys[:2]) | {k for k in ds.keys if ds.headers[k] in hit.fields or k in hit.fields or k in hit["keys"]}
    index = numbered(found.select("id", F.explode(F.array_distinct("rows")).alias("row")), [F.col("row")], at="place", of="n_rows")
    return page_of(ds, index, finding, [k for k in ds.keys if k in wanted], offset, limit)


def cell_affected(finding_fields: Column, finding_evidence: Column, row: Column, header: str, key: str) -> Column:
    """Whether a cell is meant: by the row's evidence if it has any, else by the list of fields."""
    own = F.filter(finding_evidence, lambda e: e["row"] == row)
    return F.when(F.size(own) > 0, F.exists(own, lambda e: e["column_key"] == key)).otherwise(F.array_contains(finding_fields, header))


def filter_findings(findings: DataFrame, types=(), severities=(), confidences=(), text: str = "") -> DataFrame:
    out = findings
    for column, wanted in (("type", types), ("severity", severities), ("confidence", confidences)):
        if wanted:
            out = out.where(F.col(column).isin(*wanted))
    if text.strip():
        said = F.concat_ws(" ", "type", "rule_id", "explanation", "action", F.concat_ws(" ", "fields"), F.concat_ws(" ", F.transform("rows", lambda r: r.cast("string"))), F.concat_ws(" ", F.transform("evidence", lambda e: F.concat_ws(" ", e["original"], e["normalized"]))))
        out = out.where(F.lower(said).contains(text.strip().lower()))
    return out


def location(rows: Column) -> Column:
    """Row numbers as text; more than two are "[ Multi ]"."""
    return F.when(F.size(rows) > 2, "[ Multi ]").otherwise(F.array_join(F.transform(F.array_sort(rows), lambda r: r.cast("string")), ", "))


def triage_rank(findings: DataFrame) -> DataFrame:
    """``rank``: impact in the hundreds, severity in the tens, confidence in the ones."""
    return impact(findings).withColumn("rank", F.col("impact_rank") * 100 + (5 - severity_rank()) * 10 + F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MEDIUM", 2).otherwise(1))


def review_summary(ds: Dataset, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """How many rows are accepted, excluded, unreviewed and clean; ``decisions``: ``(_row, decision)``."""
    flagged = findings.select(F.explode("rows").alias(ROW)).distinct().withColumn("flagged", F.lit(True))
    each = ds.df.select(ROW).join(flagged, ROW, "left").join(decisions, ROW, "left")
    state = F.when(F.col("flagged").isNull(), "clean").when(F.col("decision") == "accept", "accepted").when(F.col("decision") == "delete", "excluded").otherwise("unreviewed")
    return each.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("rows"))


def decided_rows(decisions: DataFrame, analysis: str, decision: str) -> DataFrame:
    """Rows with a decision of one analysis; ``decisions``: ``(analysis, _row, decision)``."""
    return decisions.where((F.col("analysis") == analysis) & (F.col("decision") == decision)).select(ROW).distinct()


def filter_groups(groups: DataFrame, findings: DataFrame, **filters) -> DataFrame:
    """Review groups with a finding that passes; such a group stays whole."""
    hit = filter_findings(findings, **filters).select(identity().alias("hit"))
    keep = groups.select("group_id", F.explode("keys").alias("hit")).join(hit, "hit", "left_semi").select("group_id").distinct()
    return groups.join(keep, "group_id", "left_semi")


def evidence_by_row(findings: DataFrame) -> DataFrame:
    """A line for each piece of evidence with its finding's id and ``key``; the normalized text only where it differs."""
    each = findings.select("id", identity().alias("key"), F.explode("evidence").alias("e")).select("id", "key", "e.*")
    return each.withColumn("normalized", F.when(F.col("normalized") != F.col("original"), F.col("normalized")))
