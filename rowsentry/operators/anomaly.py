"""Unsupervised anomaly scan: robust outliers, masks, type votes and unexpected blanks.

Each detector is a DataFrame of anomalies ``(category, column, row, value, severity, confidence,
score, baseline)``; scalars and small group tables are joined back, never collected row by row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import trim_ws
from ..functions.normalize import structure_mask
from ..sources.dataset import ROW, Dataset
from .profile import ColumnProfile, column_counts
from .selection import exact_median

BASELINE = "struct<median:double,mad:double,low:double,high:double,dominant:string,coverage:double,correlated:string,condition:string>"
COLUMNS = ("category", "column", "row", "value", "severity", "confidence", "score", "baseline")
MAD_LEAST, MAD_CUT, MAD_SCALE = 5, 3.5, 0.6745


def _baseline(**known):
    fields = [f.split(":") for f in BASELINE[7:-1].split(",")]
    return F.struct(*[(known[n] if n in known else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _anomaly(df: DataFrame, category: str, column: str, value, severity, confidence, score, baseline) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    return df.select(F.lit(category).alias("category"), F.lit(column).alias("column"), F.col(ROW).alias("row"), value.alias("value"), lit(severity).alias("severity"), lit(confidence).alias("confidence"), lit(score).cast("double").alias("score"), baseline.alias("baseline"))


def round_half_up(x, places: int = 2):
    scale = 10**places
    return F.floor(x * scale + 0.5) / scale


def mad_outliers(ds: Dataset, key: str) -> DataFrame:
    """Numbers whose modified z-score reaches 3.5; above 5 an error, above 8 critical. Median and spread are found at once, exactly."""
    number = ds.number(key) if not isinstance(ds.kind(key), T.StringType) else None
    if number is None:
        number = F.lit(None).cast("double")
    if ds.tagged(key):
        number = F.when(F.col(key)["t"] == "number", F.col(key)["n"])
    df = ds.df.select(ROW, number.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    med, n = exact_median(df)
    mad = exact_median(df.select(F.abs(F.col("x") - med).alias("x")))[0] if n >= MAD_LEAST else 0.0
    # without a spread nothing stands out
    out = df.where(F.lit(bool(mad))).withColumns({"med": F.lit(med or 0.0), "mad": F.lit(mad or 1.0)})
    out = out.withColumn("z", MAD_SCALE * F.abs(F.col("x") - F.col("med")) / F.col("mad")).where(F.col("z") >= MAD_CUT)
    reach = MAD_CUT * F.col("mad") / MAD_SCALE
    return _anomaly(
        out, "NUMERIC_OUTLIER", key, F.col("x").cast("string"), F.when(F.col("z") > 8, "critical").when(F.col("z") > 5, "error").otherwise("warning"), F.when(F.col("z") > 5, "HIGH").otherwise("MEDIUM"),
        F.least(F.lit(1.0), 0.7 + (F.col("z") - MAD_CUT) * 0.05), _baseline(median=F.col("med"), mad=F.col("mad"), low=round_half_up(F.col("med") - reach), high=round_half_up(F.col("med") + reach)),
    )


def format_deviations(ds: Dataset, key: str) -> DataFrame:
    """Texts whose mask at most a tenth of the column has, where one mask holds 85 % and masks are few."""
    text = ds.text(key)
    keep = ~ds.missing(key) if not ds.tagged(key) else ~ds.missing(key) & (F.col(key)["t"] == "text")
    df = ds.df.where(keep).select(ROW, text.alias("value"), structure_mask(F.trim(text)).alias("mask"))
    masks = df.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))
    whole = masks.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max_by("mask", F.struct("n", -F.col("first"))).alias("dominant"), F.max("n").alias("top"))
    rare = masks.crossJoin(F.broadcast(whole)).where((F.col("total") >= 10) & (F.col("kinds") / F.col("total") <= 0.3) & (F.col("top") / F.col("total") >= 0.85) & (F.col("mask") != F.col("dominant")) & (F.col("n") / F.col("total") <= 0.1))
    out = df.join(rare.select("mask", "dominant", "total", "top"), "mask")
    return _anomaly(out, "FORMAT_DEVIATION", key, F.col("value"), "warning", F.when(F.col("top") / F.col("total") >= 0.95, "HIGH").otherwise("MEDIUM"), F.col("top") / F.col("total"), _baseline(dominant=F.col("dominant"), coverage=F.col("top") / F.col("total")))


def type_inconsistencies(ds: Dataset, key: str) -> DataFrame:
    """Cells of another type than 85 % of the column's. A statically typed column has none."""
    df = ds.df.select(ROW, ds.text(key).alias("value"), ds.tag(key).alias("tag")).where(F.col("tag").isNotNull())
    votes = df.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))
    whole = votes.agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.max_by("tag", F.struct("n", -F.col("first"))).alias("dominant"))
    out = df.crossJoin(F.broadcast(whole)).where((F.col("total") >= 5) & (F.col("top") / F.col("total") >= 0.85) & (F.col("tag") != F.col("dominant")))
    return _anomaly(out, "DATA_TYPE_INCONSISTENCY", key, F.col("value"), "error", "HIGH", F.col("top") / F.col("total"), _baseline(dominant=F.col("dominant"), coverage=F.col("top") / F.col("total")))


def atypical_blanks(ds: Dataset, keys: Sequence[str] | None = None) -> DataFrame:
    """Blanks in columns that are 95 % filled or more, 1 to 25 of them; counted for all columns in one pass."""
    keys = list(keys or ds.keys)
    each = F.array(*[F.struct(F.lit(k).alias("column"), ds.missing(k).alias("gone")) for k in keys])
    long = ds.df.select(ROW, F.explode(each).alias("c")).select(ROW, "c.*")
    rates = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("blank"))
    rates = rates.where((F.col("n") >= 10) & F.col("blank").between(1, 25) & ((F.col("n") - F.col("blank")) / F.col("n") >= 0.95))
    out = long.where("gone").join(F.broadcast(rates), "column") if len(keys) >= 2 else long.where("false").crossJoin(rates.drop("column"))
    filled = (F.col("n") - F.col("blank")) / F.col("n")
    return out.select(F.lit("ATYPICAL_MISSING").alias("category"), "column", F.col(ROW).alias("row"), F.lit("").alias("value"), F.lit("warning").alias("severity"), F.lit("HIGH").alias("confidence"), filled.alias("score"), _baseline(coverage=filled).alias("baseline"))


STATUS_HEADER = re.compile(r"(status|state|type|category)$", re.IGNORECASE)


def status_dependencies(ds: Dataset, keys: Sequence[str] | None = None) -> DataFrame:
    """Blanks in a column that is 85 % filled, with 1 to 5 blanks, among the rows of one status value.

    Status columns: by header; 2 to 5 distinct short values that aren't numbers or phrases; 5 rows a value at least.
    """
    keys = list(keys or ds.keys)
    parts = []
    for status in [k for k in ds.keys if STATUS_HEADER.search(ds.headers[k])]:
        value = F.trim(ds.text(status))
        usable = (F.length(value) > 0) & (F.length(value) <= 20) & ~value.rlike(r"[@\s]") & ~value.rlike(r"^\d+$")
        targets = [k for k in keys if k != status]
        if not targets:
            continue
        each = F.array(*[F.struct(F.lit(k).alias("column"), ds.missing(k).alias("gone")) for k in targets])
        long = ds.df.where(usable).select(ROW, value.alias("condition"), F.explode(each).alias("c")).select(ROW, "condition", "c.*")
        rates = long.groupBy("condition", "column").agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("blank"))
        kinds = rates.agg(F.countDistinct("condition").alias("kinds"))
        rates = rates.crossJoin(F.broadcast(kinds)).where(F.col("kinds").between(2, 5) & (F.col("n") >= 5) & F.col("blank").between(1, 5) & ((F.col("n") - F.col("blank")) / F.col("n") >= 0.85))
        out = long.where("gone").join(rates, ["condition", "column"])
        filled = (F.col("n") - F.col("blank")) / F.col("n")
        parts.append(out.select(F.lit("ATYPICAL_MISSING").alias("category"), "column", F.col(ROW).alias("row"), F.lit("").alias("value"), F.lit("error").alias("severity"), F.lit("HIGH").alias("confidence"), filled.alias("score"), _baseline(coverage=filled, correlated=F.lit(status), condition=F.col("condition")).alias("baseline")))
    return reduce(DataFrame.unionByName, parts) if parts else atypical_blanks(ds).where("false")


def primary_keys(ds: Dataset) -> DataFrame:
    """Columns with key-like headers whose ten or more values are all distinct, as ``column, n``."""
    like = [k for k in ds.keys if re.search(r"id$|code|codigo|number|sku|cpf|cnpj", ds.headers[k], re.IGNORECASE)]
    if not like:
        return ds.df.sparkSession.createDataFrame([], "column string, n long")
    found = column_counts(ds, like, lambda text: F.lower(trim_ws(text)))
    return found.where("non_empty >= 10 AND non_empty = unique_values").select("column", F.col("non_empty").alias("n"))


@dataclass(frozen=True)
class Draft:
    """A rule drafted from an invariant; ``executable`` is False where the rule language can't say it."""

    pillar: str
    column: str
    text: str
    executable: bool = True


def adjudicate(found: DataFrame, drafts: Sequence[Draft], keep_draft=None, doubt=None) -> tuple[DataFrame, list[Draft]]:
    """Let callbacks drop drafts that fit the sample too closely, and lower up to five grave anomalies that they doubt to info.

    Without callbacks, or where one fails, all stay as they are.
    """
    def ask(f, x, default):
        try:
            return default if f is None else bool(f(x))
        except Exception:  # a failing model never decides
            return default

    drafts = [d for d in drafts if ask(keep_draft, d, True)]
    if doubt is None:
        return found, drafts
    grave = found.where(F.col("severity").isin("critical", "error")).orderBy("category", "column", "row").limit(5).collect()
    lowered = [(r.category, r.column, r.row) for r in grave if ask(doubt, r, False)]
    for category, column, row in lowered:
        found = found.withColumn("severity", F.when((F.col("category") == category) & (F.col("column") == column) & (F.col("row") == row), "info").otherwise(F.col("severity")))
    return found, drafts


def scan(ds: Dataset, profiles: Sequence[ColumnProfile] = ()) -> tuple[DataFrame, list[Draft]]:
    """All anomalies, and rules drafted from invariants and baselines (the first of each text)."""
    parts = []
    for k in ds.keys:
        if ds.tagged(k):
            parts += [type_inconsistencies(ds, k), mad_outliers(ds, k), format_deviations(ds, k)]
        elif isinstance(ds.kind(k), T.NumericType):
            parts.append(mad_outliers(ds, k))
        elif isinstance(ds.kind(k), T.StringType):
            parts.append(format_deviations(ds, k))
    found = reduce(DataFrame.unionByName, [*parts, atypical_blanks(ds), status_dependencies(ds)])
    drafts = [Draft("primary_key", r.column, f"Find duplicate values in {ds.headers[r.column]}") for r in primary_keys(ds).orderBy("column").collect()]
    for p in profiles:
        if p.confidence >= 0.8 and p.semantic == "email":
            drafts.append(Draft("type_validation", p.key, f"Check that {p.header} contains a valid email address"))
        if p.confidence >= 0.8 and p.semantic == "phone":
            drafts.append(Draft("type_validation", p.key, f"Check for duplicated phones in {p.header}"))
    # as many as the columns and conditions that were looked at
    kinds = found.select("category", "column", "baseline").distinct().orderBy("category", "column").collect()
    for r in kinds:
        drafts += draft_of(ds, r.category, r.column, r.baseline)
    return found, list({d.text: d for d in reversed(drafts)}.values())[::-1]


def draft_of(ds: Dataset, category: str, column: str, base) -> list[Draft]:
    name = ds.headers[column]
    if category == "ATYPICAL_MISSING" and base.correlated:
        return [Draft("status_dependency", column, f'If {ds.headers[base.correlated]} is "{base.condition}", {name} must not be empty')]
    if category == "ATYPICAL_MISSING":
        return [Draft("essential_field", column, f"Check if {name} is not empty")]
    if category == "FORMAT_DEVIATION":
        only = set(base.dominant) == {"D"}
        return [Draft("type_validation", column, f"{name} must have exactly {len(base.dominant)} digits" if only else f'{name} must match format "{base.dominant}"', executable=False)]
    if category == "NUMERIC_OUTLIER":
        return [Draft("type_validation", column, f"{name} must be between {base.low:g} and {base.high:g}")]
    return []


def anomaly_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("anomalies"))


#: What an anomaly may be, and how grave.
CATEGORIES = ("NUMERIC_OUTLIER", "FORMAT_DEVIATION", "DATA_TYPE_INCONSISTENCY", "ATYPICAL_MISSING", "SEMANTIC_PATTERN_BREAK")
GRAVITIES = ("critical", "error", "warning", "info")


def summary_by(found: DataFrame, column: str) -> DataFrame:
    """How many anomalies there are of each ``category`` or of each ``severity``, those without any as well."""
    kinds = found.sparkSession.createDataFrame([(k,) for k in (CATEGORIES if column == "category" else GRAVITIES)], f"{column} string")
    counts = found.groupBy(column).agg(F.count(F.lit(1)).alias("anomalies"))
    return kinds.join(F.broadcast(counts), column, "left").select(column, F.coalesce("anomalies", F.lit(0)).alias("anomalies"))
