"""Column profiles and semantic types.

All columns are unpivoted once to hashes of their values with the first row of each; what a column
counts follows from these. The first rows of all columns come from one bounded job. Semantic types
are inferred on the driver from at most 100 values a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import trim_ws
from ..functions.normalize import field_label, phone_shape
from ..functions.validate import AREA_CODES
from ..sources.dataset import ROW, Dataset
from ..sources.shared import discard, materialize

#: The header words that name a semantic type, English and Portuguese.
ALIASES = {
    "name": ("name", "full name", "customer name", "client name", "nome", "nome completo", "nome cliente", "razao social"),
    "phone": ("phone", "phone number", "mobile", "cellphone", "contact phone", "telefone", "telefone cliente", "celular", "fone", "contato"),
    "email": ("email", "e mail", "email address", "customer email", "correio eletronico"),
    "cpf": ("cpf", "cpf cliente", "documento cpf", "tax id cpf"),
    "cnpj": ("cnpj", "cnpj cliente", "documento cnpj", "tax id cnpj"),
    "identifier": ("id", "identifier", "customer id", "client id", "account number", "document number", "invoice number", "order id", "codigo", "codigo cliente", "identificador", "numero documento", "numero pedido"),
    "date": ("date", "birth date", "birthday", "created date", "data", "data nascimento", "nascimento"),
    "number": ("amount", "quantity", "total", "value", "valor", "quantidade"),
    "text": ("description", "notes", "comment", "descricao", "observacao"),
}
EXAMPLES, VARIANTS, VARIANT_SAMPLE, SEMANTIC_SAMPLE = 5, 12, 250, 100


@dataclass
class ColumnProfile:
    key: str
    header: str
    data_type: str
    non_empty: int
    missing: int
    unique: int
    examples: list[str] = field(default_factory=list)
    format_variants: list[str] = field(default_factory=list)
    candidates: list[tuple[str, float]] = field(default_factory=list)
    semantic: str = "unknown"
    confidence: float = 0.0

    @property
    def missing_rate(self) -> float:
        return self.missing / max(self.missing + self.non_empty, 1)


#: The cell types, each a bit of a mask.
TAGS = ("boolean", "date", "number", "text")


def column_values(ds: Dataset, keys: Sequence[str] | None = None, by: Callable[[Column], Column] = trim_ws) -> DataFrame:
    """A row for each distinct value of each column, ``(c, h1, h2, n, first, tags)``: two hashes of it, its rows, the first of them.

    Missing cells of a column are one row without hashes. Only hashes are shuffled, combined before that; values
    are told apart by 128 bits.
    """
    each = []
    for c, k in enumerate(keys or ds.keys):
        text = F.when(~ds.missing(k), by(ds.text(k)))
        tag = F.coalesce(*[F.when(ds.tag(k) == t, F.lit(1 << b)) for b, t in enumerate(TAGS)], F.lit(0))
        each.append(F.struct(F.lit(c).alias("c"), F.when(text.isNotNull(), F.xxhash64(text)).alias("h1"), F.when(text.isNotNull(), F.xxhash64(F.lit("2"), text)).alias("h2"), tag.alias("tag")))
    long = ds.df.select(ROW, F.explode(F.array(*each)).alias("v")).select(ROW, "v.*")
    return long.groupBy("c", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"), F.bit_or("tag").alias("tags"))


def _counts(ds: Dataset, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    there = F.col("h1").isNotNull()
    found = values.groupBy("c").agg(
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("non_empty"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(there).alias("unique_values"), F.bit_or("tags").alias("tags"),
    )
    columns = ds.df.sparkSession.createDataFrame(list(enumerate(keys)), "c int, column string")
    found = columns.join(F.broadcast(found), "c", "left").fillna(0, ["non_empty", "missing", "unique_values", "tags"])
    types = F.filter(F.array(*[F.when(F.col("tags").bitwiseAND(1 << b) > 0, t) for b, t in enumerate(TAGS)]), lambda t: t.isNotNull())
    found = found.select("column", "non_empty", "missing", "unique_values", types.alias("types"))
    return found.withColumn("missing_rate", F.col("missing") / F.greatest(F.col("missing") + F.col("non_empty"), F.lit(1))).withColumn("uniqueness_ratio", F.col("unique_values") / F.greatest("non_empty", F.lit(1)))


def column_counts(ds: Dataset, keys: Sequence[str] | None = None, by: Callable[[Column], Column] = trim_ws) -> DataFrame:
    """One row per column: non-empty and missing cells, distinct trimmed texts, and the cell types met; one shuffle of values for any number of columns."""
    keys = list(keys or ds.keys)
    return _counts(ds, column_values(ds, keys, by), keys)


def first_cells(ds: Dataset, most: int, keys: Sequence[str] | None = None) -> DataFrame:
    """The first ``most`` non-empty texts of each column in row order, ``(column, place, _row, value)``.

    A task passes on no more than that many of a column.
    """
    each = [F.struct(F.lit(k).alias("column"), F.when(~ds.missing(k), ds.text(k)).alias("value")) for k in keys or ds.keys]
    long = ds.df.select(ROW, F.explode(F.array(*each)).alias("v")).select(ROW, "v.*").where(F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("column").orderBy(ROW))
    return long.withColumn("place", place).where(F.col("place") <= most).select("column", "place", ROW, "value")


def samples(ds: Dataset, key: str, limit: int) -> list[str]:
    """The first non-empty texts of a column in row order."""
    return [r.value for r in first_cells(ds, limit, [key]).orderBy("place").collect()]


def _check_digits(d: str, weights: list[int]) -> int:
    rest = sum(int(x) * w for x, w in zip(d, weights, strict=False)) % 11
    return 0 if rest < 2 else 11 - rest


def _looks(semantic: str, v: str) -> tuple[bool, bool]:
    """Whether a text is valid for a type, and whether it at least has its shape."""
    d = re.sub(r"\D", "", v, flags=re.ASCII)
    if semantic == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]{2,}", v) is not None, False
    if semantic in ("cpf", "cnpj"):
        n = 11 if semantic == "cpf" else 14
        if len(d) != n or len(set(d)) == 1:
            return False, len(d) == n
        spans = ([*range(10, 1, -1)], [*range(11, 1, -1)]) if n == 11 else ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
        return all(_check_digits(d, w) == int(d[len(w)]) for w in spans), True
    if semantic == "phone":
        own = d[2:] if len(d) in (12, 13) and d.startswith("55") else d
        own = own[1:] if len(own) in (11, 12) and own.startswith("0") else own
        return own[:2] in AREA_CODES and re.fullmatch(r"..(9\d{8}|[2-5]\d{7})", own) is not None, 10 <= len(d) <= 13
    if semantic == "date":
        return re.fullmatch(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}([T ].*)?|\d{1,2}/\d{1,2}/\d{4}|[A-Za-z]{3,9} \d{1,2}, \d{4}|\d{1,2} [A-Za-z]{3,9} \d{4}", v) is not None, False
    if semantic == "number":
        return re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|0[xX][0-9a-fA-F]+", v.replace(",", ".", 1)) is not None, False
    if semantic == "name":
        return re.fullmatch(r"[^\W\d_][^\d_]{2,}", v) is not None and len(v.split()) >= 2 and not re.search(r"[^\w' -]", v), False
    return bool(d or v) and not re.search(r"\s{2,}", v), False


#: The weight of valid samples, and of samples of the right shape.
WEIGHTS = {"email": (0.86, 0), "cpf": (0.98, 0.64), "cnpj": (0.98, 0.64), "phone": (0.92, 0.72), "date": (0.72, 0), "number": (0.7, 0), "name": (0.48, 0), "identifier": (0.35, 0), "text": (0, 0)}


def semantic_candidates(header: str, values: list[str]) -> list[tuple[str, float]]:
    label, values = field_label(header), [v.strip() for v in values if v.strip()][:SEMANTIC_SAMPLE]
    out = []
    for semantic, aliases in ALIASES.items():
        by_header = max((0.99 if label == a else 0.91 if label.startswith(a + " ") or label.endswith(" " + a) else 0.84 if len(a) >= 3 and a in label else 0.0) for a in aliases)
        seen = [_looks(semantic, v) for v in values]
        valid, shape = WEIGHTS[semantic]
        by_sample = max(valid * sum(x for x, _ in seen), shape * sum(x for _, x in seen)) / len(seen) if seen else 0.0
        score = min(0.99, max(by_header, 0.75 * by_header + 0.45 * by_sample, by_sample))
        if score >= 0.25:
            out.append((semantic, round(score, 3)))
    return sorted(out, key=lambda c: -c[1])


def select_semantic(candidates: list[tuple[str, float]]) -> tuple[str, float]:
    """The best type if it is sure (0.62) and clearly ahead (0.1), else unknown."""
    if not candidates:
        return "unknown", 0.0
    best, score = candidates[0]
    sure = score >= 0.62 and (len(candidates) < 2 or score - candidates[1][1] >= 0.1)
    return (best if sure else "unknown"), score


def _examples(ds: Dataset, values: DataFrame) -> dict[str, list[str]]:
    """The first distinct trimmed texts of each column: their rows from the hashes, the texts from these few rows."""
    place = F.row_number().over(Window.partitionBy("c").orderBy("first"))
    rows = values.where(F.col("h1").isNotNull()).withColumn("place", place).where(F.col("place") <= EXAMPLES).select("c", "place", "first")
    cells = F.array(*[trim_ws(ds.text(k)) for k in ds.keys])
    found = ds.df.join(F.broadcast(rows), F.col(ROW) == F.col("first")).select("c", "place", F.element_at(cells, F.col("c") + 1).alias("value"))  # EXAMPLES rows a column
    out: dict[str, list[str]] = {}
    for r in found.orderBy("c", "place").collect():
        out.setdefault(ds.keys[r.c], []).append(r.value)
    return out


def profile(ds: Dataset) -> list[ColumnProfile]:
    """Profiles of all columns; also sets the dataset's semantic types."""
    values = materialize(column_values(ds), "values")
    counts = {r.column: r for r in _counts(ds, values, ds.keys).collect()}
    shown, firsts = _examples(ds, values), {}
    for r in first_cells(ds, VARIANT_SAMPLE).orderBy("column", "place").collect():
        firsts.setdefault(r.column, []).append(r.value)
    discard(values)
    out = []
    for k in ds.keys:
        c, first = counts[k], firsts.get(k, [])
        kinds = list(c.types)
        data_type = "empty" if not c.non_empty else kinds[0] if len(kinds) == 1 else "mixed"
        shapes = [re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", v)) for v in first]
        candidates = semantic_candidates(ds.headers[k], first)
        semantic, confidence = select_semantic(candidates)
        out.append(ColumnProfile(k, ds.headers[k], data_type, c.non_empty, c.missing, c.unique_values, shown.get(k, []), list(dict.fromkeys(shapes))[:VARIANTS], candidates, semantic, confidence))
        ds.semantic[k] = semantic
    if out and not any(p.non_empty for p in out):
        ds.warnings.append("The dataset has no rows.")
    if not any(p.semantic != "unknown" for p in out):
        ds.warnings.append("No column has a confidently recognized type.")
    return out


def first_formats(ds: Dataset, sample: int = VARIANT_SAMPLE, most: int = VARIANTS) -> DataFrame:
    """The first ``most`` distinct shapes among the first ``sample`` non-empty cells of each column, ``(column, place, shape)``."""
    shapes = first_cells(ds, sample).groupBy("column", phone_shape(F.col("value")).alias("shape")).agg(F.min("place").alias("at"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("at"))
    return shapes.withColumn("place", place).where(F.col("place") <= most).select("column", "place", "shape")


def format_variants(ds: Dataset, key: str) -> DataFrame:
    """Shapes of all values of a column with their counts and first rows."""
    return ds.df.where(~ds.missing(key)).groupBy(phone_shape(ds.text(key)).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row"))


def any_missing(ds: Dataset) -> DataFrame:
    return ds.df.where(reduce(lambda a, b: a | b, [ds.missing(k) for k in ds.keys])).select(ROW)
