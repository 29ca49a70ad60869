"""A dataset: one table with a row identity, display headers and semantic types of its columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import cell_text, is_blank, trim_ws
from ..functions.normalize import business_value

ROW = "_row"
#: A column of an untyped source: its tag and the value of that type.
TAGGED = T.StructType([T.StructField("t", T.StringType()), T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("d", T.TimestampType())])


def column_key(header: str) -> str:
    """A header as a key: no marks, lower case, other characters as single underscores."""
    bare = "".join(c for c in unicodedata.normalize("NFD", header) if unicodedata.category(c)[0] != "M").lower()
    return re.sub(r"[^a-z0-9]+", "_", bare).strip("_")


def name_columns(headers: Sequence) -> tuple[list[tuple[str, str]], list[str]]:
    """Keys and display headers, each made unique, and a warning for each header that had to change."""
    out, warnings, keys, shown = [], [], {}, {}
    for place, raw in enumerate(headers, 1):
        text = str(raw).strip() if raw is not None else ""
        if not text:
            text = f"Column {place}"
            warnings.append(f"Column {place} has no header; it is called {text}.")
        shown[text] = shown.get(text, 0) + 1
        header = text if shown[text] == 1 else f"{text} ({shown[text]})"
        if shown[text] > 1:
            warnings.append(f"The header {text} repeats; it is called {header}.")
        key = column_key(text) or f"column_{place}"
        keys[key] = keys.get(key, 0) + 1
        out.append((key if keys[key] == 1 else f"{key}_{keys[key]}", header))
    return out, warnings


def detect_header_row(matrix: Sequence[Sequence], limit: int = 20) -> int:
    """The 1-based row among the first ``limit`` that looks most like a header."""
    missing = lambda v: v is None or str(v).strip() == ""
    best, at = None, 1
    for i, row in enumerate(matrix[:limit]):
        cells = [v for v in row if not missing(v)]
        if not cells:
            continue
        labels = [str(v).strip().lower() for v in cells]
        unique = len(set(labels))
        texts = sum(isinstance(v, str) for v in cells)
        after = matrix[i + 1] if i + 1 < len(matrix) else []
        density = sum(not missing(v) for v in after) / max(len(row), 1)
        score = 2 * len(cells) + 4 * unique / len(cells) + 3 * texts / len(cells) + 2 * density - 2 * (len(cells) - unique)
        if best is None or score > best:
            best, at = score, i + 1
    return at


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows of a read of files with ``_row``: numbered from 2 in the order of the files and of the rows in them, without a sort.

    Rows of a split of a file follow each other in a task, so a split's first number and its place
    among the splits (a row of the driver for each) make a row's number.
    """
    place = df.withColumns({"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start"), "_n": F.monotonically_increasing_id()})
    splits = place.groupBy("_file", "_from").agg(F.min("_n").alias("first"), F.count(F.lit(1)).alias("rows")).collect()
    total, starts = 2, []
    for r in sorted(splits, key=lambda r: (r["_file"], r["_from"])):
        starts.append((r["_file"], r["_from"], total - r["first"]))
        total += r["rows"]
    at = df.sparkSession.createDataFrame(starts, "_file string, _from long, _shift long")  # Spark sees its size
    return place.join(at, ["_file", "_from"]).withColumn(ROW, F.col("_n") + F.col("_shift")).select(*df.columns, ROW)


@dataclass
class Dataset:
    """``df`` has the identity column ``_row`` and one column for each key of ``headers``, in sheet order."""

    df: DataFrame
    headers: dict[str, str]
    name: str = "data"
    semantic: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    #: What the source's files were when it was loaded, and where they are; see ``versions``.
    version: object = None
    paths: list[str] = field(default_factory=list)

    @classmethod
    def from_df(cls, df: DataFrame, row: str | Column | None = None, headers: dict[str, str] | None = None, name: str = "data", order: Sequence[str] = ()) -> Dataset:
        """``row``: a key column with unique integers. Without one, rows are numbered from 2 in the order of ``order`` (all columns, if not given): a sort by ranges, written once."""
        if row is not None:
            df = df.withColumn(ROW, (F.col(row) if isinstance(row, str) else row).cast("long"))
        elif ROW not in df.columns:
            from ..operators.ranks import numbered

            placed = numbered(df, [F.col(c) if isinstance(c, str) else c for c in (order or df.columns)], at=ROW, of="_of")
            df = placed.drop("_of").withColumn(ROW, F.col(ROW) + 2)
        columns = [c for c in df.columns if c != ROW]
        return cls(df, {c: (headers or {}).get(c, c) for c in columns}, name)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, **options) -> Dataset:
        """Without a key column, rows are numbered from 2 as they stand in the files."""
        df = spark.read.parquet(path)
        return cls.from_df(df if options.get("row") is not None or options.get("order") else in_file_order(df), **options)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, **options) -> Dataset:
        """All columns as text, under cleaned keys, rows numbered as they stand in the file; blank rows go."""
        df = spark.read.option("header", True).option("multiLine", True).csv(path)
        named, warnings = name_columns(df.columns)
        if options.get("row") is None and not options.get("order"):
            df = in_file_order(df)
        out = cls.from_df(df.toDF(*[k for k, _ in named], *[c for c in df.columns if c == ROW]), headers=dict(named), **options)
        out.warnings = warnings
        return out.without_blank_rows()

    @classmethod
    def from_xlsx(cls, spark: SparkSession, path: str, sheet: str | None = None) -> Dataset:
        from .xlsx import read_dataset

        return read_dataset(spark, path, sheet)

    @property
    def keys(self) -> list[str]:
        return list(self.headers)

    def kind(self, key: str) -> T.DataType:
        return self.df.schema[key].dataType

    def tagged(self, key: str) -> bool:
        return isinstance(self.kind(key), T.StructType)

    def text(self, key: str) -> Column:
        if self.tagged(key):
            cell = F.col(key)
            parts = [cell_text(cell["n"], T.DoubleType()), cell_text(cell["b"], T.BooleanType()), cell_text(cell["d"], T.TimestampType()), F.coalesce(cell["s"], F.lit(""))]
            return F.when(cell["t"] == "number", parts[0]).when(cell["t"] == "boolean", parts[1]).when(cell["t"] == "date", parts[2]).otherwise(parts[3])
        return cell_text(F.col(key), self.kind(key))

    def tag(self, key: str) -> Column:
        """The type of a cell: text, number, date, boolean, or null where it is missing."""
        if self.tagged(key):
            found = F.col(key)["t"]
        else:
            kind = self.kind(key)
            found = F.lit("number" if isinstance(kind, T.NumericType) else "date" if isinstance(kind, (T.DateType, T.TimestampType)) else "boolean" if isinstance(kind, T.BooleanType) else "text")
        return F.when(~self.missing(key), found)

    def number(self, key: str) -> Column | None:
        """The cell as a number for ranges; None if the column holds text."""
        kind = self.kind(key)
        if self.tagged(key):
            plain = trim_ws(F.coalesce(F.col(key)["s"], F.lit("")))
            return F.when(F.col(key)["t"] == "number", F.col(key)["n"]).when((F.col(key)["t"] == "text") & plain.rlike(r"^[+-]?(\d+(\.\d+)?|\.\d+)$"), plain.try_cast("double"))
        if isinstance(kind, T.StringType):
            return None
        return F.col(key).cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")

    def missing(self, key: str) -> Column:
        return is_blank(self.text(key))

    def business(self, key: str, token: str | None = None) -> Column:
        return business_value(self.text(key), token or self.headers[key])

    def without_blank_rows(self) -> Dataset:
        alive = F.lit(False)
        for key in self.keys:
            alive = alive | ~self.missing(key)
        return Dataset(self.df.where(alive), self.headers, self.name, self.semantic, self.warnings, self.version, self.paths)
