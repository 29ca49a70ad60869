"""Sinks: corrected CSV bytes, reviewed rows, and their guards."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import WS
from ..operators.findings import action_items, cell_affected
from .dataset import ROW, Dataset

BOM = "﻿"
EXCEL_TEXT = 32_767


def encode_cell(text: Column, guarded: Column) -> Column:
    """A CSV cell: quoted where it must be; text that a spreadsheet would run gets an apostrophe."""
    risky = text.rlike(f"^[{WS}]*[=+\\-@]") | text.rlike(r"^[\t\r\n]")
    text = F.when(guarded & risky, F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_cells(ds: Dataset) -> dict[str, Column]:
    """The encoded cell of each column; only text cells are guarded."""
    return {k: encode_cell(ds.text(k), F.col(k)["t"] == "text" if ds.tagged(k) else F.lit(isinstance(ds.kind(k), T.StringType))) for k in ds.keys}


def csv_lines(ds: Dataset, deleted: DataFrame | None = None) -> DataFrame:
    """``(_row, line)`` in row order, without the deleted rows. It can be written by any sink."""
    df = ds.df if deleted is None else ds.df.join(deleted.select(ROW), ROW, "left_anti")
    return df.select(ROW, F.concat_ws(",", *csv_cells(ds).values()).alias("line")).orderBy(ROW)


def corrected_csv(ds: Dataset, path: str, deleted: DataFrame | None = None) -> str:
    """One file with a byte order mark and CR LF line ends; rows stream through the driver in order.

    The file appears whole or not at all.
    """
    quote = lambda h: '"' + h.replace('"', '""') + '"' if any(c in h for c in '",\r\n') else h
    header = ",".join(quote("'" + h if h.lstrip()[:1] in tuple("=+-@") else h) for h in ds.headers.values())
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.write(BOM + header + "\r\n")
        for r in csv_lines(ds, deleted).toLocalIterator():
            f.write(r.line + "\r\n")
    os.replace(part, path)
    return path


def review_columns(headers: list[str]) -> list[str]:
    """Names for the added columns that no header has yet."""
    out = []
    for name in ("Action items", "Priority", "Detected issues", "Source row"):
        shown, n = name, 0
        while shown.lower() in {h.lower() for h in [*headers, *out]}:
            n += 1
            shown = f"{name} (review {n})"
        out.append(shown)
    return out


def reviewed_rows(ds: Dataset, findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Clean rows and the accepted flagged ones, with action items, priority, issues, source row and affected columns."""
    actions, priority, issues, source = review_columns(list(ds.headers.values()))
    per_row = action_items(findings).select(
        F.col("row").alias(ROW), F.array_join(F.array_distinct(F.transform("items", lambda i: i["action"])), "\n").alias(actions),
        F.element_at(F.array(*map(F.lit, ("high", "medium_high", "medium", "low_medium", "low"))), F.array_min(F.transform("items", lambda i: i["rank"])).cast("int")).alias(priority),
        F.array_join(F.transform("items", lambda i: i["explanation"]), "\n").alias(issues),
    )
    flags = findings.select(F.explode("rows").alias(ROW), "fields", "evidence")
    touched = flags.groupBy(ROW).agg(*[F.max(cell_affected(F.col("fields"), F.col("evidence"), F.col(ROW), ds.headers[k], k).cast("int")).alias(f"__{k}") for k in ds.keys])
    affected = F.array_compact(F.array(*[F.when(F.col(f"__{k}") == 1, F.lit(k)) for k in ds.keys]))
    rows = ds.df.join(per_row, ROW, "left").join(accepted.select(ROW, F.lit(True).alias("_accepted")), ROW, "left").join(touched, ROW, "left")
    rows = rows.where(F.col(issues).isNull() | F.col("_accepted"))
    return rows.select(*ds.keys, actions, priority, issues, F.col(ROW).alias(source), affected.alias("affected_columns"))


def worksheet_issues(findings: DataFrame) -> DataFrame:
    """Findings about the sheet as a whole."""
    return findings.where("scope = 'worksheet'").select("type", "severity", F.array_join("fields", ", ").alias("columns"), "explanation", "action")


def too_long_for_excel(ds: Dataset) -> DataFrame:
    """Cells beyond the text limit of a spreadsheet."""
    each = F.array(*[F.struct(F.lit(k).alias("column"), F.length(ds.text(k)).alias("n")) for k in ds.keys])
    return ds.df.select(ROW, F.explode(each).alias("c")).select(ROW, "c.*").where(F.col("n") > EXCEL_TEXT)


def check_export(ds: Dataset, findings: DataFrame, rows: DataFrame, source: str | None, path: str) -> None:
    """Refuse an export over its own source, of rows named twice, or of rows that no finding names."""
    if source and os.path.abspath(source) == os.path.abspath(path):
        raise ValueError("The export would overwrite its source.")
    named = rows.groupBy(ROW).agg(F.count(F.lit(1)).alias("n"))
    if named.where("n > 1").limit(1).count():
        raise ValueError("A row is named twice.")
    flagged = findings.select(F.explode("rows").alias(ROW)).distinct()
    if named.join(flagged, ROW, "left_anti").limit(1).count():
        raise ValueError("A row is not part of any finding.")


def reviewed_workbook(ds: Dataset, findings: DataFrame, accepted: DataFrame, path: str, warnings: Sequence[str] = (), source: str | None = None) -> str:
    """The reviewed rows as a workbook, affected cells marked; with sheets for worksheet issues and notes."""
    from .xlsx import WorkbookError, encoded_rows, write_workbook

    check_export(ds, findings, accepted, source, path)
    if too_long_for_excel(ds).limit(1).count():
        raise WorkbookError("A text is longer than a cell can hold.")
    rows = reviewed_rows(ds, findings, accepted)
    more = rows.columns[len(ds.keys) : -1]
    out = rows.select(*[ds.text(k).alias(k) for k in ds.keys], *more, "affected_columns")
    # rows come one partition at a time, encoded on the executors
    body = (r.xml for r in encoded_rows(out, more[-1], [*ds.keys, *more], [more[-1]], F.col("affected_columns")).orderBy("place").toLocalIterator())
    sheets = {"Reviewed": ([*ds.headers.values(), *more], body)}
    issues = [list(r) for r in worksheet_issues(findings).collect()]
    if issues:
        sheets["Worksheet issues"] = (["Type", "Severity", "Columns", "Issue", "Action"], issues)
    if warnings:
        sheets["Analysis notes"] = (["Note"], [[w] for w in dict.fromkeys(warnings)])
    return write_workbook(path, sheets)
