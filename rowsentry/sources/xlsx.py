"""Workbooks: a worksheet in as a data source of Spark, reviewed rows out.

A worksheet is one XML part in a zip. Its tasks each take a range of the part's bytes: they inflate
up to it, which is quick, and parse the rows that begin in it, which is not. So no process holds a
sheet, and the driver sees the first rows only. The file must be on a path that all executors see.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import cached_property
from itertools import chain
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.cells import trim_ws
from ..operators.ranks import numbered
from .dataset import ROW, TAGGED, Dataset, detect_header_row, name_columns
from .export import EXCEL_TEXT
from .shared import materialize
from .versions import Manifest

#: What a workbook may hold.
MOST_BYTES, MOST_ROWS, MOST_COLUMNS = 300 << 20, 1_100_000, 16_500
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_EPOCH = datetime(1899, 12, 30, tzinfo=timezone.utc)
SLICE = 10_000


class WorkbookError(ValueError):
    """The file isn't a workbook that can be read."""


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


class Workbook:
    def __init__(self, path: str):
        if not path.lower().endswith(".xlsx"):
            raise WorkbookError("Only .xlsx workbooks can be read.")
        if os.path.getsize(path) > MOST_BYTES:
            raise WorkbookError("The workbook is larger than 300 MB.")
        try:
            self.zip = zipfile.ZipFile(path)
            book = ET.fromstring(self.zip.read("xl/workbook.xml"))
            rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
            raise WorkbookError("The file is not a workbook.") from e
        self.sheets = {}
        for s in book.iter(f"{_MAIN}sheet"):
            target = rels[s.get(f"{_REL}id")]
            self.sheets[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    @cached_property
    def strings(self) -> list[str]:
        return self._strings()

    @cached_property
    def styles(self) -> tuple[set[int], dict[int, int]]:
        return self._styles()

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]

    def _styles(self) -> tuple[set[int], dict[int, int]]:
        """Cell styles that show dates, and those that pad numbers with zeros to a width."""
        if "xl/styles.xml" not in self.zip.namelist():
            return set(), {}
        root = ET.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
        dates, padded = set(), {}
        for i, xf in enumerate(root.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf")):
            number = int(xf.get("numFmtId", 0))
            code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(number, ""))
            if number in _DATE_FORMATS or re.search("[ymdhs]", code, re.IGNORECASE) and number in own:
                dates.add(i)
            elif re.fullmatch("0{2,}", code):
                padded[i] = len(code)
        return dates, padded

    def _value(self, cell: ET.Element):
        kind, style = cell.get("t", "n"), int(cell.get("s", 0))
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        v = cell.find(f"{_MAIN}v")
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind in ("str", "e"):
            return v.text
        if kind == "b":
            return v.text == "1"
        if kind == "d":
            return datetime.fromisoformat(v.text.replace("Z", "+00:00"))
        number = float(v.text)
        dates, padded = self.styles
        if style in dates:
            return _EPOCH + timedelta(days=number)
        width = padded.get(style, 0)
        if width and number == int(number) and len(str(int(number))) < width:
            return str(int(number)).zfill(width)  # leading zeros are part of the value
        return number

    def size(self, sheet: str) -> int:
        """Bytes of a sheet's XML."""
        return self.zip.getinfo(self.sheets[sheet]).file_size

    def numbered(self, sheet: str) -> bool:
        """Whether rows tell their numbers; else they can only be counted from the first on."""
        with self.zip.open(self.sheets[sheet]) as f:
            found = _ROW_TAG.search(head := f.read(HEAD))
            return found is None or b" r=" in head[found.start() : head.find(b">", found.start())]

    def rows(self, sheet: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, list]]:
        """Row numbers and cells of the rows that begin in a range of the sheet's bytes, trailing empty cells cut."""
        with self.zip.open(self.sheets[sheet]) as f:
            root = re.search(rb"<(\w+:)?worksheet\b[^>]*>", f.read(HEAD))
            if root is None:
                raise WorkbookError("The sheet is not a worksheet.")
            parser = ET.XMLPullParser(["end"])
            parser.feed(root[0])
            f.seek(start)
            last = 0
            for piece in _from_row_to_row(f, start, self.size(sheet) if end is None else end):
                parser.feed(piece)
                for _, el in parser.read_events():
                    if el.tag == f"{_MAIN}row":
                        last = number = int(el.get("r", last + 1))
                        if number > MOST_ROWS:
                            raise WorkbookError("The sheet has too many rows.")
                        yield number, self._cells(el)
                        el.clear()

    def _cells(self, row: ET.Element) -> list:
        cells: list = []
        for i, c in enumerate(row):
            at = _column(c.get("r")) if c.get("r") else i
            if at >= MOST_COLUMNS:
                raise WorkbookError("The sheet has too many columns.")
            cells += [None] * (at + 1 - len(cells))
            cells[at] = self._value(c)
        while cells and (cells[-1] is None or cells[-1] == ""):
            cells.pop()
        return cells


_ROW_TAG, _END_TAG = re.compile(rb"<(?:\w+:)?row[\s>/]"), re.compile(rb"</(?:\w+:)?sheetData>")
#: Bytes in which a sheet's root and first row are looked for, that are read at once, and of a task's range.
HEAD, READ, RANGE = 1 << 16, 1 << 20, 16 << 20


def _from_row_to_row(f, start: int, end: int) -> Iterator[bytes]:
    """What a sheet holds from the first row that begins in a range up to the first that begins behind it.

    ``f`` stands at ``start``. A tag that lies across two reads is found with the later one.
    """
    held, at, inside = b"", start, False
    while True:
        new = f.read(READ)
        held += new
        if not inside:
            first = _ROW_TAG.search(held)
            if first is None or at + first.start() >= end:
                if not new or at + len(held) >= end + 16:
                    return
                keep = min(len(held), 16)
                at, held = at + len(held) - keep, held[len(held) - keep :]
                continue
            at, held, inside = at + first.start(), held[first.start() :], True
        stop = _ROW_TAG.search(held, max(0, end - at)) if at + len(held) > end else None
        if stop is not None and at + stop.start() < end:
            stop = None
        last = _END_TAG.search(held)
        cuts = [m.start() for m in (stop, last) if m is not None]
        if cuts or not new:
            yield held[: min(cuts)] if cuts else held
            return
        keep = min(len(held), 16)
        yield held[: len(held) - keep]
        at, held = at + len(held) - keep, held[len(held) - keep :]


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("sheet", name).load(path)``: ``_row`` and tagged ``cells`` of each row."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(ROW, T.LongType()), T.StructField("cells", T.ArrayType(TAGGED))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), int(self.options.get("range", RANGE)))


@dataclass
class Range(InputPartition):
    start: int
    end: int


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, size: int):
        self.path, self.sheet, self.size = path, sheet, size

    def partitions(self) -> list[Range]:
        book = Workbook(self.path)
        sheet = self.sheet or next(iter(book.sheets))
        total = book.size(sheet)
        step = self.size if book.numbered(sheet) else max(total, 1)
        return [Range(k, min(k + step, total)) for k in range(0, max(total, 1), step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        book = Workbook(self.path)
        for number, cells in book.rows(self.sheet or next(iter(book.sheets)), partition.start, partition.end):
            yield number, [tag(v) for v in cells]


def tag(value) -> tuple | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return ("boolean", None, None, value, None)
    if isinstance(value, (int, float)):
        return ("number", None, float(value), None, None)
    if isinstance(value, datetime):
        return ("date", None, None, None, value)
    return ("text", str(value), None, None, None)


def untag(cell):
    """The value of a tagged cell."""
    return None if cell is None else {"number": cell.n, "boolean": cell.b, "date": cell.d}.get(cell.t, cell.s)


def from_records(spark: SparkSession, headers: Sequence, rows: Sequence[tuple[int, Sequence]], name: str = "data") -> Dataset:
    """A dataset of tagged cells from (row number, cells)."""
    named, warnings = name_columns(headers)
    schema = T.StructType([T.StructField(ROW, T.LongType()), *(T.StructField(k, TAGGED) for k, _ in named)])
    width = len(named)
    slices: list[DataFrame] = []
    for k in range(0, len(rows), SLICE):
        data = [(n, *[tag(v) for v in [*cells, *[None] * width][:width]]) for n, cells in rows[k : k + SLICE]]
        slices.append(spark.createDataFrame(data, schema))
    df = slices[0] if slices else spark.createDataFrame([], schema)
    for more in slices[1:]:
        df = df.union(more)
    return Dataset(df, dict(named), name, warnings=warnings)


def read_dataset(spark: SparkSession, path: str, sheet: str | None = None, size: int = RANGE) -> Dataset:
    """A worksheet (the first, if none is named) as a dataset; rows without a value go.

    The sheet is parsed once, on the executors, and kept in the shared folder.
    """
    sheet = sheet or next(iter(Workbook(path).sheets))
    spark.dataSource.register(WorkbookSource)
    rows = materialize(spark.read.format("workbook").option("sheet", sheet).option("range", str(size)).load(path), "sheet")
    first = rows.orderBy(ROW).limit(20).collect()
    if not first:
        return from_records(spark, [], [], sheet)
    plain = [[untag(c) for c in r.cells] for r in first]
    head = detect_header_row(plain)
    at = first[head - 1][ROW]
    width = rows.where(F.col(ROW) >= at).agg(F.max(F.size("cells"))).first()[0]
    named, warnings = name_columns([*plain[head - 1], *[None] * width][:width])
    filled = F.exists("cells", lambda c: c["t"].isNotNull() & ((c["t"] != "text") | (F.length(trim_ws(c["s"])) > 0)))
    body = rows.where((F.col(ROW) > at) & filled).select(ROW, *[F.get("cells", F.lit(i)).alias(k) for i, (k, _) in enumerate(named)])
    out = Dataset(body, dict(named), sheet, warnings=warnings)
    out.version = Manifest.of_paths(spark, [f"file://{os.path.abspath(path)}"])
    return out


def write_workbook(path: str, sheets: dict[str, tuple[Sequence[str], Iterator[Sequence]]], marked: dict[str, set[tuple[int, int]]] | None = None) -> str:
    """Write sheets (headers and rows); ``marked`` cells (row, column from 0) get a red fill. The file appears whole or not at all.

    Rows stream into the file one after the other; a text among them is a row that has been encoded before (see ``encoded_rows``).
    """
    part = f"{path}.part"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}<Relationship Id="rs" Type="{_REL[1:-1]}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="3"><fill/><fill/><fill><patternFill patternType="solid"><fgColor rgb="FFFFC7CE"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>')
        for i, (name, (headers, rows)) in enumerate(sheets.items(), 1):
            red = (marked or {}).get(name, set())
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                for r, row in enumerate(chain([headers], rows)):
                    f.write((row if isinstance(row, str) else f'<row r="{r + 1}">' + "".join(_cell(v, (r - 1, c) in red) for c, v in enumerate(row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    os.replace(part, path)
    return path


def encoded_rows(df: DataFrame, order: str, columns: Sequence[str], numbers: Sequence[str] = (), red: Column | None = None) -> DataFrame:
    """The rows of a sheet, in order, each as its XML: ``place, xml``. ``red``: the array of columns whose cells are marked.

    Cells are text except those of ``numbers``. The XML is made on the executors; the first row is the header's.
    """
    placed = numbered(df, [F.col(order)], at="place", of="_of").drop("_of")

    def cell(name: str) -> Column:
        style = F.when(F.array_contains(red, name), ' s="1"').otherwise("") if red is not None else F.lit("")
        text = F.col(name).cast("string")
        if name in numbers:
            full = F.concat(F.lit("<c"), style, F.lit("><v>"), text, F.lit("</v></c>"))
        else:
            plain = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
            for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                plain = F.replace(plain, F.lit(raw), F.lit(shown))
            full = F.concat(F.lit('<c t="inlineStr"'), style, F.lit('><is><t xml:space="preserve">'), plain, F.lit("</t></is></c>"))
        return F.when(text.isNull(), F.concat(F.lit("<c"), style, F.lit("/>"))).otherwise(full)

    xml = F.concat(F.lit('<row r="'), (F.col("place") + 2).cast("string"), F.lit('">'), *map(cell, columns), F.lit("</row>"))
    return placed.select("place", xml.alias("xml"))


def _cell(v, red: bool) -> str:
    style = ' s="1"' if red else ""
    if v is None:
        return f"<c{style}/>"
    if isinstance(v, bool):
        return f'<c t="b"{style}><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f"<c{style}><v>{v}</v></c>"
    text = str(v)
    if len(text) > EXCEL_TEXT:
        raise WorkbookError("A text is longer than a cell can hold.")
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return f'<c t="inlineStr"{style}><is><t xml:space="preserve">{escape(text)}</t></is></c>'
