"""Containers of office documents, opened inside Spark tasks.

The readers only unpack a file into raw items - the lines of a page, the paragraphs
under a heading, a table row with its header. What an item means (labels, locators,
headings by font size) is decided by Spark expressions in `operators.segments`.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, time, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MIN_HEADER_CELLS = 3  # fixed value: filled cells that make a sheet row its header

_LINES = pa.list_(pa.struct([("size", pa.float64()), ("text", pa.string())]))
ITEMS_ARROW = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("number", pa.int32()),  # page number, or row number below the header
            ("place", pa.string()),  # locator of a section, locator prefix of a row
            ("title", pa.string()),
            ("text", pa.string()),
            ("lines", _LINES),
            ("header", pa.list_(pa.string())),
            ("cells", pa.list_(pa.string())),
        ]
    )
)
ITEMS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("number", T.IntegerType()),
            T.StructField("place", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField(
                "lines",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("size", T.DoubleType()),
                            T.StructField("text", T.StringType()),
                        ]
                    )
                ),
            ),
            T.StructField("header", T.ArrayType(T.StringType())),
            T.StructField("cells", T.ArrayType(T.StringType())),
        ]
    )
)

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xml(archive: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(archive.read(name))
    except KeyError:
        return None


def _row_items(
    header: list[str], rows: Iterator[tuple[int, list[str]]], place: str, title: str | None
) -> Iterator[dict]:
    """Table rows below their header that hold at least one labelled value."""
    for number, cells in rows:
        if any(label and value for label, value in zip(header, cells)):
            yield {
                "kind": "tabellenzeile",
                "number": number,
                "place": place,
                "title": title,
                "header": header,
                "cells": cells,
            }


# ---------------------------------------------------------------- word processing


def _run_text(node) -> str:
    pieces = []
    for run in node:
        if run.tag == _W + "hyperlink":
            pieces.append(_run_text(run))
        elif run.tag == _W + "r":
            for item in run:
                if item.tag == _W + "t":
                    pieces.append(item.text or "")
                elif item.tag == _W + "tab":
                    pieces.append("\t")
                elif item.tag in (_W + "br", _W + "cr"):
                    if item.get(_W + "type") in (None, "textWrapping"):
                        pieces.append("\n")
                elif item.tag == _W + "noBreakHyphen":
                    pieces.append("-")
    return "".join(pieces)


def _heading_styles(archive: zipfile.ZipFile) -> set[str]:
    """Ids of paragraph styles named as a heading or title."""
    styles = _xml(archive, "word/styles.xml")
    found = set()
    for style in () if styles is None else styles.iter(_W + "style"):
        name = style.find(_W + "name")
        value = "" if name is None else name.get(_W + "val", "")
        if re.match(r"heading \d", value) or value.startswith(("Heading", "Überschrift", "Title")):
            found.add(style.get(_W + "styleId"))
    return found


def _table_rows(table) -> list[list[str]]:
    """Cell texts per row; a merged cell repeats in every column and row it covers."""
    grid: list[list[str]] = []
    for row in table.findall(_W + "tr"):
        cells: list[str] = []
        for cell in row.findall(_W + "tc"):
            span = cell.find(f"{_W}tcPr/{_W}gridSpan")
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            width = 1 if span is None else int(span.get(_W + "val", "1"))
            continued = merge is not None and merge.get(_W + "val", "continue") == "continue"
            if continued and grid and len(grid[-1]) > len(cells):
                text = grid[-1][len(cells)]
            else:
                text = "\n".join(_run_text(p) for p in cell.findall(_W + "p")).strip()
            cells += [text] * width
        grid.append(cells)
    return grid


def docx_items(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        headings = _heading_styles(archive)
        body = _xml(archive, "word/document.xml").find(_W + "body")
    heading: str | None = None
    paragraphs: list[str] = []
    sections = tables = 0

    def section() -> Iterator[dict]:
        nonlocal sections
        if paragraphs:
            sections += 1
            yield {
                "kind": "abschnitt",
                "place": heading or f"Abschnitt {sections}",
                "title": heading,
                "text": "\n".join(paragraphs),
            }
            paragraphs.clear()

    for node in body:
        if node.tag == _W + "p":
            text = _run_text(node).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            if text and style is not None and style.get(_W + "val") in headings:
                yield from section()
                heading = text
            elif text:
                paragraphs.append(text)
        elif node.tag == _W + "tbl":
            yield from section()
            tables += 1
            header, *rows = _table_rows(node) or [[]]
            yield from _row_items(header, enumerate(rows, 1), f"Tabelle {tables}", heading)
            heading = None  # what follows a table is no longer under its heading
    yield from section()


# ---------------------------------------------------------------- spreadsheets

# Built-in number formats that show a date or a time.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _date_styles(archive: zipfile.ZipFile) -> list[bool]:
    styles = _xml(archive, "xl/styles.xml")
    if styles is None:
        return []
    custom = {}
    for fmt in styles.iter(_X + "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", fmt.get("formatCode", ""))
        custom[int(fmt.get("numFmtId"))] = bool(re.search("[dmyhs]", code, re.I))
    cell_formats = styles.find(_X + "cellXfs")
    if cell_formats is None:
        return []
    ids = [int(xf.get("numFmtId", "0")) for xf in cell_formats]
    return [custom.get(i, i in DATE_FORMATS) for i in ids]


def _serial_value(serial: float, epoch_1904: bool) -> object:
    if 0 <= serial < 1:
        return (datetime.min + timedelta(seconds=round(serial * 86400))).time()
    if epoch_1904:
        start = datetime(1904, 1, 1)
    else:  # the format counts a 29 February 1900 that never was
        start = datetime(1899, 12, 31 if serial < 60 else 30)
    return start + timedelta(seconds=round(serial * 86400))


def format_cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, (datetime, date)) and not isinstance(value, time):
        return f"{value.day:02d}.{value.month:02d}.{value.year:04d}"
    return str(value).strip()


def _cell_value(cell, strings: list[str], dates: list[bool], epoch_1904: bool) -> object:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_X + "t"))
    node = cell.find(_X + "v")
    raw = None if node is None else node.text
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return raw == "1"
    if kind == "d":
        return datetime.fromisoformat(raw)
    if kind != "n":
        return raw
    style = int(cell.get("s", "0"))
    if style < len(dates) and dates[style]:
        return _serial_value(float(raw), epoch_1904)
    return float(raw) if re.search("[.eE]", raw) else int(raw)


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _phonetic_free(item) -> str:
    return "".join(
        t.text or "" for part in item if part.tag != _X + "rPh" for t in part.iter(_X + "t")
    )


def _sheet_rows(
    content, strings: list[str], dates: list[bool], epoch_1904: bool
) -> Iterator[tuple[int, list[str]]]:
    """Row number and cell texts of the rows that hold any text."""
    row_no = 0
    for row in content.iter(_X + "row"):
        row_no = int(row.get("r", row_no + 1))
        cells: list[str] = []
        for cell in row.findall(_X + "c"):
            at = _column(cell.get("r")) if cell.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            cells[at] = format_cell(_cell_value(cell, strings, dates, epoch_1904))
        if any(cells):
            yield row_no, cells


def _sheet_items(title: str, rows: Iterator[tuple[int, list[str]]]) -> Iterator[dict]:
    """Text above the header row as one section, then one item per row below it.

    A sheet without a header row has no items.
    """
    above, last = "", 0
    for row_no, cells in rows:
        filled = [c for c in cells if c]
        if len(filled) >= MIN_HEADER_CELLS:
            if above.strip():
                yield {
                    "kind": "abschnitt",
                    "place": f"{title}, Kopf",
                    "title": title,
                    "text": above.strip(),
                }
            below = ((number - row_no, values) for number, values in rows)
            yield from _row_items(cells, below, title, title)
            return
        above += "\n" * (row_no - last) + " ".join(filled)
        last = row_no


def xlsx_items(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared = _xml(archive, "xl/sharedStrings.xml")
        strings = [] if shared is None else [_phonetic_free(i) for i in shared.iter(_X + "si")]
        dates = _date_styles(archive)
        book = _xml(archive, "xl/workbook.xml")
        properties = book.find(_X + "workbookPr")
        epoch_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        links = {r.get("Id"): r.get("Target") for r in _xml(archive, "xl/_rels/workbook.xml.rels")}
        for sheet in book.iter(_X + "sheet"):
            target = links[sheet.get(_R + "id")]
            content = _xml(
                archive, target.lstrip("/") if target.startswith("/") else "xl/" + target
            )
            if content is not None and content.tag == _X + "worksheet":
                rows = _sheet_rows(content, strings, dates, epoch_1904)
                yield from _sheet_items(sheet.get("name"), rows)


# ---------------------------------------------------------------- pages


def pdf_items(data: bytes) -> Iterator[dict]:
    """One item per page with text, in compatibility form (no ligatures)."""
    from citewerk.sources.pdf import pages

    for page_no, lines in enumerate(pages(data), start=1):
        sized = [
            {"size": size, "text": unicodedata.normalize("NFKC", text)} for size, text in lines
        ]
        text = "\n".join(line["text"] for line in sized).strip()
        if text:  # blank pages have no item but keep their number
            yield {"kind": "seite", "number": page_no, "text": text, "lines": sized}


READERS = {".pdf": pdf_items, ".docx": docx_items, ".xlsx": xlsx_items}


def read_items(file_name: str, data: bytes) -> list[dict]:
    """Raw items of one file by its suffix; a further format is one more reader."""
    suffix = "." + file_name.rsplit(".", 1)[-1].lower() if "." in file_name else ""
    reader = READERS.get(suffix)
    if reader is None:
        raise ValueError(f"Nicht unterstützte Dateiendung: {suffix or file_name}")
    return list(reader(data))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # File by file: a batch of large originals must not be unpacked at once.
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            name = row.column("file_name")[0].as_py()
            items = read_items(name, row.column("content")[0].as_py())
            rest = row.drop_columns(["content"])
            yield rest.append_column(
                pa.field("items", ITEMS_ARROW), pa.array([items], ITEMS_ARROW)
            )


def unpack(files: DataFrame) -> DataFrame:
    """Replace `content` by `items`. An operator of its own, so that nothing derived from
    the items makes Catalyst repeat the reading."""
    kept = [f for f in files.schema if f.name != "content"]
    columns = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("items", ITEMS)])
    return files.select(*columns, "content").mapInArrow(_unpack, schema)
