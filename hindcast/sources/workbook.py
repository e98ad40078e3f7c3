"""Decode one sheet of one workbook into rows of text; runs inside Spark tasks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from decimal import Decimal
from xml.etree import ElementTree

# Numbers of the built-in formats for dates and times.
DATE_FORMATS = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _number(text: str) -> str:
    """Plain decimal spelling: whole numbers without a point, never an exponent."""
    value = float(text)
    if value.is_integer():
        return str(int(value))
    return format(Decimal(repr(value)), "f")


def _text(element) -> str:
    """Text of a string item, rich runs joined, phonetic hints left out."""
    parts = []
    for child in element:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts.append(_text(child))
    return "".join(parts)


def _column(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _sheet_member(book: zipfile.ZipFile, sheet: str | None) -> str | None:
    """Archive member of the named sheet, or of the first one; None when it is absent."""
    target_id = None
    for node in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(node.tag) == "sheet" and sheet in (None, node.get("name")):
            target_id = node.get(_REL_ID)
            break
    if target_id is None:
        return None
    for node in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if node.get("Id") == target_id:
            return posixpath.normpath(posixpath.join("/xl", node.get("Target"))).lstrip("/")
    return None


def _elements(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind as they end; each leaves its parent, so that none is held on to."""
    open_: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            open_.append(node)
            continue
        open_.pop()
        if _local(node.tag) == tag:
            yield node
            if open_:
                open_[-1].remove(node)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as stream:
        for node in _elements(stream, "si"):
            strings.append(_text(node))
    return strings


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Style numbers under which a sheet shows a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(DATE_FORMATS)
    for node in root.iter():
        if _local(node.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", node.get("formatCode", "")).lower()
            if re.search("[ymdh]", code):
                dated.add(int(node.get("numFmtId")))
    cell_formats = next((n for n in root if _local(n.tag) == "cellXfs"), [])
    return {i for i, n in enumerate(cell_formats) if int(n.get("numFmtId", 0)) in dated}


def _date(text: str, from_1904: bool) -> str:
    """ISO text of a day number, with the time of day if there is one."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    moment = start + timedelta(seconds=round(float(text) * 86400))
    return moment.date().isoformat() if moment.time() == time() else moment.isoformat()


def _from_1904(book: zipfile.ZipFile) -> bool:
    nodes = ElementTree.fromstring(book.read("xl/workbook.xml")).iter()
    return any(_local(n.tag) == "workbookPr" and n.get("date1904") in ("1", "true") for n in nodes)


def _cell_text(cell, strings: list[str], dated: set[int], from_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        held = next((c for c in cell if _local(c.tag) == "is"), None)
        return (_text(held) if held is not None else "") or None
    value = next((c.text for c in cell if _local(c.tag) == "v"), None)
    if value is None or value == "" or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)] or None
    if kind == "b":
        return "true" if value.strip() == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dated:
        return _date(value, from_1904)
    return _number(value) if kind == "n" else value


def _filled_rows(book: zipfile.ZipFile, member: str, strings: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """(sheet row number from 0, {column: text}) of every row that holds a value."""
    number, dated, from_1904 = -1, _date_styles(book), _from_1904(book)
    with book.open(member) as stream:
        for node in _elements(stream, "row"):
            number = int(node.get("r", number + 2)) - 1
            cells, column = {}, -1
            for cell in node:
                column = _column(cell.get("r")) if cell.get("r") else column + 1
                text = _cell_text(cell, strings, dated, from_1904)
                if text is not None:
                    cells[column] = text
            if cells:
                yield number, cells


def sheet_rows(content: bytes, sheet: str | None, drop_empty: bool) -> Iterator[tuple[int, list[str | None]]]:
    """(row index, cells) of a sheet, read in two passes and never held whole.

    With ``drop_empty`` empty rows and columns go before rows and columns are
    numbered; without it the numbers are those of the sheet.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        member = _sheet_member(book, sheet)
        if member is None:
            return
        strings = _shared_strings(book)
        used: set[int] = set()
        for _, cells in _filled_rows(book, member, strings):
            used.update(cells)
        columns = sorted(used) if drop_empty else range(max(used, default=-1) + 1)
        for position, (number, cells) in enumerate(_filled_rows(book, member, strings)):
            yield (position if drop_empty else number), [cells.get(c) for c in columns]
