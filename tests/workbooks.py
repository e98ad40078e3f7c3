"""Write small workbooks and sheet rows by hand."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _letters(index: int) -> str:
    text = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        text = chr(65 + rest) + text
    return text


def write_workbook(path, sheets: dict[str, list[list]], inline: bool = False) -> None:
    """Save sheets given as rows of str, int, float, bool or None; None cells are left out."""
    strings: list[str] = []
    members = {}
    for number, rows in enumerate(sheets.values(), 1):
        lines = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, value in enumerate(row):
                place = f'r="{_letters(c)}{r}"'
                if value is None:
                    continue
                if isinstance(value, bool):
                    cells.append(f'<c {place} t="b"><v>{int(value)}</v></c>')
                elif isinstance(value, (int, float)):
                    cells.append(f"<c {place}><v>{value!r}</v></c>")
                elif inline:
                    cells.append(f'<c {place} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
                else:
                    strings.append(value)
                    cells.append(f'<c {place} t="s"><v>{len(strings) - 1}</v></c>')
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
        members[f"xl/worksheets/sheet{number}.xml"] = (
            f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
        )
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    members["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    members["xl/_rels/workbook.xml.rels"] = (
        f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    )
    if strings:
        items = "".join(
            f'<si><r><t xml:space="preserve">{escape(s[:1])}</t></r><r><t xml:space="preserve">{escape(s[1:])}</t></r></si>'
            for s in strings
        )
        members["xl/sharedStrings.xml"] = f'<sst xmlns="{_MAIN}">{items}</sst>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in members.items():
            book.writestr(name, text)


NAMES = ["batch", "parent_code", "parent_description", "material_code", "type"]


def separate_header(months: list[str]) -> list[list]:
    """Names below the month row, with a label over a month column that means nothing."""
    n = len(months)
    return [
        ["Sum of qty", None, None, None, None, "fy_month_no", "date"] + [None] * (n - 2),
        [None] * 5 + [f"{i:02d}" for i in range(1, n + 1)],
        [None] * 5 + [f" {m} " for m in months],
        NAMES + [None] * n,
    ]


def merged_header(months: list[str]) -> list[list]:
    """Names and months in one row."""
    n = len(months)
    return [["Sum of qty"] + [None] * (4 + n), [None] * 5 + [f"2027_{i:02d}" for i in range(1, n + 1)], NAMES + months]


def sheet_rows(spark, files: dict[str, list[list]]):
    """Files given as rows of cells, as a table of single sheet rows."""
    from hindcast.sources.sheets import SHEET_ROWS

    data = [
        (name, i, [None if c is None else str(c) for c in row]) for name, rows in files.items() for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(data, SHEET_ROWS)


def sheet_chunks(spark, files: dict[str, list[list]], size: int = 2):
    """The same files as chunks of ``size`` rows."""
    from hindcast.sources.sheets import SHEET_CHUNKS

    data = []
    for name, rows in files.items():
        rows = [(i, [None if c is None else str(c) for c in row]) for i, row in enumerate(rows)]
        for start in range(0, max(len(rows), 1), size):
            data.append((name, start // size, rows[:6], rows[start : start + size]))
    return spark.createDataFrame(data, SHEET_CHUNKS)


def grid_folder(spark, files: dict[str, list[list]], form: str = "rows", settled: bool = False):
    """Files of a grid folder, parsed from chunks or from single rows."""
    from hindcast.plans.history import GridFolder

    if form == "chunks":
        return GridFolder(chunks=sheet_chunks(spark, files), settled=settled)
    return GridFolder(rows=sheet_rows(spark, files), settled=settled)
