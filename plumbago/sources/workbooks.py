"""The first sheet of a workbook as text: xlsx by its own XML, xls where xlrd is installed.

Numbers are kept as the file writes them, so a whole number in a column with gaps stays one. Cells of formulas give their stored results, dates their serial numbers.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def first_sheet(blob: bytes, path: str) -> tuple[list[str], list[list[str | None]]]:
    """Column names, from the first row, and the rows below it. Columns without a name are called ``Unnamed: k``; names that come again are numbered."""
    grid = _xls(blob) if path.lower().endswith(".xls") else _xlsx(blob)
    width = max((len(r) for r in grid), default=0)
    grid = [[*r, *[None] * (width - len(r))] for r in grid]
    names: list[str] = []
    for k, n in enumerate(grid[0] if grid else []):
        n = n if n else f"Unnamed: {k}"
        again = sum(x == n or x.rpartition(".")[0] == n and x.rpartition(".")[2].isdigit() for x in names)
        names.append(f"{n}.{again}" if again else n)
    return names, grid[1:]


def _xlsx(blob: bytes) -> list[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        link = book.find(f"{_MAIN}sheets/{_MAIN}sheet").get(_LINK)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        target = targets[link]
        rows = ElementTree.fromstring(z.read(target[1:] if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}row")
        grid: list[list[str | None]] = []
        for row in rows:
            at = int(row.get("r", len(grid) + 1)) - 1
            grid += [[] for _ in range(at - len(grid))]  # rows that the file leaves out
            cells: list[str | None] = []
            for c in row:
                column = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (column - len(cells))
                cells.append(_value(c, shared))
            grid.append(cells)
    return grid


def _column(cell: str) -> int:
    n = 0
    for x in re.match("[A-Z]+", cell)[0]:
        n = n * 26 + ord(x) - 64
    return n - 1


def _value(c: ElementTree.Element, shared: list[str]) -> str | None:
    kind, v = c.get("t"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    if v is None or v.text is None:
        return None
    return shared[int(v.text)] if kind == "s" else {"0": "False", "1": "True"}.get(v.text, v.text) if kind == "b" else v.text


def _xls(blob: bytes) -> list[list[str | None]]:
    import xlrd

    sheet = xlrd.open_workbook(file_contents=blob).sheet_by_index(0)
    said = lambda v: None if v == "" else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return [[said(v) for v in sheet.row_values(k)] for k in range(sheet.nrows)]


def records(names: list[str], rows: list[list[str | None]]) -> list[tuple[int, str, dict[str, str]]]:
    """row_index, content and raw_data of the rows that say something, as operators.ingest.to_records gives them."""
    kept = [(k, n.strip()) for k, n in enumerate(names) if "Unnamed" not in n]
    out = []
    for i, r in enumerate(rows):
        parts = [f"{n}: {t}" for k, n in kept if n and (t := (r[k] or "").strip()) not in ("", "nan")]
        if parts:
            out.append((i, "; ".join(parts), {n: r[k] or "" for k, n in kept}))
    return out
