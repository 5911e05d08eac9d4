"""Office Open XML workbooks to cell grids."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, types as T

from almanac.schemas import GRID_SCHEMA
from almanac.session import written

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_CELL = re.compile(r"([A-Z]+)(\d+)")
_SMALL = 1 << 24  # bytes of a sheet that is parsed at once


def _column_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _text_of(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _rows_of(book: zipfile.ZipFile, name: str) -> Iterator[ElementTree.Element]:
    """The rows of a sheet; a long one is never held whole, and of a broken one those before the fault come first."""
    if book.getinfo(name).file_size <= _SMALL:
        try:
            sheet = ElementTree.fromstring(book.read(name))
        except Exception:  # it is read again, row by row, up to the fault
            sheet = None
        if sheet is not None:
            yield from sheet.iter(f"{_MAIN}row")
            return
    with book.open(name) as part:
        for _, row in ElementTree.iterparse(part):
            if row.tag == f"{_MAIN}row":
                yield row
                row.clear()


def cells_of(content: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, int, str]]:
    """``(sheet, row, column, text)`` of the named sheet, or of the first one; from 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        if "[Content_Types].xml" not in names:
            return  # a plain archive, no workbook
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_text_of(si) for si in root.findall(f"{_MAIN}si")]
        links = {
            r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/")
            for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        }
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
        for entry in sheets:
            title = entry.get("name")
            if sheet is not None and title != sheet:
                continue
            numbers = {}
            for row in _rows_of(book, f"xl/{links[entry.get(f'{_REL}id')]}"):
                for cell in row:
                    letters, number = _CELL.fullmatch(cell.get("r")).groups()
                    column = numbers.get(letters)
                    if column is None:
                        column = numbers[letters] = _column_number(letters)
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        text = _text_of(cell)
                    else:
                        value = cell.find(f"{_MAIN}v")
                        if value is None or value.text is None:
                            continue
                        text = shared[int(value.text)] if kind == "s" else value.text
                    yield title, int(number) - 1, column, text
            return


def scan_workbooks(objects: DataFrame, sheet: str | None = None, rows_per_batch: int = 50_000) -> DataFrame:
    """(file_id, sheet, r, c, text, error) of ``objects`` (file_id, content); cells leave the task in batches.

    A workbook that can't be read gives one row with ``error`` and no cell. If it breaks off after a batch has left, that
    row comes behind its cells; ``read_workbook_grid`` leaves them out.
    """
    schema = T.StructType([*GRID_SCHEMA.fields, T.StructField("error", T.StringType())])
    columns = [f.name for f in schema]

    def frame(cells: list[tuple]) -> pd.DataFrame:
        if not cells:
            return pd.DataFrame(columns=columns).astype({"r": "Int32", "c": "Int32"})
        made = dict(zip(columns, map(list, zip(*cells))))
        return pd.DataFrame(made | {x: pd.array(made[x], "Int32") for x in ("r", "c")})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = []
            for file_id, content in zip(batch["file_id"], batch["content"]):
                begun = len(cells)
                try:
                    if content is None:
                        raise ValueError("no content")
                    for cell in cells_of(bytes(content), sheet):
                        cells.append((file_id, *cell, None))
                        if len(cells) >= rows_per_batch:
                            yield frame(cells)
                            cells, begun = [], 0
                except Exception as cause:  # whatever a broken archive or part leads to is an error of this file alone
                    del cells[begun:]
                    cells.append((file_id, None, None, None, None, f"{type(cause).__name__}: {cause}"))
            if cells:
                yield frame(cells)

    return objects.select("file_id", "content").mapInPandas(read, schema)


def read_workbook_grid(objects: DataFrame, sheet: str | None = None, rows_per_batch: int = 50_000) -> DataFrame:
    """The cells of the readable workbooks among ``objects``; the others are in ``scan_workbooks``."""
    scanned = written(scan_workbooks(objects, sheet, rows_per_batch), "cells")
    broken = scanned.where("error is not null").select("file_id")
    return scanned.where("error is null").drop("error").join(broken, "file_id", "left_anti")
