"""Cell grids ``(file_id, sheet, r, c, text)``: the common shape of all workbooks.

Files of one layout may differ in width and in the number of countries, so the
layouts are worked out on cells rather than on columns. One shuffle turns the
cells of a sheet row into a map; a row is bounded by the 16,384 columns the
workbook format allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SHEET = ["file_id", "sheet"]


def sheet_rows(grid: DataFrame) -> DataFrame:
    """One row per sheet row: ``cells`` maps the column number to the text."""
    filled = grid.where(F.col("text").isNotNull())
    cells = F.map_from_entries(F.collect_list(F.struct("c", "text"))).alias("cells")
    return filled.groupBy(*SHEET, "r").agg(cells)


def with_header(rows: DataFrame, header_row: int, extra: dict[str, int] | None = None) -> DataFrame:
    """Rows below ``header_row`` next to the header cells of their sheet.

    ``extra`` names further header-like rows, such as a row of readable names.
    """
    wanted = {"header": header_row, **(extra or {})}
    last = max(wanted.values())
    heads = (
        rows.where(F.col("r").isin(*wanted.values()))
        .groupBy(*SHEET)
        .agg(*[F.first(F.when(F.col("r") == r, F.col("cells")), True).alias(name) for name, r in wanted.items()])
    )
    return rows.where(F.col("r") > last).join(heads, SHEET)


def header_promote(grid: DataFrame, header_row: int) -> DataFrame:
    """Cells below the header row, each with the header text of its column."""
    titled = with_header(sheet_rows(grid), header_row)
    return titled.select(*SHEET, "r", F.explode("cells").alias("c", "text"), "header").select(
        *SHEET, "r", "c", F.col("header")[F.col("c")].alias("title"), "text"
    )


def column_of(header: Column, title: str) -> Column:
    """Number of the first column whose header is exactly ``title``."""
    hits = F.filter(F.map_entries(header), lambda e: e["value"] == title)
    return F.array_min(F.transform(hits, lambda e: e["key"]))


def cell_under(header: Column, cells: Column, title: str) -> Column:
    return F.element_at(cells, column_of(header, title))
