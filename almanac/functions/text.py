"""String columns: cleaning, fences, display of numbers, URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalise_name(name: Column) -> Column:
    """Line feeds become blanks, carriage returns go, the ends are trimmed."""
    return F.trim(F.replace(F.replace(name, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")))


def contains_ci(column: Column, needle: Column | str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the needle are plain characters."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.lower(column).contains(F.lower(needle))


def strip_jsonc(text: Column) -> Column:
    """Drop ``//`` comments, but keep the ``//`` of an URL scheme."""
    return F.regexp_replace(text, r"(?<!:)//[^\n\r]*", "")


def strip_fence(text: Column, language: str = "sql") -> Column:
    """The inside of the first fenced block, else the trimmed text."""
    fence = rf"(?is)```(?:{language})?\n?(.*?)\n?```"
    inner = F.regexp_extract(text, fence, 1)
    return F.when(text.rlike(fence), F.btrim(inner, F.lit(" \n\r\t"))).otherwise(
        F.btrim(text, F.lit(" \n\r\t"))
    )


def format_value(value: Column) -> Column:
    """``1234567`` -> ``1 234 567``; fractions keep two decimals."""
    shown = F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(
        F.format_number(value, 2)
    )
    return F.coalesce(F.replace(shown, F.lit(","), F.lit(" ")), F.lit(""))


def url_domain(url: Column) -> Column:
    """Host, with user and port where the URL states them."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def csv_list(text: Column) -> Column:
    """Comma-separated text to trimmed, non-empty items."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def cell_join(cells: Column) -> Column:
    """Cells of one table row on one line; a missing cell is empty."""
    return F.array_join(F.transform(cells, lambda x: F.coalesce(F.trim(x), F.lit(""))), " | ")


def fn_name_hash(content: Column) -> Column:
    """First four hex digits of the md5 of the first 512 bytes."""
    return F.substring(F.md5(F.substring(content.cast("binary"), 1, 512)), 1, 4)
