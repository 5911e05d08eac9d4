"""Casts that never raise: a cell that cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def to_number(text: Column) -> Column:
    """Text to double; anything but a plain number is null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def year_from_float(text: Column) -> Column:
    """``2020.0`` and ``2020.9`` are both the year 2020."""
    return to_number(text).try_cast("int")


def is_iso3(code: Column) -> Column:
    """Three upper-case letters, in any script."""
    return code.rlike(r"\A\p{Lu}{3}\z")


# The accepted date layouts, in the order they are tried.
DATE_LAYOUTS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
]


def parse_date_flexible(text: Column) -> Column:
    """First layout that fits, else null."""
    return F.coalesce(
        *[
            F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(layout))))
            for shape, layout in DATE_LAYOUTS
        ]
    )
