"""Column expressions shared by the silver and gold tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, or 0.0 where the denominator is not positive or is NULL."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def line_amount(quantity: Column, unit_price: Column) -> Column:
    return quantity * unit_price


def date_parts(date: Column) -> dict[str, Column]:
    """Calendar columns of a date; ``week`` is the ISO week, ``year`` the calendar year."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "week": F.weekofyear(date),
        "quarter": F.quarter(date),
    }
