"""Casts that give NULL for bad input whether or not the session is in ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from stratacart.schemas import Fields, spark_type

# What a cast of a string ignores at either end.
_BLANKS = r"[\x00-\x20\x7f]*"

# Whole numbers that fit their type whatever their digits.
_PLAIN = {"int": r"^[+-]?\d{1,9}\z", "bigint": r"^[+-]?\d{1,18}\z"}
# Numbers whose decimals, if any, are cut off: up to 18 digits, and any number of them.
_SHORT = rf"^{_BLANKS}([+-]?\d{{1,18}})(?:\.\d*)?{_BLANKS}\z"
_LONG = rf"^{_BLANKS}([+-]?\d+)(?:\.\d*)?{_BLANKS}\z"
# What a double may look like: decimal or hexadecimal digits, or a name in any case.
_DOUBLE = (
    rf"^{_BLANKS}[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?"
    rf"|0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*[pP][+-]?\d+[fFdD]?|(?i:nan|inf(?:inity)?)){_BLANKS}\z"
)
# What a date may look like: a year, month and day as far as given, and a time behind them.
_DATE = rf"(?s)^{_BLANKS}[+-]?\d{{4,7}}(?:-\d{{1,2}}(?:-\d{{1,2}}(?:[ T].*)?)?)?{_BLANKS}\z"
# A decimal point without digits before it counts as zero.
_FRACTION = rf"^{_BLANKS}[+-]?\.\d*{_BLANKS}\z"


def _whole_number(text: Column, sql_type: str) -> Column:
    """Whole number in ``text``, decided by patterns before anything is cast.

    A try_cast that fails costs some fifty times one that succeeds, because an error is
    built and caught for the row; so it is only called on digits that fit.
    """
    short = F.regexp_extract(text, _SHORT, 1).try_cast("bigint")
    if sql_type == "int":
        short = F.when(short.between(-(2**31), 2**31 - 1), short.try_cast("int"))
    return (
        F.when(text.rlike(_PLAIN[sql_type]), text.try_cast(sql_type))
        .when(text.rlike(_SHORT), short)
        .when(text.rlike(_LONG), F.regexp_extract(text, _LONG, 1).try_cast(sql_type))
        .when(text.rlike(_FRACTION), F.lit(0).cast(sql_type))
    )


def to_int(text: Column) -> Column:
    """String to int, cutting decimals off: ' 12.7 ' is 12, '1e3' and 'x' are NULL."""
    return _whole_number(text, "int")


def to_bigint(text: Column) -> Column:
    """Like ``to_int``, for identifiers beyond 2**31."""
    return _whole_number(text, "bigint")


def to_double(column: Column) -> Column:
    """String to double. 'NaN' stays NaN, as in a plain cast; what cannot be a number is not
    cast at all, since a failing cast is dear."""
    return F.when(column.cast("string").rlike(_DOUBLE), column.try_cast("double"))


def to_date_lenient(column: Column) -> Column:
    """String, date or timestamp to date; '2024-1-5' and '2024' are dates, 'junk' is NULL."""
    return F.try_to_date(column)


def cast_columns(
    schema: StructType, fields: Fields, key_type: str = "bigint"
) -> dict[str, Column]:
    """The columns of ``fields`` over a frame of ``schema``, each in its type.

    Strings go through the casts above. Sources that bring their own types (JDBC)
    are cast from those; a number outside the target's range becomes NULL.
    """
    selected = {}
    for name, kind in fields:
        target = spark_type(kind, key_type)
        column = F.col(name)
        text = isinstance(schema[name].dataType, StringType)
        if target == "date":
            looks_right = column.rlike(_DATE) if text else F.lit(True)
            column = F.when(looks_right, to_date_lenient(column))
        elif target == "double":
            column = to_double(column) if text else column.try_cast("double")
        elif target in ("int", "bigint"):
            if text:
                column = to_int(column) if target == "int" else to_bigint(column)
            else:
                column = column.try_cast(target)
        selected[name] = column.alias(name)
    return selected


def cast_fields(df: DataFrame, fields: Fields, key_type: str = "bigint") -> DataFrame:
    """Select ``fields`` from ``df`` by name, each in its type; see ``cast_columns``."""
    return df.select(*cast_columns(df.schema, fields, key_type).values())
