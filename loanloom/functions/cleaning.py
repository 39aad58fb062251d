"""Coercion of dirty identifiers, numbers and typed-in amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.schemas import CUSTOMER, is_fractional

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INTEGER = r"^[+-]?[0-9]+$"
# The doubles nearest to the 64-bit integer range.
_INT_LOW, _INT_HIGH = -9.223372036854775e18, 9.223372036854775e18


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "string"


def text_number(text: Column) -> Column:
    """DOUBLE of a plain decimal number, NULL for any other text."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def text_bigint(text: Column) -> Column:
    """Nearest whole number of a text, halves to even; NULL if it is no number."""
    trimmed = F.trim(text)
    exact = F.when(trimmed.rlike(_INTEGER), trimmed.try_cast("bigint"))
    return F.coalesce(exact, _whole(F.bround(text_number(text), 0)))


def text_id(text: Column) -> Column:
    """BIGINT of a text that is a whole number; NULL for anything else, 1.5 included."""
    trimmed = F.trim(text)
    exact = F.when(trimmed.rlike(_INTEGER), trimmed.try_cast("bigint"))
    value = text_number(text)
    return F.coalesce(exact, F.when(value == F.floor(value), _whole(value)))


def number(df: DataFrame, name: str) -> Column:
    """Any column as DOUBLE; bad text and NaN become NULL."""
    value = text_number(F.col(name)) if _is_text(df, name) else F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _whole(value: Column) -> Column:
    return F.when((value > _INT_LOW) & (value < _INT_HIGH), value).cast("bigint")


def to_bigint(df: DataFrame, name: str) -> Column:
    """Nearest whole number, halves to even; NULL if not a number."""
    if _is_text(df, name):
        return text_bigint(F.col(name))
    if is_fractional(df.schema[name].dataType):
        return _whole(F.bround(number(df, name), 0))
    return F.col(name).cast("bigint")


def integer_id(df: DataFrame, name: str = CUSTOMER) -> Column:
    """BIGINT of a whole number; NULL for anything else, 1.5 included."""
    if _is_text(df, name):
        return text_id(F.col(name))
    if is_fractional(df.schema[name].dataType):
        value = number(df, name)
        return F.when(value == F.floor(value), _whole(value))
    return F.col(name).cast("bigint")


def with_clean_id(df: DataFrame, name: str = CUSTOMER) -> DataFrame:
    """Replace the id by a BIGINT and add ``id_state``.

    'ok', 'missing' (not a number at all) or 'quarantined' (a number that is no
    whole number, which must not silently become another customer's id).
    """
    clean = integer_id(df, name)
    state = (
        F.when(clean.isNotNull(), "ok")
        .when(number(df, name).isNotNull(), "quarantined")
        .otherwise("missing")
    )
    return df.withColumn("id_state", state).withColumn(name, clean)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing number in files; Spark aggregates need NULL instead."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None)) for n in floats}) if floats else df


def typed_amount(text: Column, previous: Column) -> Column:
    """Amount typed into a form: commas dropped, empty means 0, junk keeps the old value."""
    stripped = F.trim(F.regexp_replace(text, ",", ""))
    value = F.when(stripped == "", F.lit(0.0)).otherwise(text_number(stripped))
    return F.coalesce(value, previous.cast("double"))
