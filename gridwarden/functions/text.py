"""Predicates on cell text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The error tokens of spreadsheets.
ERROR_TOKENS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")


def stripped(col: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def numeric_text(col: Column) -> Column:
    """The number that a text spells, or null: at most 15 digits, plain or grouped by thousands, no leading zero
    before a digit, no sign of subtraction, brackets or fractions."""
    text = stripped(col)
    plain = text.rlike(r"^[+]?(\d+(\.\d*)?|\.\d+)$") | text.rlike(r"^[+]?\d{1,3}(,\d{3})+(\.\d+)?$")
    bare = F.regexp_replace(text, ",", "")
    fine = plain & (F.length(F.regexp_replace(text, "[^0-9]", "")) <= 15) & ~bare.rlike(r"^[+]?0\d+")
    return F.when(fine, bare.try_cast("double"))


def is_error(data_type: Column, text: Column) -> Column:
    return F.coalesce(data_type == "e", F.lit(False)) | F.coalesce(F.upper(text).isin(*ERROR_TOKENS), F.lit(False))


def integer_digits(num: Column) -> Column:
    """Digits of a non-negative whole number, or null."""
    return F.when((num >= 0) & (num == F.floor(num)), num.cast("decimal(38,0)").cast("string"))
