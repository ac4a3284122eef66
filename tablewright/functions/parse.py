"""Missing-value tokens and tolerant number parsing as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ten spellings that count as missing.
MISSING_TOKENS = ("", "nan", "NaN", "NA", "N/A", "null", "NULL", "None", "-", "--")
# Further spellings that a CSV read treats as missing.
CSV_MISSING_TOKENS = (*MISSING_TOKENS, "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "n/a")

#: A number in text as this library reads it: optional sign, digits with at most one point, optional exponent, or an infinity.
NUMBER = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity))\s*$"
FINITE_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: White space at either end of a label, no-break spaces and control separators included.
EDGE_SPACE = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


#: A text of white space only.
BLANK = r"^[\s\p{Z}\x1c-\x1f\x85]*\z"


def name(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def null_if_token(c: Column, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    """Text that is exactly one of the tokens becomes null."""
    return F.when(~c.isin(*tokens), c)


def number_from_text(c: Column) -> Column:
    """Text to double; text that isn't a number, and finite spellings that overflow, become null. NaN is never returned."""
    parsed = F.when(c.rlike(NUMBER), c.try_cast("double"))
    overflow = F.abs(parsed) == F.lit(float("inf"))
    return F.when(~overflow | c.rlike("(?i)inf"), parsed)


def as_number(c: Column, kind: T.DataType, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    """Any supported column as double, null where missing or unparseable."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(kind, NUMERIC_TYPES):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.StringType):
        return number_from_text(null_if_token(c, tokens))
    return F.lit(None).cast("double")


def is_blank(c: Column) -> Column:
    return c.rlike(BLANK)


def label_missing(c: Column) -> Column:
    """Whether a label is null or, without surrounding white space and letter case, empty or a missing token."""
    folded = F.lower(F.regexp_replace(c, EDGE_SPACE, ""))
    return c.isNull() | folded.isin(*sorted({t.lower() for t in MISSING_TOKENS}))


def value_missing(c: Column, kind: T.DataType) -> Column:
    """Missing test by type: null or NaN for numbers, label_missing for text, null otherwise."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, T.StringType):
        return label_missing(c)
    return c.isNull()
