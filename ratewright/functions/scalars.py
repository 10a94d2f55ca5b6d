"""Scalar expressions on ratings, numbers held as text, and times."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import names as N


def clip_rating(value: Column, low: float = N.RATING_MIN, high: float = N.RATING_MAX) -> Column:
    """Clip to the rating range. A missing value stays missing: `greatest` and `least` alone would skip it."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), bounded)


def in_rating_range(value: Column, low: float = N.RATING_MIN, high: float = N.RATING_MAX) -> Column:
    """True inside the closed range; a missing value is outside."""
    return F.coalesce(value.between(low, high), F.lit(False))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


# Java's numbers also allow type suffixes and hexadecimal digits; these are malformed here.
NUMBER = r"^[\s]*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(?i:inf|infinity|nan))[\s]*$"


def number(value: Column) -> Column:
    """A text or numeric column as double; missing where it is no number."""
    return F.when(value.cast("string").rlike(NUMBER), value.try_cast("double"))


def strict_double(value: Column) -> Column:
    """A text or numeric column as double; malformed text and NaN become missing."""
    return nan_to_null(number(value))


def malformed_number(value: Column) -> Column:
    """True for a value that is present but is no number."""
    return value.isNotNull() & number(value).isNull()


def time_literal(value: datetime) -> Column:
    """A time without zone, exact under any session or machine time zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def parse_time(value: Column) -> Column:
    """Text to a time without zone, the time of day being optional; malformed text is an error, as a row that falls in
    neither part of a split would be lost."""
    found = value.try_cast("timestamp_ntz")
    text = F.concat(F.lit("not a time: "), value.cast("string"))
    return F.when(value.isNotNull(), F.coalesce(found, F.raise_error(text).cast("timestamp_ntz")))
