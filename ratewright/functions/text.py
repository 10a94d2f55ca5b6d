"""Tokens and terms of a text, as array expressions evaluated inside the row."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of two or more letters, digits or underscores of any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-case tokens in text order; a missing text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def _with_pairs(words: Column) -> Column:
    following = F.slice(words, F.lit(2), F.size(words))
    # zip_with pads the shorter array, so the last word meets null and the concat of that pair is null.
    pairs = F.filter(F.zip_with(words, following, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    return F.concat(words, pairs)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, where a costly `value` is computed once per row, however often `use` names it.

    Array expressions with lambdas do not share their inputs; the argument of a lambda is a value that exists already.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(words: Column) -> Column:
    """The words followed by all pairs of neighbouring words, joined by a space."""
    return once(words, _with_pairs)
