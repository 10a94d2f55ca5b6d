"""Column expressions."""

from .arrays import masked_mean, zero_vector
from .scalars import clip_rating, in_rating_range, malformed_number, nan_to_null, number, parse_time, strict_double, time_literal
from .text import once, terms, tokens

__all__ = [
    "clip_rating",
    "in_rating_range",
    "malformed_number",
    "masked_mean",
    "nan_to_null",
    "number",
    "once",
    "parse_time",
    "strict_double",
    "terms",
    "time_literal",
    "tokens",
    "zero_vector",
]
