"""Explicit schemas of the input tables. No scan infers types, so no scan reads a file twice."""

from pyspark.sql import types as T

from . import names as N

_int = T.IntegerType()
_long = T.LongType()
_double = T.DoubleType()
_text = T.StringType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# Gender, language and publisher are numeric codes in the files but categories by meaning, hence text.
TABLES: dict[str, T.StructType] = {
    "train": _schema(
        (N.USER, _int), (N.BOOK, _int), (N.HAS_READ, _int), (N.RATING, _double), (N.TIMESTAMP, T.TimestampNTZType())
    ),
    "test": _schema((N.USER, _int), (N.BOOK, _int)),
    "users": _schema((N.USER, _int), (N.GENDER, _text), (N.AGE, _double)),
    "books": _schema(
        (N.BOOK, _int),
        (N.TITLE, _text),
        (N.AUTHOR, _int),
        (N.AUTHOR_NAME, _text),
        (N.YEAR, _double),
        (N.LANGUAGE, _text),
        (N.AVG_RATING, _double),
        (N.PUBLISHER, _text),
    ),
    "genres": _schema((N.GENRE, _int), (N.GENRE_NAME, _text), (N.BOOKS_COUNT, _long)),
    "book_genres": _schema((N.BOOK, _int), (N.GENRE, T.ShortType())),
    "book_descriptions": _schema((N.BOOK, _int), (N.DESCRIPTION, _text)),
    # Value columns stay text here so that the checks can count malformed numbers instead of losing them.
    "submission": _schema((N.USER, _int), (N.BOOK, _int), (N.PREDICTION, _text)),
    "solution": _schema((N.USER, _int), (N.BOOK, _int), (N.RATING, _text), (N.STAGE, _text)),
}

# Tables whose text columns may hold quotes and line breaks inside quotes.
QUOTED_TEXT = {"books", "book_descriptions"}

# Texts that stand for a missing value in an input file.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]
