"""CSV scans of the input tables and the CSV sink of a submission."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import names as N
from ..functions import nan_to_null, number
from ..schemas import NULL_TOKENS, QUOTED_TEXT, TABLES

PLACE = "place_in_file"


def _file_place() -> Column:
    """Where a row stands: file, block, and a number that grows along the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _typed(name: str, kind: T.DataType, tokens: Sequence[str], place: Column) -> Column:
    """A text column as `kind`: missing where it is one of `tokens`, and an error where it is neither that nor a value."""
    text = F.col(name)
    present = text.isNotNull() & ~text.isin(list(tokens)) if tokens else text.isNotNull()
    if isinstance(kind, T.StringType):
        return F.when(present, text).alias(name)
    value = number(text) if isinstance(kind, T.DoubleType) else text.try_cast(kind)
    said = F.concat(
        F.lit(f"column {name}, "), place["file"], F.lit(", block "), place["block"].cast("string"), F.lit(", row "),
        place["row"].bitwiseAND(F.lit(2**33 - 1)).cast("string"), F.lit(f": not {kind.simpleString()}: "), text,
    )
    found = F.when(present, F.coalesce(value, F.raise_error(said).cast(kind)))
    return (nan_to_null(found) if isinstance(kind, T.DoubleType) else found).alias(name)


def scan(
    spark: SparkSession,
    table: str,
    path: str,
    sep: str = ",",
    row_order: bool | None = None,
    null_tokens: Sequence[str] | Mapping[str, Sequence[str]] = NULL_TOKENS,
) -> DataFrame:
    """Scan one table with its explicit types; columns are found by the names in the header, in any order.

    Every field is read as text. A field equal to one of `null_tokens`, quoted or not, is missing; a mapping gives tokens
    per column, and columns that it does not name have the default ones. Any other field that is no value of its column's
    type stops the scan with an error that names column, file and row (counted within a task).

    `row_order` adds the place of each row in its file (file, block, row), which keep-first and last-wins rules need;
    by default it is added to the tables where those rules apply. Line breaks inside quotes are accepted only for tables
    with free text; such files are cut at record ends (see `records`), so one large file is read by many tasks.
    """
    schema = TABLES[table]
    quoted = table in QUOTED_TEXT
    # Without a schema and without inference Spark reads the header line only.
    header = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path).columns
    absent = [c for c in schema.names if c not in header]
    if absent:
        raise ValueError(f"{path} lacks columns {absent}; present are {header}")
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    as_text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    if quoted:
        raw = parsed_records(spark, path, as_text, options)
    else:
        reader = spark.read.schema(as_text).options(header=True, enforceSchema=False, **options)
        raw = reader.csv(path).select("*", _file_place().alias(PLACE))
    given = null_tokens if isinstance(null_tokens, Mapping) else dict.fromkeys(schema.names, null_tokens)
    columns = [_typed(f.name, f.dataType, given.get(f.name, NULL_TOKENS), F.col(PLACE)) for f in schema.fields]
    if quoted if row_order is None else row_order:
        columns.append(F.col(PLACE).alias(N.ROW_ORDER))
    return raw.select(*columns)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files whose quoted fields may hold line breaks: `record`, and the `place` of its first line.

    Files are read as lines by as many tasks as they have blocks. A line starts a record if the quotes before it in its
    file are even in number (a doubled quote inside a field counts twice). They are counted per block, summed over the
    blocks of a file, and counted on within each block. Lines are then joined to the record that they belong to; the one
    that runs over the end of a block takes its last lines from the next. A carriage return at the end of a record goes. Blank
    lines between records are no records, and the first record of every file, its header, is left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", _file_place().alias(PLACE))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.select("value", PLACE, f"{PLACE}.*").withColumn("quotes", quotes)
    along = Window.partitionBy("file", "block").orderBy("row")
    before = F.coalesce(F.sum("quotes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = lines.withColumn("own", before)
    # One row per block; a file has as many as it is long.
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    marked = counted.join(offsets, ["file", "block"]).withColumn("starts", (F.col("offset") + F.col("own")) % 2 == 0)
    # A block's lines before its first start belong to the last record that started in an earlier block.
    own_start = F.max(F.when(F.col("starts"), F.col("row"))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("start", own_start)
    last = marked.groupBy("file", "block").agg(F.max("start").alias("last"))
    carried = last.select(
        "file", "block", F.last(F.when(F.col("last").isNotNull(), F.struct("block", "last")), True).over(earlier).alias("carried")
    )
    owner = F.when(F.col("start").isNotNull(), F.struct("block", F.col("start").alias("last"))).otherwise(F.col("carried"))
    owned = marked.join(carried, ["file", "block"]).withColumn("owner", owner)
    joined = owned.groupBy("file", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"]), "\n").alias("text")
    )
    first = joined.groupBy("file").agg(F.min("owner").alias("header")).withColumnRenamed("file", "own_file")
    body = joined.join(first, (F.col("file") == F.col("own_file")) & (F.col("owner") > F.col("header")))
    record = F.regexp_replace("text", r"\r$", "")
    place = F.struct("file", F.col("owner.block").alias("block"), F.col("owner.last").alias("row"))
    return body.select(record.alias("record"), place.alias(PLACE)).filter(F.col("record") != "")


def parsed_records(spark: SparkSession, path: str, fields: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """The fields of `records` as texts, and their `place`."""
    parsed = F.from_csv("record", ", ".join(f"`{c}` STRING" for c in fields.names), dict(options))
    return records(spark, path).select(parsed.alias("fields"), PLACE).select("fields.*", PLACE)


def scan_raw_folder(spark: SparkSession, folder: str, sep: str = ",") -> dict[str, DataFrame]:
    """Scan all seven tables of a raw data folder."""
    return {table: scan(spark, table, f"{folder.rstrip('/')}/{file}", sep) for table, file in N.FILES.items()}


def write_submission(predictions: DataFrame, path: str, single_file: bool = False) -> dict[str, float | int | None]:
    """Write keys and predictions as CSV with a header; returns their number, least, largest and mean, observed on the way.

    `single_file` is for handing the result to a program that wants one file; it sends all rows through one task.
    """
    seen, p = Observation(), N.PREDICTION
    out = predictions.select(N.USER, N.BOOK, p).observe(
        seen, F.count(F.lit(1)).alias("n"), F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean")
    )
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)
    return seen.get
