"""Split by time: the split date for a share of rows, the two parts, and their checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .. import names as N
from ..functions import parse_time, time_literal
from .keys import require_columns


def as_time(df: DataFrame, column: str = N.TIMESTAMP) -> DataFrame:
    """The frame with `column` as a time, parsed if it is text."""
    require_columns(df, [column])
    if df.schema[column].dataType.typeName() in {"string", "varchar", "char"}:
        return df.withColumn(column, parse_time(F.col(column)))
    return df


def _pick(histogram: DataFrame, bucket: str, place: Column) -> DataFrame:
    """The bucket that holds the element at `place` and the element's place inside it.

    `histogram` is a counted calendar unit and bounded by that unit: days of the log, seconds of one day, or
    microseconds of one second. So a window without partitions is safe here.
    """
    ordered = Window.orderBy(F.col(bucket).asc_nulls_last())
    running = histogram.select(
        bucket,
        F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        "n",
        place.alias("place"),
    )
    before = F.col("upto") - F.col("n")
    return running.filter((F.col("place") >= before) & (F.col("place") < F.col("upto"))).select(
        bucket, (F.col("place") - before).alias("place")
    )


def split_date(df: DataFrame, ratio: float = N.SPLIT_RATIO, column: str = N.TIMESTAMP) -> DataFrame:
    """One row with the time at 0-based place floor(n * ratio) of the ascending times; n counts missing times, too.

    A global sort would send every row through a range shuffle. Here each level counts one calendar unit, finds the
    unit that holds the place and looks only inside it at the next level: day, second, microsecond. Each level is a
    narrow scan with partial counts, and the later ones read only what can hold their unit. Missing times sort last, so a place among them gives a missing date.
    """
    if not 0 < ratio < 1:
        raise ValueError(f"the ratio must lie strictly between 0 and 1, not {ratio}")
    t = F.col("t")
    times = as_time(df, column).select(F.col(column).alias("t"))
    times = times.select("t", t.cast("date").alias("day"), F.date_trunc("second", t).cast("timestamp_ntz").alias("second"))

    days = times.groupBy("day").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    found = _pick(days, "day", F.floor(total.cast("double") * F.lit(ratio)).cast("bigint"))
    for outer, inner, width in (("day", "second", "1 day"), ("second", "t", "1 second")):
        # Bounds of the found unit as scalar subqueries reach the scan, which then skips files and row groups.
        low = F.col(outer).cast("timestamp_ntz")
        bounds = [found.select(b).scalar() for b in (low, low + F.expr(f"interval {width}"))]
        inside = times.filter((t >= bounds[0]) & (t < bounds[1]))
        place = F.lit(found.select("place").scalar()).alias("place")
        counted = inside.groupBy(inner).agg(F.count("*").alias("n")).select(inner, "n", place)
        found = _pick(counted, inner, F.col("place"))
    return found.agg(F.max("t").alias("split_date"))


def temporal_parts(
    df: DataFrame, date: datetime | Column, column: str = N.TIMESTAMP
) -> tuple[DataFrame, DataFrame]:
    """Rows up to and including the date, and rows after it; rows without a time are in neither."""
    df = as_time(df, column)
    cut = _as_time_column(date)
    return df.filter(F.col(column) <= cut), df.filter(F.col(column) > cut)


def _as_time_column(date: datetime | Column) -> Column:
    return date if isinstance(date, Column) else time_literal(date)


def split_bounds(df: DataFrame, date: datetime | Column, column: str = N.TIMESTAMP) -> DataFrame:
    """One row with the sizes of both parts, the last train time and the first validation time."""
    df = as_time(df, column)
    time = F.col(column)
    cut = _as_time_column(date)
    return df.select(time.alias("t"), (time <= cut).alias("early")).agg(
        F.count_if(F.col("early")).alias("n_train"),
        F.count_if(~F.col("early")).alias("n_val"),
        F.max(F.when(F.col("early"), F.col("t"))).alias("max_train"),
        F.min(F.when(~F.col("early"), F.col("t"))).alias("min_val"),
    )


def checked_bounds(df: DataFrame, date: datetime, column: str = N.TIMESTAMP) -> Row:
    """The line of `split_bounds`, after both parts have proved non-empty and strictly ordered in time."""
    bounds = split_bounds(df, date, column).first()
    if not bounds.n_train:
        raise ValueError(f"no rows up to {date}")
    if not bounds.n_val:
        raise ValueError(f"no rows after {date}")
    if bounds.min_val <= bounds.max_train:
        raise ValueError(f"validation starts at {bounds.min_val}, not after the last train time {bounds.max_train}")
    return bounds


def checked_parts(df: DataFrame, date: datetime, column: str = N.TIMESTAMP) -> tuple[DataFrame, DataFrame]:
    """`temporal_parts` after one pass that proves both parts non-empty and strictly ordered in time."""
    checked_bounds(df, date, column)
    return temporal_parts(df, date, column)
