"""Values for missing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import names as N

RATING_LIKE = [N.USER_MEAN, N.BOOK_MEAN, N.AUTHOR_MEAN, N.AVG_RATING]
COUNT_LIKE = [N.USER_COUNT, N.BOOK_COUNT, N.GENRES_COUNT]


STEPS = 1_000
NARROWINGS = 2


def _narrowed(values: DataFrame, low: Column, high: Column) -> DataFrame:
    """One row `b`: the number of values `n` and a narrower range (`low`, `high`) that holds both middle ones.

    The sketch is off by a tenth of a step at most, so one step beyond the wanted places is enough.
    """
    v = F.col("v")
    inside = F.when((v >= low) & (v <= high), v)
    row = values.agg(
        F.count("v").alias("n"),
        F.count_if(v < low).alias("below"),
        F.count(inside).alias("m"),
        F.percentile_approx(inside, [i / STEPS for i in range(STEPS + 1)], 10 * STEPS).alias("q"),
    )

    def step(rank: Column) -> Column:
        return (rank - F.col("below")) * STEPS / F.nullif(F.col("m"), F.lit(0))

    first = (F.floor(step(F.floor((F.col("n") - 1) / 2))) - 1).cast("int")
    last = (F.ceil(step(F.ceil((F.col("n") - 1) / 2) + 1)) + 1).cast("int")
    return row.select(
        F.struct(
            "n",
            F.when(first < 0, low).otherwise(F.get("q", first)).alias("low"),
            F.when(last > STEPS, high).otherwise(F.get("q", last)).alias("high"),
        ).alias("b")
    )


def exact_median(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row with the interpolated median of a numeric column; NaN counts as missing.

    Each narrowing is one pass that keeps a sketch and counts; it leaves at most a three-hundredth of the values. The last
    pass counts what is inside the range by value, so the task that picks the middle sees about a 100,000th of the rows,
    equal ones counted once.
    """
    given = F.col(column).cast("double")
    values = rows.select(F.when(~F.isnan(given), given).alias("v"))
    v, low, high = F.col("v"), F.lit(float("-inf")), F.lit(float("inf"))
    for _ in range(NARROWINGS):
        bounds = _narrowed(values, low, high).scalar()
        low, high = bounds["low"], bounds["high"]
    # Values below the range are one group, the null one.
    counted = values.filter(v <= high).groupBy(F.when(v >= low, v).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(v.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.select("v", upto.alias("upto"), (upto - F.col("n")).alias("before"), bounds["n"].alias("total"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), v))

    last = F.col("total") - 1
    return placed.agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias(name))


def global_mean(train: DataFrame, name: str = "global_mean") -> DataFrame:
    return train.agg(F.avg(N.RATING).alias(name))


def fill_missing(
    rows: DataFrame,
    train: DataFrame,
    missing_text: str = N.MISSING_TEXT,
    missing_number: int = N.MISSING_NUMBER,
) -> DataFrame:
    """Fill the feature columns that `rows` has, in one projection.

    Age gets the median age of `rows`; rating averages get the mean rating of `train`; counts get zero; what is left of
    the categories gets a marker. Both statistics are scalar subqueries: each is a narrow scan of one column.
    """
    present = set(rows.columns)
    fill: dict[str, Column] = {}
    mean = global_mean(train).scalar() if present & set(RATING_LIKE) else None
    for name in RATING_LIKE:
        fill[name] = mean
    for name in COUNT_LIKE:
        fill[name] = F.lit(0)
    if N.AGE in present:
        fill[N.AGE] = F.coalesce(exact_median(rows, N.AGE, "age_median").scalar(), F.lit(float(missing_number)))
    for name in N.CATEGORICAL:
        if name not in fill:
            fill[name] = F.lit(missing_text if name in N.TEXT_CATEGORIES else missing_number)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        *[
            F.coalesce(F.col(c), fill[c].cast(kinds[c])).alias(c) if c in fill else F.col(c)
            for c in rows.columns
        ]
    )
