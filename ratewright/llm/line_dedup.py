"""Lines that a site repeats: navigation, notices and other boilerplate.

For every host, the pages that contain a line are divided by all pages of that host; a line above the ratio goes from all
of the host's pages, whatever their number. Only a line that stands on a single page (`MIN_PAGES` is 2) repeats nowhere and
stays, however few pages its host has. DataFrame operations only.

A line is what stands between line feeds, compared as it is. Lines without a character other than ASCII white space are
kept and never counted. A page counts a line once. Rows without a host form a host of their own; rows without text count
as pages, have no lines and stay null. A text of boilerplate alone becomes empty. Repeated rows are pages of their own.
Other columns pass through. An empty table gives an empty result.

Lines are counted by two 64-bit hashes, so lines themselves are not shuffled. The lines of a host above the ratio are at
most its lines per page divided by the ratio, so they fit in one row per host; that table is written, and Spark
broadcasts it if the size of its files allows and otherwise joins by host and piece: each host's pages are dealt over
`PIECES` pieces by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .names import fresh

RATIO = 0.1
MIN_PAGES = 2
PIECES = 64


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def site_lines(
    pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """One row per host that has such lines: host, and the marks of its lines above the ratio."""
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    lines = rows.select("host", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    worded = lines.filter(F.col("line").rlike(r"[^ \t-\r]")).select("host", _mark(F.col("line")).alias("mark"))
    counted = worded.groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("total")).withColumnRenamed("host", "site")
    frequent = counted.join(totals, F.col("host").eqNullSafe(F.col("site"))).filter(
        F.col("n") > F.lit(ratio) * F.col("total")
    )
    return frequent.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def drop_site_lines(
    pages: DataFrame,
    host: str = "host",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    dropped: str | None = None,
) -> DataFrame:
    """`pages` without the lines that their host repeats; `dropped` names a column for the number of lines that went."""
    found = stored(site_lines(pages, host, text, ratio, min_pages), "site-lines")
    site, piece, own, marks, kept, n = fresh(pages, "site", "piece", "own_piece", "marks", "kept", "n_all")
    repeated = found.select(
        F.col("host").alias(site), F.col("marks").alias(marks), F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias(piece)
    )
    dealt = pages.withColumn(own, F.pmod(F.xxhash64(text), F.lit(PIECES)).cast("int"))
    joined = dealt.join(repeated, F.col(host).eqNullSafe(F.col(site)) & (F.col(own) == F.col(piece)), "left")
    lines = _lines(F.col(text))
    left = F.when(
        F.col(marks).isNotNull(), F.filter(lines, lambda line: ~F.array_contains(F.col(marks), _mark(line)))
    )
    cleaned = joined.withColumn(kept, left).withColumn(
        n, F.coalesce(F.size(lines) - F.size(F.col(kept)), F.lit(0)).cast("bigint")
    )
    new_text = F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(F.col(kept), "\n"))
    columns = [new_text.alias(c) if c == text else F.col(c) for c in pages.columns]
    return cleaned.select(*columns, *([F.col(n).alias(dropped)] if dropped else []))
