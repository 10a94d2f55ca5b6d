"""Joins that stay balanced when a few keys hold most of the rows.

Adaptive execution splits a skewed partition only where both join inputs come straight out of a shuffle. An input that was
aggregated on the join key does not, and most tables joined here are such aggregates. Hence the split is part of the plan:
rows of a heavy key are spread over numbered pieces and the few matching rows on the other side are repeated per piece.
Without heavy keys the join is a plain one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is heavy above the mean rows of a partition divided by this number.
PIECES_PER_PARTITION = 4

# Per key column: the heavy values and the number of pieces each is split into. None stands for the missing key.
HeavyKeys = Mapping[str, Sequence[tuple[Any, int]]]


def find_heavy(rows: DataFrame, keys: Sequence[str], piece_rows: int | None = None) -> HeavyKeys:
    """All heavy values of each key column, those with more than `piece_rows` rows, counted exactly.

    By default a heavy value has more rows than a quarter of a shuffle partition, so there are at most four times as many
    of them as there are partitions: the list is bounded by that, whatever the data are. Counting combines rows within
    tasks first, so no key is hot. As actions the counts cost a pass over `rows` per column and one for their number;
    give it a stored table rather than a long chain of joins.
    """
    if piece_rows is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        piece_rows = max(1, rows.count() // (PIECES_PER_PARTITION * partitions))
    heavy: dict[str, list[tuple[Any, int]]] = {}
    for k in keys:
        found = rows.groupBy(F.col(k).alias("value")).agg(F.count("*").alias("n")).filter(F.col("n") > piece_rows)
        heavy[k] = [(r.value, -(-r.n // piece_rows)) for r in found.collect()]
    return heavy


def _free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until none of the `taken` columns has them."""
    lower = {c.lower() for c in taken}
    return [next(n for n in (w + "_" * i for i in range(len(lower) + 1)) if n not in lower) for w in wanted]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "left",
    spread_by: Sequence[str] = (),
    *,
    heavy: HeavyKeys,
) -> DataFrame:
    """Join the large `left` to `right` with the heavy keys of `left` split into pieces.

    `how` is inner, left, left_semi or left_anti: joins in which each left row is decided on its own, so cutting a key of
    the left side into pieces leaves the result unchanged. `spread_by` names left columns that differ between rows of one
    key; their hash picks the piece, and a repeated task picks the same one again. Left rows without a key match nothing
    and are spread likewise. `heavy` comes from `find_heavy`, which the caller runs once for all joins of the same rows;
    building this plan starts no job.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"cannot split the left side of a {how} join")
    entries = heavy.get(on, [])
    if not entries:
        joined = left.join(right, on, how)
    else:
        kind = left.schema[on].dataType
        pieces_of, piece = _free_names([*left.columns, *right.columns], "key_pieces", "key_piece")
        schema = T.StructType([T.StructField(on, kind), T.StructField(pieces_of, T.IntegerType())])
        known = [(v, n) for v, n in entries if v is not None]
        table = F.broadcast(left.sparkSession.createDataFrame(known, schema))
        spread = F.xxhash64(*(spread_by or [c for c in left.columns if c != on] or [on]))
        absent = max([n for v, n in entries if v is None], default=1)
        pieces = F.when(F.col(on).isNull(), absent).otherwise(F.coalesce(pieces_of, F.lit(1)))
        cut = left.join(table, on, "left").withColumn(piece, F.pmod(spread, pieces).cast("int"))
        repeated = (
            right.join(table, on, "left")
            .withColumn(piece, F.explode(F.sequence(F.lit(0), F.coalesce(pieces_of, F.lit(1)) - 1)))
            .drop(pieces_of)
        )
        joined = cut.drop(pieces_of).join(repeated, [on, piece], how).drop(piece)
    rest = [c for c in joined.columns if c not in left.columns]
    return joined.select(*left.columns, *rest)
