"""Rules for repeated keys, as aggregates: partial results are combined before the shuffle, whatever a key's size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names as N


def _one_per_key(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    """The rows whose `order` is picked for their key. Only keys and orders are aggregated; whole rows go through one join
    on key and order, which also parts the rows of a frequent key."""
    kept = df.groupBy(*keys).agg(pick(order).alias(order))
    kept = kept.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(kept.columns)])
    same = [F.col(c).eqNullSafe(F.col(f"kept_{i}")) for i, c in enumerate([*keys, order])]
    return df.join(kept, reduce(Column.__and__, same), "left_semi")


def _grouped(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    """The same in one shuffle by key, which the result keeps: whole rows are aggregated, sorted by key."""
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.col(order)).alias("kept")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"kept.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: str = N.ROW_ORDER, grouped: bool = False) -> DataFrame:
    """One row per key: the one with the smallest `order`, which must be unique within a key. `grouped` leaves the result
    partitioned by key, for what goes on to work by key."""
    return _grouped(df, list(keys), order, F.min_by) if grouped else _one_per_key(df, list(keys), order, F.min)


def keep_last(df: DataFrame, keys: Sequence[str], order: str = N.ROW_ORDER, grouped: bool = False) -> DataFrame:
    """One row per key: the one with the largest `order`, which must be unique within a key. `grouped` as above."""
    return _grouped(df, list(keys), order, F.max_by) if grouped else _one_per_key(df, list(keys), order, F.max)


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present are {df.columns}")
