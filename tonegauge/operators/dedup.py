"""Keeping one row per key, and keeping rows whose key is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"
_HASH = "__hash"


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """First row of each key in an explicit order.

    The rank filter becomes a group limit before the shuffle, so a key that holds a large share
    of all rows sends at most one row per map task.
    """
    return top_per_key(df, keys, order_by, 1)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], limit: int
) -> DataFrame:
    """First `limit` rows of each key in an explicit order, with the same early group limit.

    A composite key gets its 64-bit hash as leading part: rows are then sorted by that number, and
    long texts with a common beginning are compared only where the hashes are equal.
    """
    parts = list(keys)
    if len(parts) > 1:
        df = df.withColumn(_HASH, F.xxhash64(*keys))
        parts = [_HASH, *parts]
    order = Window.partitionBy(*parts).orderBy(*order_by)
    ranked = df.withColumn(_RANK, F.row_number().over(order))
    return ranked.filter(F.col(_RANK) <= limit).drop(_RANK, _HASH)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def only_new(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored.

    The stored side is reduced to distinct keys first: one row per key keeps the right side flat,
    and the adaptive skew join may split a hot key on the left.
    """
    return incoming.join(distinct_keys(stored, keys), list(keys), "left_anti")


def only_new_to_history(
    incoming: DataFrame, history: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """`only_new` for a batch against a much longer history.

    The history is first cut down to the keys of the batch. That is a semi join with the small side
    on the right, so the history is filtered where it is read (by broadcast, or by the run-time
    filter of a shuffled join) and only matching keys travel on. `incoming` is read twice: pass
    rows that have been written.
    """
    met = history.select(*keys).join(distinct_keys(incoming, keys), list(keys), "left_semi")
    return incoming.join(met.distinct(), list(keys), "left_anti")
