"""Joins whose work stays even when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this many rows on, or from this share of all rows if that is more.
HEAVY_ROWS, HEAVY_SHARE = 50_000, 1 / 500


#: Up to this many rows a side is broadcast (counted first).
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``rows`` rows; beyond, as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def one_task(df: DataFrame, rows: int, what: str) -> DataFrame:
    """``df`` in one partition, for steps that depend on their order; more than ``rows`` rows are refused."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"{what}: more than {rows} rows for one task")
    return df.repartition(1)


def heavy_keys(df: DataFrame, keys: list[str], rows: int = HEAVY_ROWS, share: float = HEAVY_SHARE) -> list:
    """The heavy keys, at most ``1 / share`` of them: the count is combined map-side.

    A table of fewer than ``rows`` rows can hold none and is not counted by key;
    that changes the plan, never the result.
    """
    total = df.count()
    if total < rows:
        return []
    counts = df.groupBy(*keys).count()
    return counts.filter(F.col("count") >= max(rows, int(total * share))).select(*keys).collect()


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", rows: int = HEAVY_ROWS) -> DataFrame:
    """Equi-join of ``left`` with a ``right`` that has one row per key.

    Heavy keys of ``left`` (at most 500, see :func:`heavy_keys`) meet their right
    rows by a broadcast of at most that many rows, so their left rows stay where
    they are; all other keys take an ordinary shuffle join. ``left`` is read
    three times, so hand over a table that is written, not a long plan.
    Null keys match nothing. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    heavy = heavy_keys(left, keys, rows)
    if not heavy:
        return left.join(right, keys, how)
    spark = left.sparkSession
    hot = F.broadcast(spark.createDataFrame(heavy, left.select(*keys).schema))
    light = left.join(hot, keys, "left_anti").join(right, keys, how)
    hot_left = left.join(hot, keys, "left_semi")
    hot_right = F.broadcast(right.join(hot, keys, "left_semi"))
    return light.unionByName(hot_left.join(hot_right, keys, how))
