"""Per-key results where a few keys hold most rows (problem 3).

Method: multi-level tree aggregation. Records are dealt into chunks of about a
fixed size by a hash of their id, whatever their key; each chunk combines its
records per key; then states of ``fan_in`` chunks merge per round until one chunk
is left. A key meets at most ``fan_in`` states of it at once, so a key that owns
a third of all rows costs one state per chunk like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from ..tables import clean_code, table

#: Records of a chunk, about, and chunks that one merge takes.
CHUNK_ROWS, FAN_IN = 65_536, 16


class State:
    """A mergeable state column: how a record starts it and how two merge."""

    def __init__(self, name: str, start: Column, merge):
        self.name, self.start, self.merge = name, start, merge


def counted(name: str = "n") -> State:
    return State(name, F.lit(1).cast("long"), F.sum)


def summed(name: str, value: Column) -> State:
    return State(name, value, F.sum)


def least(name: str, value: Column) -> State:
    return State(name, value, F.min)


def most(name: str, value: Column) -> State:
    return State(name, value, F.max)


def tree_aggregate(records: DataFrame, record_id: str, keys: dict[str, Column], states: list[State], chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``field_name, key_value`` and the states, for each value of each column in ``keys``.

    Rows with the same ``record_id`` (a long) are one record and the one that comes
    first in the order of all its columns counts; rows without id are left out. A
    null key gives no group, null inputs of a state are passed over as by SQL
    aggregates. An empty table gives no rows. The states are written once.
    """
    chunks = max(1, math.ceil(records.count() / chunk_rows))
    chunk = F.pmod(F.xxhash64("__id"), F.lit(chunks))
    cols = [F.col(record_id).cast("long").alias("__id"), F.struct(*(c.cast("string").alias(k) for k, c in keys.items()), *(s.start.alias(f"s_{s.name}") for s in states)).alias("r")]
    dealt = records.filter(F.col(record_id).isNotNull()).select(*cols).withColumn("chunk", chunk).repartition("chunk")
    single = dealt.groupBy("chunk", "__id").agg(F.min("r").alias("r"))
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("field_name"), F.col(f"r.{k}").alias("key_value")) for k in keys)))
    local = single.select("chunk", entries.alias("e"), "r").select("chunk", "e.field_name", "e.key_value", "r.*").filter("key_value is not null")
    out = local.groupBy("chunk", "field_name", "key_value").agg(*(s.merge(f"s_{s.name}").alias(s.name) for s in states))
    while chunks > 1:
        chunks = math.ceil(chunks / fan_in)
        out = out.withColumn("chunk", F.floor(F.col("chunk") / fan_in)).groupBy("chunk", "field_name", "key_value").agg(*(s.merge(s.name).alias(s.name) for s in states))
    return written(out.drop("chunk"), "states")  # read more than once, and a row per key


def _sign_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = table(spark, sf_dir, "signs")
    sure = F.round(F.col("confidence") * 100).cast("long")  # hundredths: sums don't depend on their order
    keys = {"bennett_id": clean_code(F.col("bennett_id")), "inscription_id": F.col("inscription_id")}
    return tree_aggregate(
        signs, "id", keys,
        [
            counted("n_records"), summed("n_sure", F.col("confidence").isNotNull().cast("long")), summed("sum_sure", sure), summed("sum_sq", sure * sure),
            least("first_sequence", F.col("sequence")), most("last_sequence", F.col("sequence")),
        ],
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy keys: at least 2 % of the sign records with a bennett_id, or 400 records of an inscription."""
    stats = _sign_stats(spark, sf_dir)
    codes = stats.filter("field_name = 'bennett_id'")
    # at most 50 keys hold 2 %; the total is one row
    share = codes.crossJoin(F.broadcast(codes.agg(F.sum("n_records").alias("total")))).filter("n_records * 50 >= total").select("field_name", "key_value")
    return share.unionByName(stats.filter("field_name = 'inscription_id' and n_records >= 400").select("field_name", "key_value"))


def p3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and spread of confidence and extent of sequence of every key."""
    mean = F.col("sum_sure") / F.col("n_sure")
    return _sign_stats(spark, sf_dir).select(
        "field_name", "key_value", "n_records", F.round(mean / 100, 6).alias("mean_confidence"),
        F.round(F.sqrt(F.greatest(F.col("sum_sq") / F.col("n_sure") - mean * mean, F.lit(0.0))) / 100, 6).alias("sd_confidence"),
        "first_sequence", "last_sequence",
    )


QUERIES = {"p3_found": p3_found, "p3_stats": p3_stats}

_RECORDS = """
WITH r AS (
  SELECT id, min(regexp_replace(upper(regexp_replace(bennett_id, '^\\s+|\\s+$', '', 'g')), '^([A-Z]+)\\s*(.+)$', '\\1 \\2')) AS b,
    min(inscription_id) AS i FROM signs GROUP BY id
)
"""
_STATS = """
WITH d AS (
  SELECT id, regexp_replace(upper(regexp_replace(bennett_id, '^\\s+|\\s+$', '', 'g')), '^([A-Z]+)\\s*(.+)$', '\\1 \\2') AS b,
    CAST(inscription_id AS VARCHAR) AS i, CAST(round(confidence * 100) AS BIGINT) AS c, sequence AS q
  FROM signs WHERE id IS NOT NULL
), r AS (
  SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY b NULLS FIRST, i NULLS FIRST, (c IS NOT NULL), c NULLS FIRST, q NULLS FIRST) = 1
), k AS (
  SELECT 'bennett_id' AS field_name, b AS key_value, c, q FROM r WHERE b IS NOT NULL
  UNION ALL SELECT 'inscription_id', i, c, q FROM r WHERE i IS NOT NULL
)
SELECT field_name, key_value, count(*) AS n_records, round(avg(c) / 100, 6) AS mean_confidence,
  round(sqrt(greatest(sum(c * c) / count(c) - (sum(c) / count(c)) * (sum(c) / count(c)), 0)) / 100, 6) AS sd_confidence,
  min(q) AS first_sequence, max(q) AS last_sequence
FROM k GROUP BY ALL
"""
SQL = {
    "p3_found": _RECORDS
    + """SELECT 'bennett_id' AS field_name, b AS key_value FROM r WHERE b IS NOT NULL GROUP BY b
  HAVING count(*) * 50 >= (SELECT count(*) FROM r WHERE b IS NOT NULL)
UNION ALL SELECT 'inscription_id', CAST(i AS VARCHAR) FROM r WHERE i IS NOT NULL GROUP BY i HAVING count(*) >= 400""",
    "p3_stats": _STATS,
}
