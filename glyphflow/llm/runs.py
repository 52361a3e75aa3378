"""Repeated consecutive events (problem 1): each run becomes one event.

Method: boundary interval lookup. Events are sorted globally by (entity,
position) and cut into chunks; per chunk the positions where a run starts form a
sorted array, every event finds its run by binary search in it, and runs are
aggregated. Runs that reach over a chunk's border are stitched from two rows per
chunk. See :mod:`glyphflow.ordered`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordered import sorted_runs
from ..tables import base_code, clean_code, table

SOURCES = ["signs", "reduplication_patterns"]


def collapse_runs(events: DataFrame, least: int = 1) -> DataFrame:
    """One row per run: ``kind, entity, event, first_pos, last_pos, n_events, extent``.

    ``events``: ``kind int, entity long, pos long, event string``; a null event
    breaks a run and, with ``least`` 1, comes out as a run of its own. Rows with a
    null kind, entity or pos are left out, rows repeated for one (kind, entity,
    pos) count once, further columns are ignored, an empty table gives no rows.
    ``extent`` is last_pos - first_pos + 1.
    """
    runs = sorted_runs(events.withColumn("end", F.col("pos")), least=least)
    return runs.select("kind", "entity", "event", "first_pos", "last_pos", F.col("n").alias("n_events"), (F.col("last_pos") - F.col("first_pos") + 1).alias("extent"))


def corpus_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs in order of sequence and reduplication patterns in order of id, as events."""
    signs = table(spark, sf_dir, "signs").select(
        F.lit(0).alias("kind"),
        F.col("inscription_id").alias("entity"),
        F.col("sequence").alias("pos"),
        base_code(clean_code(F.col("bennett_id"))).alias("event"),
    )
    word = F.lower(F.regexp_replace(F.col("pattern_type"), r"^\s+|\s+$", ""))
    patterns = table(spark, sf_dir, "reduplication_patterns").select(
        F.lit(1).alias("kind"),
        F.col("inscription_id").alias("entity"),
        F.col("id").alias("pos"),
        F.nullif(F.translate(word, "- ", "__"), F.lit("")).alias("event"),
    )
    return signs.unionByName(patterns)


def _named(runs: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, SOURCES))
    return runs.withColumn("source_table", F.element_at(names, F.col("kind") + 1)).withColumnRenamed("entity", "inscription_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _named(collapse_runs(corpus_events(spark, sf_dir), least=2))
    return runs.select("source_table", "inscription_id", "first_pos", "last_pos")


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event sequence after collapsing, with each run's count and extent."""
    runs = _named(collapse_runs(corpus_events(spark, sf_dir)))
    return runs.select("source_table", "inscription_id", "event", "first_pos", "last_pos", "n_events", "extent")


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed}

_RUNS = """
WITH ev AS (
  SELECT DISTINCT 'signs' AS source_table, inscription_id, sequence AS pos,
    regexp_replace(regexp_replace(upper(regexp_replace(bennett_id, '^\\s+|\\s+$', '', 'g')), '^([A-Z]+)\\s*(.+)$', '\\1 \\2'),
                   '^([A-Z]+ \\d+)[A-Z]$', '\\1') AS event
  FROM signs
  UNION ALL
  SELECT DISTINCT 'reduplication_patterns', inscription_id, id,
    nullif(translate(lower(regexp_replace(pattern_type, '^\\s+|\\s+$', '', 'g')), '- ', '__'), '')
  FROM reduplication_patterns
), step AS (
  SELECT *, CASE WHEN event = lag(event) OVER w THEN 0 ELSE 1 END AS starts FROM ev
  WINDOW w AS (PARTITION BY source_table, inscription_id ORDER BY pos)
), run AS (
  SELECT *, sum(starts) OVER (PARTITION BY source_table, inscription_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM step
), g AS (
  SELECT source_table, inscription_id, r, min(event) AS event, min(pos) AS first_pos, max(pos) AS last_pos,
    CAST(count(*) AS BIGINT) AS n_events, max(pos) - min(pos) + 1 AS extent
  FROM run GROUP BY source_table, inscription_id, r
)
"""

SQL = {
    "p1_found": _RUNS + "SELECT source_table, inscription_id, first_pos, last_pos FROM g WHERE n_events >= 2",
    "p1_collapsed": _RUNS + "SELECT source_table, inscription_id, event, first_pos, last_pos, n_events, extent FROM g",
}
