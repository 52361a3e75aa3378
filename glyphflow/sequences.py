"""Token sequences: records in dense order with their neighbours, whatever a sequence's length.

A window over a whole sequence would give one task a third of the rows if one
sequence holds them. Here a sequence is cut into chunks of positions; ranks add
the sizes of earlier chunks, and neighbours come from a halo of the rows that
stand next to a chunk's border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import clean_code, table

CHUNK = 4096


def sign_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, raw_pos, symbol, kind, translit, character``: one row per legible sign record."""
    signs = table(spark, sf_dir, "signs").filter("bennett_id is not null and inscription_id is not null and sequence is not null")
    rows = signs.select(F.col("inscription_id").alias("seq_id"), F.col("sequence").alias("raw_pos"), clean_code(F.col("bennett_id")).alias("symbol")).distinct()
    known = table(spark, sf_dir, "sign_list").select(F.col("bennett_id").alias("symbol"), F.col("sign_type").alias("kind"), F.col("transliteration").alias("translit"), "character")
    return rows.join(F.broadcast(known), "symbol").select("seq_id", "raw_pos", "symbol", "kind", "translit", "character")  # the fixed sign list


def dense(tokens: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``pos`` 0.. in order of raw_pos within seq_id, without gaps."""
    placed = tokens.withColumn("__c", F.floor(F.col("raw_pos") / chunk))
    sizes = placed.groupBy("seq_id", "__c").agg(F.count("*").alias("__n"))
    before = sizes.select("seq_id", "__c", (F.sum("__n").over(W.partitionBy("seq_id").orderBy("__c")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(W.partitionBy("seq_id", "__c").orderBy("raw_pos"))
    ranked = placed.withColumn("__r", inner).join(before, ["seq_id", "__c"])
    return ranked.withColumn("pos", (F.col("__before") + F.col("__r") - 1).cast("long")).drop("__c", "__r", "__before")


def neighbours(tokens: DataFrame, before: int, after: int, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """Adds ``<column>_m1.._m<before>`` and ``<column>_p1.._p<after>`` of the nearest tokens (``pos`` is dense)."""
    inside = tokens.withColumn("__c", F.floor(F.col("pos") / chunk)).withColumn("__own", F.lit(True))
    at = F.pmod(F.col("pos"), F.lit(chunk))
    halo = []
    if after:
        halo.append(inside.filter((at < after) & (F.col("__c") > 0)).withColumn("__c", F.col("__c") - 1))
    if before:
        halo.append(inside.filter(at >= chunk - before).withColumn("__c", F.col("__c") + 1))
    rows = inside
    for h in halo:
        rows = rows.unionByName(h.withColumn("__own", F.lit(False)))
    w = W.partitionBy("seq_id", "__c").orderBy("pos")
    new = {}
    for c in columns:
        new |= {f"{c}_m{k}": F.lag(c, k).over(w) for k in range(1, before + 1)}
        new |= {f"{c}_p{k}": F.lead(c, k).over(w) for k in range(1, after + 1)}
    return rows.withColumns(new).filter("__own").drop("__c", "__own")


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("seq_id").agg(F.count("*").alias("len"))


def grams(tokens: DataFrame, n: int, column: str = "symbol") -> DataFrame:
    """``seq_id, pos, gram array<string>``: every n tokens in a row."""
    rows = neighbours(tokens, 0, n - 1, [column]) if n > 1 else tokens
    parts = [F.col(column), *(F.col(f"{column}_p{k}") for k in range(1, n))]
    kept = rows.filter(parts[-1].isNotNull()) if n > 1 else rows
    return kept.select("seq_id", "pos", F.array(*parts).alias("gram"))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


CLEAN_SQL = r"regexp_replace(upper(regexp_replace(bennett_id, '^\s+|\s+$', '', 'g')), '^([A-Z]+)\s*(.+)$', '\1 \2')"
#: Opens a WITH: ``tok(seq_id, raw_pos, symbol, kind, translit, character, pos)`` of all legible signs, ``syl`` of syllabograms.
TOKENS_SQL = f"""
WITH t0 AS (SELECT DISTINCT inscription_id AS seq_id, sequence AS raw_pos, {CLEAN_SQL} AS symbol FROM signs
  WHERE bennett_id IS NOT NULL AND inscription_id IS NOT NULL AND sequence IS NOT NULL),
tk AS (SELECT t0.*, sign_type AS kind, transliteration AS translit, character FROM t0 JOIN sign_list ON bennett_id = symbol),
tok AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY raw_pos) - 1 AS pos FROM tk),
syl AS (SELECT seq_id, raw_pos, symbol, kind, translit, character, row_number() OVER (PARTITION BY seq_id ORDER BY raw_pos) - 1 AS pos FROM tk WHERE kind = 'syllabogram')
"""


def all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(sign_tokens(spark, sf_dir))


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllabograms only, filtered before positions are counted."""
    return dense(sign_tokens(spark, sf_dir).filter("kind = 'syllabogram'"))
