"""Readers for the corpus tables and the record-level views that operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_code(code: Column) -> Column:
    """Upper case, no outer white space, one blank between leading letters and the rest."""
    bare = F.upper(F.regexp_replace(code, r"^\s+|\s+$", ""))
    return F.regexp_replace(bare, r"^([A-Z]+)\s*(.+)$", "$1 $2")


def base_code(code: Column) -> Column:
    """A clean code without the variant letter after its number."""
    return F.regexp_replace(code, r"^([A-Z]+ \d+)[A-Z]$", "$1")
