"""Readers for corpus formats, all with stated schemas: JSON word lists, assigned JSON in scripts, TEI-XML, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sequences import dense
from ..skew import bounded

ENTRY = T.StructType(
    [
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("transliteratedWords", T.ArrayType(T.StringType())),
        T.StructField("site", T.StringType()),
        T.StructField("support", T.StringType()),
        T.StructField("context", T.StringType()),
    ]
)
SIGN = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "code", "transcription", "type", "x", "y", "w", "h")])
DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("site", T.StringType()), T.StructField("location", T.StringType()), T.StructField("period", T.StringType()), T.StructField("signs", T.ArrayType(SIGN))])
DIVIDER = "|"


def json_pairs(spark: SparkSession, path: str, schema: T.StructType = ENTRY) -> DataFrame:
    """A file that holds one list of [name, entry] pairs: ``name`` and the entry's fields."""
    raw = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", T.ArrayType(T.ArrayType(T.StringType())))
    rows = raw.select(F.explode(pairs).alias("p"))
    return rows.select(F.col("p")[0].alias("name"), F.from_json(F.col("p")[1], schema).alias("e")).select("name", "e.*")


def keyed_json(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """A file that holds one object keyed by name."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias("name", "e"))


def with_supplement(entries: DataFrame, supplement: DataFrame) -> DataFrame:
    """Entries with the fields of a supplement where their own are missing (``supplement``: name, e struct)."""
    fields = supplement.schema["e"].dataType.names
    s = supplement.select("name", *(F.col(f"e.{f}").alias(f"s_{f}") for f in fields))
    return entries.join(s, "name", "left").select("name", *(F.coalesce(c, f"s_{c}").alias(c) if c in fields else F.col(c) for c in entries.columns if c != "name"))


def word_tokens(entries: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``name, pos, character, kind, word, line``: the signs of a word list in order.

    Words alternate with ``|`` for a divider and line breaks, which end a word and
    a line but are no token. Every other character is a sign; ``symbols(character,
    code)`` adds its code. A word list is one row of its file; its signs are placed
    in chunks, so a long one spreads over tasks.
    """
    parts = entries.select("name", F.posexplode("words").alias("i", "w")).filter("w is not null")
    chars = parts.select("name", "i", "w", F.posexplode(F.regexp_extract_all("w", F.lit("(?s)(.)"), F.lit(1))).alias("j", "character"))
    # a word has fewer than 2^20 signs; the line breaks before a sign end the lines before it
    marks = chars.withColumn("raw_pos", F.shiftleft(F.col("i").cast("long"), 20) + F.col("j")).withColumnRenamed("name", "seq_id")
    breaks = marks.groupBy("seq_id", "i").agg(F.count_if(F.col("character") == "\n").alias("n"))
    before = breaks.select("seq_id", "i", (F.sum("n").over(W.partitionBy("seq_id").orderBy("i")) - F.col("n")).alias("before"))  # a row per word of a list
    inside = F.size(F.filter(F.split(F.substring(F.col("w"), F.lit(1), F.col("j") + 1), ""), lambda c: c == "\n"))
    kept = marks.join(before, ["seq_id", "i"]).withColumn("line", F.col("before") + inside).filter("character not in ('\n', ' ')")
    kind = F.when(F.col("character") == DIVIDER, "divider").otherwise("sign")
    out = dense(kept).select(F.col("seq_id").alias("name"), "pos", "character", kind.alias("kind"), F.col("i").alias("word"), "line")
    return out if symbols is None else out.join(bounded(symbols), "character", "left")


def script_json(spark: SparkSession, path: str, element: T.StructType = DOCUMENT) -> DataFrame:
    """A script that assigns one array: comments, the assignment, bare keys and trailing commas are undone."""
    t = F.col("value")
    for pattern, to in ((r"(?s)/\*.*?\*/", ""), (r"(?m)^\s*//.*$", ""), (r"(?s)^\s*(?:export\s+)?(?:const|let|var)?\s*[\w.]+\s*=\s*", ""), (r";\s*$", ""), (r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":'), (r",(\s*[}\]])", "$1")):
        t = F.regexp_replace(t, pattern, to)
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(t, T.ArrayType(element))).alias("d")).select("d.*")


def json_dump(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, lines: bool = False) -> DataFrame:
    """Objects of one document each: one per line, or a file that is an array or one object."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def first_of(df: DataFrame, *names: str) -> Column:
    """The first non-empty of several possible columns; those the table lacks are passed over."""
    have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def documents(df: DataFrame) -> DataFrame:
    """Documents of differing field names in one shape."""
    return df.select(first_of(df, "id", "name").alias("gorila_id"), first_of(df, "site", "location", "findspot").alias("site"), first_of(df, "period", "date", "chronology").alias("period"), "signs")


def document_signs(docs: DataFrame) -> DataFrame:
    """One row per sign, numbered from 0, with numbers read safely."""
    return docs.select("gorila_id", F.posexplode("signs").alias("pos", "s")).select("gorila_id", "pos", F.upper(F.regexp_replace("s.code", r"^([A-Za-z]+)\s*0*(\d+)", "$1 $2")).alias("code"), F.col("s.transcription").alias("transliteration"), *(F.col(f"s.{c}").try_cast("double").alias(f"bbox_{c}") for c in "xywh"))


TEI_SCHEMA = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("origPlace", T.StringType()),
        T.StructField("origDate", T.StringType()),
        T.StructField("material", T.StringType()),
        T.StructField("g", T.ArrayType(T.StructType([T.StructField("_n", T.LongType()), T.StructField("_ref", T.StringType()), T.StructField("_type", T.StringType()), T.StructField("_VALUE", T.StringType())]))),
    ]
)


def tei(spark: SparkSession, path: str, schema: T.StructType = TEI_SCHEMA) -> DataFrame:
    """TEI documents of a file or directory, one row each."""
    return spark.read.format("xml").option("rowTag", "TEI").schema(schema).load(path)


def tei_signs(docs: DataFrame) -> DataFrame:
    """The sign elements of each document in order, without the leading # of their references."""
    return docs.select(F.col("_id").alias("gorila_id"), F.explode("g").alias("g")).select("gorila_id", F.col("g._n").alias("sequence"), F.regexp_replace("g._ref", "^#", "").alias("code"), F.col("g._type").alias("kind"), F.col("g._VALUE").alias("transliteration"))


def tei_field(text: Column, path: str) -> Column:
    """An ad-hoc field of a whole document by XPath."""
    return F.xpath_string(text, F.lit(path))


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header and stated schema; a missing file gives an empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema)


def segmented_text(spark: SparkSession, path: str) -> DataFrame:
    """``name<tab>words`` lines: one row per word with its place."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") == 2)
    return lines.select(F.col("p")[0].alias("name"), F.posexplode(F.filter(F.split(F.col("p")[1], " "), lambda w: w != "")).alias("word_index", "word"))


def upper_bound(c: Column) -> Column:
    """The number of a cell; of a range a-b its upper bound."""
    return F.regexp_extract(c, r"(\d+)\s*$", 1).try_cast("long")


def sample_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A small corpus made by rule: 12 inscriptions of 3 sites, sign k of text t is a syllable of a fixed cycle."""
    ins = [(t, f"XX {t}", f"Site {t % 3}", "LM IB" if t % 2 else "MM II") for t in range(1, 13)]
    syl = ["da", "ro", "ki", "sa", "me", "nu"]
    signs = [(t * 100 + k, t, k, f"AB {1 + (t * k) % 6:02d}", syl[(t * k) % 6]) for t in range(1, 13) for k in range(2 + t % 5)]
    return spark.createDataFrame(ins, "id long, gorila_id string, site string, minoan_period string"), spark.createDataFrame(signs, "id long, inscription_id long, sequence long, bennett_id string, transliteration string")
