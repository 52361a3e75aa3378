"""Writers: matrices, edge lists, GML, JSON, TEI-XML and plain text. Every writer is distributed and overwrites its folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..ranks import numbered

#: Columns of a dense matrix.
MOST_COLUMNS = 10_000


def matrix_csv(pairs: DataFrame, path: str, value: str = "n", fill: float = 0) -> None:
    """A symmetric matrix from its upper triangle (``a, b, value``): a row and a column per symbol; more than ``MOST_COLUMNS`` are refused."""
    both = pairs.select("a", "b", value).unionByName(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), value))
    names = [r.a for r in both.select("a").distinct().orderBy("a").limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"a matrix of more than {MOST_COLUMNS} columns: write its edges")
    both.groupBy("a").pivot("b", names).agg(F.first(value)).fillna(fill).orderBy("a").write.mode("overwrite").csv(path, header=True)


def edges_csv(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").csv(path, header=True)


def gml(edges: DataFrame, path: str) -> None:
    """An undirected graph (``a, b, weight``) as one GML text per task, ids by order of the node names."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    ids = numbered(nodes, ["node"], "id")
    of = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"id_{c}"))
    node_lines = ids.select(F.lit(1).alias("o"), "id", F.lit(0).alias("id2"), F.format_string('  node [ id %d label "%s" ]', "id", xml_escape(F.col("node"))).alias("value"))
    edge_lines = edges.join(of("a"), "a").join(of("b"), "b").select(F.lit(2).alias("o"), F.col("id_a").alias("id"), F.col("id_b").alias("id2"), F.format_string("  edge [ source %d target %d weight %s ]", "id_a", "id_b", F.col("weight").cast("string")).alias("value"))
    spark = edges.sparkSession
    frame = spark.createDataFrame([(0, 0, 0, "graph [\n  directed 0"), (3, 0, 0, "]")], "o int, id int, id2 int, value string")
    frame.unionByName(node_lines).unionByName(edge_lines).orderBy("o", "id", "id2").select("value").write.mode("overwrite").text(path)


def json_documents(docs: DataFrame, path: str, context: str, key: str = "id") -> None:
    """One JSON-LD object per line and document; null fields are left out."""
    body = F.to_json(F.struct(F.lit(context).alias("@context"), F.concat(F.lit("urn:"), F.col(key).cast("string")).alias("@id"), *docs.columns))
    docs.select(body.alias("value")).write.mode("overwrite").text(path)


def manifest(docs: DataFrame, path: str, key: str = "id") -> None:
    """The collection's manifest: its size and, line by line, its members."""
    docs.select(F.to_json(F.struct(F.concat(F.lit("urn:"), F.col(key).cast("string")).alias("@id"))).alias("value")).write.mode("overwrite").text(path)


def tei_xml(docs: DataFrame, path: str) -> None:
    """TEI documents (the columns of ``readers.TEI_SCHEMA``) in the built-in XML writer."""
    docs.write.mode("overwrite").format("xml").option("rowTag", "TEI").option("rootTag", "teiCorpus").save(path)


def token_text(fmt: str, code: Column, translit: Column, character: Column) -> Column:
    """A token in the wanted form, else in the next that it has."""
    order = {"ab": (code, translit, character), "translit": (translit, code, character), "unicode": (character, code, translit), "mixed": (translit, character, code)}[fmt]
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in order), F.lit("?"))


def plain_text(tokens: DataFrame, fmt: str = "translit") -> DataFrame:
    """``seq_id, text`` of tokens in order."""
    t = token_text(fmt, F.col("symbol"), F.col("translit"), F.col("character"))
    rows = tokens.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", t.alias("t")))).alias("s"))
    return rows.select("seq_id", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("text"))


def write_text(texts: DataFrame, path: str) -> None:
    texts.select(F.concat_ws("\t", F.col("seq_id").cast("string"), "text")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Parquet, ORC, JSON or CSV; CSV takes arrays as JSON text."""
    if fmt == "csv":
        df = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
