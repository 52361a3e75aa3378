"""Round trips through the readers and writers, as queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import table_path
from ..sequences import TOKENS_SQL, all_tokens
from ..sources import readers as R
from ..sources import writers as Wr
from .cooc import _cooc, cooccurrence


def tei_documents(t):
    """Token sequences as documents of the TEI reader's shape."""
    g = F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol", "kind", "translit"))), lambda x: F.struct(x["pos"].alias("_n"), F.concat(F.lit("#"), x["symbol"]).alias("_ref"), x["kind"].alias("_type"), x["translit"].alias("_VALUE")))
    return t.groupBy("seq_id").agg(g.alias("g")).select(F.col("seq_id").cast("string").alias("_id"), F.concat(F.lit("Text "), "seq_id").alias("title"), "g")


def _tei(s, d):
    path = table_path(s, "tei")
    Wr.tei_xml(tei_documents(all_tokens(s, d)), path)
    return R.tei_signs(R.tei(s, path)).select(F.col("gorila_id").cast("long").alias("seq_id"), "sequence", "code", "kind", "transliteration")


def _text(s, d):
    path = table_path(s, "text")
    Wr.write_text(Wr.plain_text(all_tokens(s, d).filter("kind = 'syllabogram'")), path)
    return R.segmented_text(s, path).groupBy("word").agg(F.count("*").alias("n"))


def _json(s, d):
    path = table_path(s, "json")
    docs = Wr.plain_text(all_tokens(s, d), "ab").withColumnRenamed("seq_id", "id")
    Wr.json_documents(docs, path, "https://example.org/corpus")
    back = R.json_dump(s, path, T.StructType([T.StructField("@id", T.StringType()), T.StructField("id", T.LongType()), T.StructField("text", T.StringType())]), lines=True)
    return back.select(F.col("@id").alias("urn"), "id", "text")


def _edges(s, d):
    path = table_path(s, "edges")
    Wr.edges_csv(cooccurrence(all_tokens(s, d)).filter("a < b"), path)
    return R.csv_table(s, path, T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())]))


QUERIES = {"roundtrip_tei": _tei, "roundtrip_text": _text, "roundtrip_json": _json, "roundtrip_edges": _edges}
SQL = {
    "roundtrip_tei": TOKENS_SQL + "SELECT seq_id, pos AS sequence, symbol AS code, kind, translit AS transliteration FROM tok",
    "roundtrip_text": TOKENS_SQL + "SELECT translit AS word, count(*) AS n FROM syl GROUP BY translit",
    "roundtrip_json": TOKENS_SQL + "SELECT 'urn:' || seq_id AS urn, seq_id AS id, string_agg(symbol, ' ' ORDER BY pos) AS text FROM tok GROUP BY seq_id",
    "roundtrip_edges": TOKENS_SQL + _cooc() + "SELECT a, b, n FROM co WHERE a < b",
}
