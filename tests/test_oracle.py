"""Every core query against its SQL on the smallest tables."""

import os
import random

import pandas as pd
import pytest

from glyphflow import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.registry()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    from tools.compare import compare, views

    con = views(SF)
    said = compare(spark, con, name, SF, QUERIES, SQL)
    assert not said.startswith("DIFF"), said


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_leave_nothing_out(spark):
    from glyphflow.operators import cooc, hypotheses, words

    n_tokens = cooc._tokens_with_site(spark, SF).count()
    assert QUERIES["crosstab_all_sites"](spark, SF).agg({"n": "sum"}).first()[0] == n_tokens
    open_symbols = {r.symbol for r in hypotheses._classes(spark, SF).collect()}
    assert {r.symbol for r in QUERIES["random_completion"](spark, SF).collect()} == open_symbols
    assert {r.w for r in QUERIES["weighted_levenshtein"](spark, SF).collect()} == {r.w for r in words._doc_words(spark, SF).collect()}
    assert "permutation_test_1000" in QUERIES


def test_conflicts_at_ties_of_the_mean(spark, tmp_path):
    """Means half way between two rounded values, which a sum of doubles turns by the order of its rows."""
    from tools.compare import compare, views

    rnd, signs = random.Random(2), []
    while len(signs) < 60 * 32:
        values = [round(rnd.uniform(0.6, 1), 2) for _ in range(32)]
        total = 0.0
        for v in values:
            total += v
        whole = sum(round(100 * v) for v in values)
        if whole % 2 and total / 32 * 1e6 % 1 >= 0.5:  # a tie that goes up in the order of the file
            k = len(signs)
            signs += [(f"AB {k // 32 + 1}", k + i, v, rnd.choice(["ka", "ka?"])) for i, v in enumerate(values)]
    pd.DataFrame(signs, columns=["bennett_id", "inscription_id", "confidence", "transliteration"]).to_parquet(tmp_path / "signs.parquet")
    listed = [(f"AB {i}", "syllabogram", "ka", "x" if i % 2 else None) for i in range(1, 61)]
    pd.DataFrame(listed, columns=["bennett_id", "sign_type", "transliteration", "linear_b_character"]).to_parquet(tmp_path / "sign_list.parquet")
    said = compare(spark, views(str(tmp_path)), "conflict_resolution", str(tmp_path), QUERIES, SQL)
    assert said.startswith("ok 60"), said


def test_rounding_of_doubles(spark):
    import duckdb
    from pyspark.sql import functions as F

    from glyphflow.functions.stats import round_product, rounded_mean

    rnd = random.Random(3)
    xs = [s * (rnd.randrange(10**5) / 10**5 + 5e-6) for s in (1, -1) for _ in range(500)] + [0.0, 1e12, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(round_product(F.col("x"), 5)).collect()]
    want = [duckdb.execute("select round(?::double, 5)", [x]).fetchone()[0] for x in xs]
    assert [str(x) for x in got] == [str(x) for x in want]
    cases = {"tie": [0.79, 0.8] * 15 + [0.8, 0.8], "negative": [-0.79, -0.8] * 15 + [-0.8, -0.8], "none": [None], "some": [None, 0.5, 0.25, 0.25], "two": [0.5, 0.25], "long": [1 / 3] * 3, "nan": [float("nan"), 0.5, 0.5], "inf": [float("inf")] * 3, "large": [2e10] * 3}
    rows = [(k, v) for k, vs in cases.items() for v in vs]
    for parts in (1, 2, 7):
        means = {r.k: str(r.m) for r in spark.createDataFrame(rows, "k string, v double").repartition(parts).groupBy("k").agg(rounded_mean(F.col("v")).alias("m")).collect()}
        assert means == {"tie": "0.795313", "negative": "-0.795313", "none": "None", "some": "0.333333", "two": "0.375", "long": "0.333333", "nan": "nan", "inf": "inf", "large": "20000000000.0"}
