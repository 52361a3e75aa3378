"""Hand-computed cases for the sequence layer and the core operators."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphflow.functions import stats as S
from glyphflow.functions import text as T
from glyphflow.operators import cooc, context, corpus, describe, graph, matching, neighbors, ngrams, positional, segment
from glyphflow.sequences import dense, neighbours
from glyphflow.skew import skew_join

TEXTS = {1: "A B A", 2: "A B", 3: "C"}


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(t, 10 * i + 3, s, "x", s.lower(), s) for t, text in TEXTS.items() for i, s in enumerate(text.split())]
    return dense(spark.createDataFrame(rows, "seq_id long, raw_pos long, symbol string, kind string, translit string, character string"))


def test_ngrams(tokens, rows):
    got = {(n, g): c for n, g, c, _ in rows(ngrams.ngram_counts(tokens, 2), "n", "gram", "count", "probability")}
    assert got == {(1, "A"): 3, (1, "B"): 2, (1, "C"): 1, (2, "A B"): 2, (2, "B A"): 1}


def test_conditional_entropy(tokens):
    r = ngrams.conditional_entropy(tokens, 1).first()
    assert (r.total_events, r.unique_contexts, r.entropy, r.perplexity) == (3, 2, 0.0, 1.0)


def test_lexical(tokens):
    r = ngrams.lexical_stats(tokens).first()
    assert (r.ttr, r.hapax, r.dis, r.entropy) == (0.5, 1, 1, 1.459148)


def test_pmi(tokens, rows):
    got = rows(ngrams.bigram_pmi(tokens, 1), "sign_a", "sign_b", "pmi", "mi_contribution")
    assert got == [("A", "B", 2.0, 1.333333), ("B", "A", 1.0, 0.333333)]


def test_positions(tokens, rows):
    got = rows(positional.profiles(tokens), "symbol", "n_initial", "n_medial", "n_final", "total", "occurrences")
    assert got == [("A", 2, 0, 1, 3, 3), ("B", 0, 1, 1, 2, 2), ("C", 1, 0, 1, 2, 1)]


def test_cooccurrence(tokens, rows):
    c = cooc.cooccurrence(tokens)
    assert rows(c) == [("A", "A", 2), ("A", "B", 2), ("B", "B", 2), ("C", "C", 1)]
    assert rows(cooc.association(c), "a", "b", "jaccard", "pmi_pair_total", "tscore") == [("A", "B", 1.0, 1.807355, 1.010153)]
    r = cooc.matrix_summary(c).first()
    assert (r.non_zero, r.possible, r.density) == (4, 6, 0.666667)


def test_recurring_and_graphs(tokens, rows):
    assert rows(ngrams.recurring_grams(tokens, 2), "gram") == [("A B",)]
    assert rows(graph.succession(tokens), "src", "dst", "weight") == [("A", "B", 2), ("B", "A", 1)]
    assert rows(graph.undirected(tokens), "src", "dst", "weight") == [("A", "B", 2)]


def test_all_of_and_run(tokens, rows):
    assert rows(corpus.having_all(tokens, ["A", "B"])) == [(1,), (2,)]
    assert rows(corpus.having_run(tokens, ["B", "A"])) == [(1, 1, 1)]


def test_small_chunks_change_nothing(spark, rows):
    t = spark.createDataFrame([(1, p, f"s{p % 7}") for p in range(0, 300, 3)] + [(2, 5, "x")], "seq_id long, raw_pos long, symbol string")
    a = neighbours(dense(t), 2, 3, ["symbol"])
    b = neighbours(dense(t, 7), 2, 3, ["symbol"], 4)
    assert rows(a, *sorted(a.columns)) and sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


def test_statistics(spark):
    v = spark.range(1).select(
        sum((S.hypergeom_pmf(F.lit(k), F.lit(10), F.lit(4), F.lit(5)) for k in (3, 4)), F.lit(0.0)).alias("tail"),
        S.ln_factorial(F.lit(50)).alias("f"), S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"),
    ).first()
    assert round(v.tail, 6) == 0.261905
    assert abs(v.f - math.lgamma(51)) < 1e-9
    assert abs(v.c - math.sqrt(0.5)) < 1e-12


def test_labels(spark, rows):
    df = spark.createDataFrame([("pa",), ("a",), ("nwa",), ("",)], "w string")
    assert [r.l for r in df.select("w", T.cv_label(F.col("w")).alias("l")).collect()] == ["CV", "V", "CCV", None]
    d = spark.createDataFrame([("ku-ro", "ki-ro"), ("a-b-c", "b-c"), ("a", "a")], "a string, b string")
    assert [r.d for r in d.select(matching.token_levenshtein("a", "b").alias("d")).collect()] == [1, 1, 0]
    assert [r.d for r in d.select(T.weighted_levenshtein(F.col("a"), F.col("b")).alias("d")).collect()] == [0.5, 2.0, 0.0]


def test_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,)], "v double")
    r = describe.describe(df.withColumn("g", F.lit(1)), ["g"], "v").first()
    assert (r.p25, r.p50, r.p75) == (1.5, 2.0, 3.5)
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "v long")
    assert segment.index_pick(n, "v", 0.5).first()[0] == 3
    assert segment.index_pick(n, "v", 0.25).first()[0] == 2


def test_hamming(spark, rows):
    g = spark.createDataFrame([(list(x),) for x in ("ABC", "ABD", "XBD")], "gram array<string>")
    assert rows(matching.hamming_one(g, 3), "gram_a", "gram_b", "place") == [("A B C", "A B D", 2), ("A B D", "X B D", 0)]


def test_vote_needs_more_than_half(spark):
    a = spark.createDataFrame([(1, 2)], "seq_id long, pos long")
    none = a.limit(0)
    assert segment.vote([a, a, none, none]).count() == 0
    assert segment.vote([a, a, a, none]).first().confidence == 0.75


def test_empty_tokens(spark, tokens):
    none = tokens.limit(0)
    for df in (ngrams.ngram_counts(none, 2), ngrams.conditional_entropy(none), positional.fractions(none), cooc.cooccurrence(none), graph.pagerank(graph.succession(none)), graph.components(graph.undirected(none)), context.masked_context(none)):
        assert df.count() == 0


def test_pagerank_sums_to_one_and_components(spark, rows):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("x", "y", 1)], "src string, dst string, weight long")
    assert abs(sum(r.rank for r in graph.pagerank(e).collect()) - 1) < 1e-4
    assert rows(graph.components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    got = dict(rows(graph.betweenness(e.filter("src < 'x'"))))
    assert got == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_skew_join_splits_the_hot_key(spark, rows):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(None, 7), (3, 8)], "k long, v long")
    right = spark.createDataFrame([(1, "one"), (2, "two")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, skew_join(left, right, ["k"], how, rows=10).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect()))


def test_topk_in_blocks(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    whole = rows(neighbors.cosine_topk(df, df.filter("vec_id % 4 = 0"), 3))
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 3)
    assert rows(neighbors.cosine_topk(df, df.filter("vec_id % 4 = 0"), 3)) == whole
    assert neighbors.cosine_topk(df.limit(0), df.limit(0)).count() == 0


def test_last_version_wins(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d")], "id long, v long, x string")
    assert rows(corpus.latest(df, ["id"], ["v"]), "id", "x") == [(1, "c"), (2, "d")]


def test_viterbi_decodes_whole_sequences(spark):
    """Boundaries at multiples of the chunk come out, and all equal one decoding of the whole sequence."""
    rng = random.Random(3)
    seqs = {1: [rng.choice("AAABBCD") for _ in range(9000)], 2: ["A", "B", "C"], 3: ["D"], **{k: [rng.choice("AB"), "C"] for k in range(4, 40)}}
    for at in (4096, 8192):
        seqs[1][at - 1 : at + 1] = ["C", "A"]  # seldom next to each other, and A begins often
    seqs[1] = [s for i, s in enumerate(seqs[1]) if not (s == "A" and i and seqs[1][i - 1] == "C" and i not in (4096, 8192))]
    seqs[1] = seqs[1][:4095] + ["C", "A"] + seqs[1][4097:]
    df = spark.createDataFrame([(k, i, s) for k, v in seqs.items() for i, s in enumerate(v)], "seq_id long, pos long, symbol string")
    got = {(r.seq_id, r.pos) for r in segment.by_viterbi(df).collect()}
    succ, first, n = Counter(), Counter(v[0] for v in seqs.values()), Counter(s for v in seqs.values() for s in v)
    for v in seqs.values():
        succ.update(zip(v[:-1], v[1:], strict=True))
    heads, size, smooth, want = len(seqs), len(n), 0.01, set()
    for k, v in seqs.items():
        score, back = [math.log((first[v[0]] + smooth) / (heads + smooth * size)), -math.inf], []
        for a, b in zip(v[:-1], v[1:], strict=True):
            best = int(score[1] > score[0])
            back.append(best)
            score = [score[best] + math.log((first[b] + smooth) / (heads + smooth * size)), score[best] + math.log((succ[a, b] + smooth) / (n[a] + smooth * size))]
        state = int(score[1] > score[0])
        for i in range(len(v) - 1, 0, -1):
            want |= {(k, i)} if state == 0 else set()
            state = back[i - 1]
    assert (1, 4096) in want and got == want
