"""Look-alikes, leaks, mixing and abuse scoring: brute force, nulls, long texts, repeats, empty tables."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import abuse, gru, leaks, lookalikes, mixing

AUTO = lookalikes.Automaton(["ša", "FAR TE", "1", "|", "U+10645", "i", "ra₂", "𐙅"], {"𐀘": "𐙅"})


@pytest.mark.parametrize(
    "value,want",
    [("ša", "ša"), ("šа", "ša"), ("ＦＡＲ　ＴＥ", "FAR TE"), ("FAR T​E️", "FAR TE"), (" ša ", "ša"), ("U+lО645", "U+10645"), ("｜", "|"), ("𐀘", "𐙅"), ("﻿1", "1"),
     ("ŠA", None), ("I", None), ("ra2", None), ("ša?", None), ("[1]", None), ("FARTE", None), ("sa", None), ("u+10645", None), ("", None)],
)
def test_automaton_costs_nothing_for_looks_only(value, want):
    assert AUTO.match(value)[0] == want


def test_automaton_counts_other_edits():
    assert AUTO.match("FAR T", 2) == ("FAR TE", 2)
    assert AUTO.match("FAR TEE", 2) == ("FAR TE", 2)
    assert AUTO.match("FOR TЕ", 2) == ("FAR TE", 2)
    assert AUTO.match("FO TE", 2)[0] is None
    assert AUTO.match("Far Te", 1)[0] is None and AUTO.match("Far TE", 2) == ("FAR TE", 2)
    assert AUTO.match("FAr TE", 1) == ("FAR TE", 1)
    assert AUTO.match("ra2", 1) == ("ra₂", 1) and AUTO.match("sa", 1) == ("ša", 1)
    assert AUTO.match("FÁR TE", 1) == ("FAR TE", 1)


@pytest.mark.parametrize(
    "value,want",
    [("𝐅𝐀𝐑 𝖳𝙴", "FAR TE"), ("ﬁn", "fin"), ("a–b", "a-b"), ("Ⅱ", "II"), ("Ⅾ", "D"), ("ᎪꓮᏴ", "AAB"), ("a∗b", "a*b"), ("ℓ", "l"), ("ᴏꜱ", "os"), ("a\xa0b", "a b"), ("½", "½"), ("①", "①"), ("ra₂", "ra₂"), ("x²", "x²"), ("ﬁ\u200bt", "fit")],
)
def test_table_gives_one_form_for_one_look(value, want):
    assert lookalikes.by_table(value) == want


def test_forms_of_nulls_long_texts_and_clashing_columns(spark):
    long_text = "ｘ" * 300_000
    df = spark.createDataFrame([(1, "šа", 0), (2, None, 0), (3, "", 0), (4, long_text, 0), (4, long_text, 0)], "id long, v string, v_raw int")
    out = lookalikes.canonical_forms(df, {"v": (["ša"], {})}, ["id", "v_raw"])
    got = sorted(((r.id, r.v_form, r.v_cost) for r in out.collect()), key=str)
    assert got == sorted([(1, "ša", 0), (2, None, None), (3, "", None), (4, "x" * 300_000, -1), (4, "x" * 300_000, -1)], key=str)
    assert lookalikes.canonical_forms(df.limit(0), {"v": ([], {})}, ["id"]).count() == 0


def _words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]


def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SLICE", 40)
    monkeypatch.setattr(leaks, "LONG", 2000)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ünïcode", "ra₂", "𐙅"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40)))) for i in range(12)] + [(50, None), (51, ""), (None, "a b")]
    docs = []
    for d in range(40):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            s = _words(items[d % 12][1])
            a = rng.randrange(max(1, len(s) - 8))
            t[5:5] = s[a : a + rng.randrange(8, 20)]
        docs.append((d, (", " if d % 3 else "\n").join(t).upper()))
    docs += [(100, None), (101, ""), (102, " ".join(words * 300) + " " + items[3][1]), (None, "x")] + docs[:6]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("at", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(df, spark.createDataFrame(items, "item_id long, text string")).filter("same").collect()}
    want = set()
    for d, t in docs:
        for i, u in items:
            if d is not None and i is not None:
                a, b = _words(t), _words(u)
                grams = {tuple(a[k : k + 12]) for k in range(len(a) - 11)}
                if any(tuple(b[k : k + 12]) in grams for k in range(len(b) - 11)):
                    want.add((d, i))
    assert got == want and (102, 3) in got


def test_similar_windows_equal_brute_force(spark):
    """Windows of similarity 0.8 or more are found however far their fingerprints are apart."""
    rng = random.Random(8)
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(14))) for i in range(60)]
    items.append((60, " ".join(["on and"] * 7)))
    docs = []
    for i, t in items:
        w = t.split()
        docs += [(10 * i + k, " ".join(["before", *w[: 12 - k], *["x" * (1 + k)] * k, "after", "it"])) for k in range(3)]
        docs.append((10 * i + 4, " ".join([*w[:11], "unlike", *w[2:14]])))
    got = {(r.doc_id, r.item_id): (r.n_windows, round(r.best, 9)) for r in leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    grams = lambda t: [{tuple(w[a + k : a + k + 5]) for k in range(8)} for w in [t.split()] for a in range(len(w) - 11)]
    size = lambda s: sum(len(x) for g in s for x in g)
    want, apart = {}, [(i, grams(t)) for i, t in items]
    for d, t in docs:
        for i, windows in apart:
            best = [max(size(a & b) / size(a | b) for b in windows) for a in grams(t)]
            good = [b for b in best if b >= 0.8]
            if good:
                want[d, i] = (len(good), round(max(good), 9))
    assert got == want and len(want) > 100


def _planted(every, size, n=150, seed=3):
    """Items of ``size`` words, and for each a document with the item inside, every so many words another."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(size))) for i in range(n)]
    docs = [(i, " ".join([*(word() for _ in range(20)), *(word() if every and k % every == every - 1 else w for k, w in enumerate(t.split())), *(word() for _ in range(20))])) for i, t in items]
    return items, docs


@pytest.mark.parametrize("every,size,shingle,least,recall", [(60, 60, 5, 0.8, 1.0), (10, 40, 2, 0.5, 0.9), (12, 40, 2, 0.5, 0.9), (10, 40, 5, 0.8, 0.0)])
def test_item_sized_windows_find_changed_items(spark, every, size, shingle, least, recall):
    """With shingles of five and 0.8 a changed word in sixty is found; every tenth word takes shorter shingles and a lower bound."""
    items, docs = _planted(every, size)
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=None, shingle=shingle, least=least).collect()}
    hit = sum((i, i) in got for i, _ in items) / len(items)
    assert hit >= recall and all(d == i for d, i in got)
    assert recall or hit == 0.0


def test_item_sized_windows_in_pieces_equal_whole_texts(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(n))) for i, n in enumerate((5, 6, 9, 14, 23, 40))]
    docs = [(1, " ".join([t for _, t in items] * 3 + [f"w{rng.randrange(40)}" for _ in range(200)])), (2, "w1 w2"), (3, None)]
    run = lambda: sorted(tuple(r) for r in leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=None).collect())
    whole = run()
    assert {r[1] for r in whole} == set(range(6))
    monkeypatch.setattr(leaks, "LONG", 100)
    monkeypatch.setattr(leaks, "islice", lambda it, n: __import__("itertools").islice(it, 50))
    assert run() == whole


def test_leak_index_finds_everything_within_the_radius():
    rng = np.random.default_rng(1)
    index = leaks.Index([(1, " ".join(f"a{i}" for i in range(40)))], 12, 5, 3)
    f = np.concatenate([index.f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 1, 2, 3, 4)])
    i, j = index.near(f)
    want = {(a, b) for a in range(len(f)) for b in range(index.n) if int(f[a] ^ index.f[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked(docs, items).count() == 0


def test_share_plan():
    sizes, targets = [("a", 10, 1000), ("b", 5, 100), ("c", 1, 0)], [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 1), ("z", 0.1, 9)]
    rate = mixing.plan_shares(sizes, targets)
    assert abs(rate["b"] - 2) < 1e-9 and abs(1000 * rate["a"] / (100 * rate["b"]) - 5 / 3) < 1e-9
    full = mixing.plan_shares(sizes, targets, total=5000)
    assert full == {"b": 2.0, "a": 1.0}
    assert mixing.plan_shares([], targets) == {}


@pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no tokenizer")
def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, " Big " if i < 300 else "small", "word " * rng.randrange(1, 40)) for i in range(340)] + [(900, None, "x"), (901, "big", None), (902, "big", ""), (None, "big", "y"), (903, "other", "z"), (904, "small", "long " * 400_000)]
    df = spark.createDataFrame(docs + docs[:20], "doc_id long, source string, text string").withColumn("copies", F.lit(1)).withColumn("rank", F.lit(1))
    goals = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(df, goals)
    rows = drawn.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.copies <= {"big": 1, "small": 3}[r.source] for r in rows)
    s = {r.source: r for r in shares.collect()}
    assert s["none"].used_docs == 0 and s["other"].target_share is None and s["small"].n_tokens >= 400_000
    again = mixing.mix(df, goals)[0].collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    d2, s2 = mixing.mix(df.filter("doc_id < 340"), goals)
    reached = {r.source: r.reached_share for r in s2.collect()}
    assert abs(reached["big"] - 0.6) < 0.03 and abs(reached["small"] - 0.4) < 0.03
    assert mixing.mix(df.limit(0), goals)[0].count() == 0 and mixing.mix(df, goals.limit(0))[0].count() == 0


def test_tokens_undo_spellings():
    assert abuse.tokens("You $tup1d fuc.king b i t c h!") == ["you", "stupid", "fucking", "bitch", "</s>"]
    assert abuse.tokens("shittt ra-zo-mi 237 𐙅 ＩＤＩＯＴ") == ["shit", "<syl>", "<num>", "<sign>", "idiot"]


def test_every_character_of_long_tokens_is_read():
    glued = "s o m e p e o p l e w o u l d s a y t h a t y o u a r e a w h o r e"
    whole = glued.replace(" ", "")
    got = abuse.tokens(glued)
    assert got[0] == whole[:16] and any("whore" in t for t in got)
    for n in range(1, 80):
        token = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = abuse.token_pieces(token)
        marked = {f"^{p}$"[i : i + 3] for p in pieces for i in range(len(p))}
        assert max(map(len, pieces)) <= abuse.LONG_TOKEN and {token[i : i + 3] for i in range(n - 2)} <= marked
        assert sum(len(gru.features(p)[1]) for p in pieces) == sum(map(len, pieces)) >= n
    assert gru.features("a" * 24 + "bcd") != gru.features("a" * 24 + "xyz")
    assert gru.features("abcdefghijklmnopqrstuvwxyzuvw")[1] != gru.features("abcdefghijklmnopqrstuvwxyzxyz")[1]


def test_windows_cover_all_tokens():
    for n in (0, 1, 24, 25, 36, 37, 100):
        covered = {i for a, b in gru.windows(n) for i in range(a, b)}
        assert covered == set(range(n)) and all(b - a <= gru.WINDOW for a, b in gru.windows(n))


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = gru.Network(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    feats = [gru.features(f"w{i}") for i in range(20)]
    idx = rng.integers(0, 20, (5, 6))
    idx[0, 4:] = -1
    y, w, vec = rng.integers(0, 2, 5).astype(float), np.ones(5), net.embed(feats).astype(np.float64)

    def loss():
        s = net.forward(net.project(vec), idx)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g, _, _ = net.gradients(vec, idx, y, w)
    for k in ("wx", "wo", "va"):
        i = tuple(rng.integers(0, n) for n in net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-4


def test_windows_cross_the_pieces_of_long_texts():
    class Seen(abuse.Scorer):
        starts: set = set()

        def scores(self, rows):
            self.new = []
            self.starts |= {place[self.names[r[0]]] for r in rows}
            return np.zeros(len(rows))

    letters = "bcdfghklmn"
    word = lambda i: "".join(letters[int(c)] + "a" for c in f"{i:06d}")
    text = " ".join(map(word, range(400_000)))
    assert len(text) > 2 * 2_000_000
    place = {word(i): i for i in range(400_000)}
    n, best = abuse.score_texts(Seen(gru.Network(0)), [None, text, "", text[:50]])
    starts = np.array(sorted(Seen.starts))
    assert n[0] == n[2] == 0 and n[3] == 1 and n[1] >= len(starts) and len(best) == 4
    # every run of half a window lies whole in a window
    assert np.diff(starts).max() <= gru.WINDOW // 2 and starts[0] == 0 and starts[-1] == 400_000 - gru.WINDOW


def test_pieces_keep_spelled_and_unbroken_text_together():
    spelled = "word " * 3 + "s t u p i d " * 2 + "word " * 3
    assert abuse.tokens(spelled) == [t for p in abuse._pieces(spelled, 40) for t in abuse.tokens(p)]
    glued = "".join(chr(0x4E00 + i) for i in range(100))
    assert all(any(glued[i : i + abuse.PIECE] in p for p in abuse._pieces(glued, 40)) for i in range(100 - abuse.PIECE))


def test_threshold_needs_no_number_of_labels_and_follows_the_rate():
    few = [("You are a stupid filthy pig.", 1.0), ("I will break your legs.", 1.0), *((f"The jar number {i} holds barley.", 0.0) for i in range(12))]
    model = abuse.train(few, rounds=1)
    assert len(model.held) == len(few) and sum(y for _, y in model.held) == 2
    some = abuse.Model(model.net, [(0.6, 1.0)] * 30 + [(0.95, 1.0)] * 30 + [(0.7, 0.0)] * 2 + [(0.05, 0.0)] * 60)
    assert some.threshold(0.5) < 0.6 and some.threshold(0.02) > 0.7
    assert abuse.Model(model.net, []).threshold(0.1) == 0.5


def test_equal_texts_share_a_fold():
    texts = [(f"t{i % 9}", float(i % 9 < 3)) for i in range(36)]
    part = abuse.folds(texts, np.random.default_rng(0))
    assert all(len({p for p, (u, _) in zip(part, texts, strict=True) if u == t}) == 1 for t, _ in texts) and set(part) == set(range(abuse.FOLDS))


def test_pairs_are_counted_over_all_texts(spark):
    n = 2 * abuse.MAX_PLAIN
    df = spark.range(n).select(F.concat(F.lit("Red jar. A "), F.when(F.col("id") % 2 == 0, "red").otherwise("blue"), F.lit(" jar, red jar")).alias("text")).union(spark.createDataFrame([(None,), ("",), ("jar red",)], "text string"))
    assert abuse.pair_counts(df, {("red", "jar"), ("blue", "jar"), ("jar", "blue")}) == ({("red", "jar"): n, ("blue", "jar"): n // 2}, n + 1)
    assert abuse.pair_counts(df, set()) == ({}, n + 1)


def test_scores_of_nulls_long_and_held_out_texts(spark):
    rng = random.Random(9)
    plain = ["The jar holds barley from the east magazine.", "Line 5 opens with ra-zo and the number 12.", "We compared two photographs of the seal.", "The edge is worn and two signs are lost."]
    bad = ["You are a stupid filthy pig.", "I will kill you and break your legs.", "Those migrants are vermin and must be thrown out.", "He wanted to fuck her all night."]
    make = lambda y: " ".join(rng.sample(plain, 3) + ([rng.choice(bad)] if y else []))
    model = abuse.train([(make(i % 3 == 0), float(i % 3 == 0)) for i in range(240)], rounds=1)
    test = [(i, make(i % 2), i % 2) for i in range(60)] + [(100, None, 0), (101, "", 0), (102, (" ".join(plain) + " ") * 3000 + bad[0], 1)]
    df = spark.createDataFrame(test, "doc_id long, text string, y int").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in abuse.scored(df, model, ["doc_id", "y"]).collect()}
    assert len(got) == 63 and got[100].score == got[101].score == 0 and got[100].n_windows == 0
    right = sum(r.found == bool(r.y) for r in got.values())
    assert right >= 59 and got[102].found
    assert abuse.scored(df.limit(0), model, ["doc_id"]).count() == 0


def test_models_are_saved_and_plain_texts_are_those_of_least_hash(spark, tmp_path, monkeypatch):
    model = abuse.Model(gru.Network(3), [(0.25, 1.0), (0.5, 0.0)])
    abuse.save_model(spark, model, str(tmp_path / "model"))
    again = abuse.load_model(spark, str(tmp_path / "model"))
    assert again.held == model.held and all((again.net.p[k] == v).all() for k, v in model.net.p.items())
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, abusive int")
    want = [r.text for r in docs.filter("doc_id between 20 and 499").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(30).collect()]
    assert abuse.plain_texts(docs, labels, 30) == want
    assert len(abuse.plain_texts(docs, labels, 3000)) == 480
