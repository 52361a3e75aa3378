"""Runs, pairs and shared spans: brute force, borders, nulls, repeats, empty tables, clashing columns."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphflow.llm import pairs, runs, spans
from glyphflow.ordered import sorted_runs

EV = "kind int, entity long, pos long, event string"


def brute_runs(rows):
    seen = {}
    for k, e, p, v in rows:
        if None not in (k, e, p):
            old = seen.get((k, e, p))
            seen[k, e, p] = v if old is None else old if v is None else min(v, old)
    out, last = [], None
    for (k, e, p), v in sorted(seen.items(), key=lambda x: x[0]):
        if last and last[:2] == [k, e] and v is not None and last[2] == v:
            last[4] = p
            last[5] += 1
        else:
            last = [k, e, v, p, p, 1]
            out.append(last)
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_equal_brute_force_over_many_partitions(spark, seed):
    rng = random.Random(seed)
    rows = [(0, 1 if rng.random() < 0.7 else rng.randrange(4), rng.randrange(400), rng.choice(["a", "a", "b", None])) for _ in range(300)]
    rows += [(1, 1, p, "z") for p in range(150)] + rows[:40] + [(None, 1, 1, "a"), (0, None, 1, "a"), (0, 1, None, "a")]
    df = spark.createDataFrame(rows, EV).withColumn("end", F.col("pos"))
    for parts in (1, 3, 9):
        got = sorted_runs(df, partitions=parts).collect()
        assert sorted(str([r.kind, r.entity, r.event, r.first_pos, r.last_pos, r.n]) for r in got) == brute_runs(rows)


def test_runs_least_empty_and_clashing_columns(spark, rows):
    df = spark.createDataFrame([(0, 1, 1, "x", 9, 9), (0, 1, 5, "x", 9, 9), (0, 1, 6, "y", 9, 9)], EV + ", edge int, n long")
    assert rows(runs.collapse_runs(df, 2)) == [(0, 1, "x", 1, 5, 2, 5)]
    assert runs.collapse_runs(df.limit(0)).count() == 0


def test_pairs_equal_brute_force_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 3)
    rng = random.Random(5)
    rows = [(b, rng.choice("abcdefghijk")) for b in range(30) for _ in range(8)] + [(99, c) for c in "abcdefghijk"] + [(7, None), (None, "a")]
    df = spark.createDataFrame(rows + rows[:50], "basket long, item string").withColumn("code", F.lit(1)).withColumn("n", F.lit(2))
    sets = {}
    for b, i in rows:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    want = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    one = Counter(i for s in sets.values() for i in s)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in pairs.pair_counts(df).collect()}
    assert got == {(a, b): (c, one[a], one[b], len(sets)) for (a, b), c in want.items()}
    assert pairs.pair_counts(df.limit(0)).count() == 0


def brute_stretches(rows, size):
    seqs = {}
    for e, p, v in rows:
        if e is not None and p is not None:
            seqs.setdefault(e, {})[p] = v
    where = {}
    for e, s in seqs.items():
        ps = sorted(s)
        for i in range(len(ps) - size + 1):
            w = tuple(s[p] for p in ps[i : i + size])
            if None not in w:
                where.setdefault(w, []).append((e, i))
    hit = {}
    for places in where.values():
        if len({e for e, _ in places}) > 1:
            for e, i in places:
                hit.setdefault(e, set()).add(i)
    out = []
    for e, starts in hit.items():
        ps = sorted(seqs[e])
        for i in sorted(starts):
            if out and out[-1][0] == e and i <= out[-1][2] + size:
                out[-1][2] = i
            else:
                out.append([e, i, i])
    return sorted((e, sorted(seqs[e])[a], sorted(seqs[e])[b + size - 1], b - a + size) for e, a, b in out)


@pytest.mark.parametrize("seed,parts,width,hot,most", [(1, 1, None, 20_000, None), (2, 5, 1 << 16, 3, None), (3, 4, None, 2, None), (1, 4, None, 20_000, 1), (2, 3, 64, 3, 1), (3, 1, 128, 20_000, 1)])
def test_spans_equal_brute_force(spark, rows, monkeypatch, seed, parts, width, hot, most):
    """With ``most``, the sketch stays a table of blocks; with few cells, these are full and call nearly all windows repeated."""
    monkeypatch.setattr(spans, "CHUNK", 16)
    if most:
        monkeypatch.setattr(spans, "WIDTHS", (1 << 10, most))
        monkeypatch.setattr(spans, "_BLOCK", 64)
    rng = random.Random(seed)
    base = [rng.choice("abcd") for _ in range(60)]
    data = []
    for e in range(12):
        s = [rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randrange(0, 40))]
        if e % 2:
            a = rng.randrange(40)
            s[3:3] = base[a : a + rng.randrange(2, 20)]
        data += [(e, 3 * i + 1, v) for i, v in enumerate(s)]
    data += [(100, i, "a") for i in range(50)] + [(101, i, "a") for i in range(30)] + data[:25] + [(None, 1, "a"), (3, None, "a")]
    df = spark.createDataFrame(data, "entity long, pos long, event string").withColumn("code", F.lit(5)).withColumn("n", F.lit(5))
    got = rows(spans.shared_stretches(df, size=5, width=width, hot=hot, partitions=parts))
    assert got == brute_stretches(data, 5)


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "a")], "entity long, pos long, event string")
    assert spans.shared_stretches(df, size=5).count() == 0
    assert spans.shared_stretches(df.limit(0)).count() == 0


def test_spans_of_more_events_than_two_bytes_hold(spark):
    """A span stands once among low codes and once in a chunk that holds codes over 65,535 too."""
    most = spark.range(70_000).select(F.lit(1).alias("entity"), F.col("id").alias("pos"), F.format_string("e%06d", "id").alias("event"))
    copy = spark.range(30).select(F.lit(2).alias("entity"), F.col("id").alias("pos"), F.format_string("e%06d", F.col("id") + 100).alias("event"))
    got = spans.shared_stretches(most.unionByName(copy), partitions=1).collect()
    assert sorted(tuple(r) for r in got) == [(1, 100, 129, 30), (2, 0, 29, 30)]
