"""Orphan tracking and tree aggregation: edge cases and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from glyphflow.operators import orphans, tree

T0 = dt.datetime(2020, 1, 1)
day = lambda n: T0 + dt.timedelta(days=n)
REF = "child string, id long, parent string, key long, at timestamp, period string"
PAR = "parent string, key long, first timestamp, last timestamp"
DEL = "parent string, key long, deleted timestamp"


def brute(refs, parents, deletions):
    out = {}
    for c, i, p, k, at, _ in refs:
        if i is None or k is None:
            continue
        mine = [x for x in parents if x[0] == p and x[1] == k]
        gone = [x[2] for x in deletions if x[0] == p and x[1] == k]
        if not mine:
            s = "missing"
        elif gone and not max(x[3] for x in mine) > max(gone):
            s = "deleted"
        elif min(x[2] for x in mine) > at:
            s = "late"
        else:
            continue
        out[(c, i)] = s
    return out


@pytest.mark.parametrize(("seed", "order", "fan_in"), [(1, (0, 10, 20), 16), (2, (0, 10, 20), 2), (3, (20, 0, 10), 2)])
def test_any_batches_give_the_brute_force_result(spark, monkeypatch, seed, order, fan_in):
    monkeypatch.setattr(orphans, "FAN_IN", fan_in)
    rng = random.Random(seed)
    refs = [("c", i, "p", rng.randrange(12) if rng.random() > 0.1 else None, day(rng.randrange(30)), None) for i in range(60)]
    parents = [("p", k, day(d), day(d)) for k in range(8) for d in [rng.randrange(30) for _ in range(rng.randrange(1, 4))]]
    deletions = [("p", rng.randrange(12), day(rng.randrange(30))) for _ in range(6)] + [("p", None, day(3))]
    tracker = orphans.OrphanTracker(spark)
    for lo in order:
        now = lambda xs, c: [x for x in xs if lo <= (x[c] - T0).days < lo + 10]  # noqa: B023, E731
        tracker.advance(lo, spark.createDataFrame(now(refs, 4), REF), spark.createDataFrame(now(parents, 3), PAR), spark.createDataFrame(now(deletions, 2), DEL))
    got = {(r.child, r.id): r.status for r in tracker.orphans().collect()}
    assert got == brute(refs, parents, deletions)
    assert tracker.history().select("batch").distinct().count() == 3


def test_empty_batch_repeats_and_clashing_columns(spark):
    refs = spark.createDataFrame([("c", 1, "p", 5, day(1), "x", 0, "y")] * 3, REF + ", first int, status string")
    tracker = orphans.OrphanTracker(spark)
    none_p, none_d = spark.createDataFrame([], PAR), spark.createDataFrame([], DEL)
    tracker.advance(0, spark.createDataFrame([], REF), none_p, none_d)
    assert tracker.orphans().count() == 0
    tracker.advance(1, refs, none_p, none_d)
    assert [(r.id, r.status) for r in tracker.orphans().collect()] == [(1, "missing")]
    tracker.advance(2, refs.limit(0), spark.createDataFrame([("p", 5, day(2), None)], PAR), none_d)
    assert [r.status for r in tracker.orphans().collect()] == ["late"]


def test_stream(spark, tmp_path):
    from glyphflow.streaming.orphans import EVENTS, follow

    e = [("ref", "c", 1, "p", 9, day(1), None, None, None, None), ("parent", None, None, "p", 9, None, None, day(0), day(0), None)]
    spark.createDataFrame(e, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("deletion", None, None, "p", 9, None, None, None, None, day(5))], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tracker = follow(spark, str(tmp_path / "in"), str(tmp_path / "cp"))
    assert [(r.id, r.status) for r in tracker.orphans().collect()] == [(1, "deleted")]


def test_stream_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    from glyphflow.streaming.orphans import EVENTS, follow

    monkeypatch.setattr(orphans, "FAN_IN", 2)
    put = lambda *rows: spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ref = lambda i, k, d: ("ref", "c", i, "p", k, day(d), None, None, None, None)
    parent = lambda k, d: ("parent", None, None, "p", k, None, None, day(d), day(d), None)
    run = lambda: sorted((r.id, r.status) for r in follow(spark, str(tmp_path / "in"), str(tmp_path / "cp")).orphans().collect())
    put(ref(1, 7, 1), ref(2, 8, 1), ref(4, 9, 1), parent(9, 0))
    assert run() == [(1, "missing"), (2, "missing")]
    put(ref(3, 7, 2), parent(8, 3))
    assert run() == [(1, "missing"), (2, "late"), (3, "missing")]
    put(("deletion", None, None, "p", 9, None, None, None, None, day(4)), ("deletion", None, None, "p", 8, None, None, None, None, day(4)))
    assert run() == [(1, "missing"), (2, "deleted"), (3, "missing"), (4, "deleted")]
    assert run() == [(1, "missing"), (2, "deleted"), (3, "missing"), (4, "deleted")]  # nothing new
    tracker = orphans.OrphanTracker(spark, str(tmp_path / "cp-state"))
    assert tracker.restore(1)  # the stream repeats its last batch
    assert sorted((r.id, r.status) for r in tracker.orphans().collect()) == [(1, "missing"), (2, "late"), (3, "missing")]
    put(parent(8, 5), parent(9, 5), parent(7, 5))
    assert run() == [(1, "late"), (2, "late"), (3, "late")]


def test_tree_equals_group_by_with_a_hot_key(spark, rows):
    data = [(i, "hot" if i % 3 else f"k{i % 50}", float(i % 7) if i % 5 else None) for i in range(2000)] + [(5, "hot", 5.0), (None, "a", 1.0), (2001, None, 1.0)]
    df = spark.createDataFrame(data, "id long, key string, v double").withColumn("chunk", F.lit("clash")).withColumn("n", F.lit(1))
    got = tree.tree_aggregate(df, "id", {"key": F.col("key")}, [tree.counted(), tree.summed("s", F.col("v").cast("long")), tree.least("lo", F.col("v")), tree.most("hi", F.col("v"))], chunk_rows=64, fan_in=3)
    want = df.filter("id is not null and key is not null").dropDuplicates(["id"]).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sorted(map(str, got.select("key_value", "n", "s", "lo", "hi").collect())) == sorted(str(r).replace("key=", "key_value=") for r in want.collect())
    assert tree.tree_aggregate(df.limit(0), "id", {"key": F.col("key")}, [tree.counted()]).count() == 0
