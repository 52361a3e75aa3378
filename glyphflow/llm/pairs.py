"""Items that appear together (problem 4).

Method: basket collapsing. Each record's items become one deduplicated sorted
array of codes; equal arrays collapse into one basket with a weight; pairs are
enumerated once per distinct basket and their weights summed per batch before
anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ranks import numbered
from ..scratch import spread, written
from ..tables import clean_code, table

#: Baskets beyond this many items are cut into tiles of BLOCK x BLOCK items, one row each.
BLOCK = 512
#: Up to this many items the codes travel by broadcast (the vocabulary is counted first).
BROADCAST_ITEMS = 100_000

_SCHEMA = "a int, b int, n long"
_ARROW = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def item_codes(items: DataFrame) -> DataFrame:
    """``item, code``: codes 0.. in order of the non-null items (the vocabulary, not the rows)."""
    words = items.filter("item is not null").select("item").distinct()
    return numbered(words, ["item"], "code").select("item", F.col("code").cast("int").alias("code"))


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``left array<int>, right array<int>, same boolean, weight long`` to pair sums."""
    keys, sums, held = [], [], 0

    def flush():
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(k), np.int64)
        np.add.at(n, at, np.concatenate(sums))
        return pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], schema=_ARROW)

    for batch in batches:
        left, right = batch.column(0), batch.column(1)
        lo, lf = left.offsets.to_numpy(), left.values.to_numpy().astype(np.int64)
        ro, rf = right.offsets.to_numpy(), right.values.to_numpy().astype(np.int64)
        same = batch.column(2).to_numpy(zero_copy_only=False)
        weight = batch.column(3).to_numpy()
        size = np.diff(lo)
        for k in np.unique(size[same]):
            rows = np.flatnonzero(same & (size == k))
            i, j = np.triu_indices(k)  # with the diagonal: how many baskets hold the item
            step = max(1, 2_000_000 // max(1, len(i)))
            for s in range(0, len(rows), step):
                r = rows[s : s + step]
                m = lf[lo[r][:, None] + np.arange(k)]
                keys.append(((m[:, i] << 32) | m[:, j]).ravel())
                sums.append(np.repeat(weight[r], len(i)))
                held += len(keys[-1])
                if held > 4_000_000:
                    out = flush()
                    keys, sums, held = [(out.column(0).to_numpy().astype(np.int64) << 32) | out.column(1).to_numpy()], [out.column(2).to_numpy()], out.num_rows
                    if held > 2_000_000:  # the sums no longer shrink: hand them on
                        yield out
                        keys, sums, held = [], [], 0
        for r in np.flatnonzero(~same):
            a, b = lf[lo[r] : lo[r + 1]], rf[ro[r] : ro[r + 1]]
            keys.append(((a[:, None] << 32) | b[None, :]).ravel())
            sums.append(np.full(len(a) * len(b), weight[r]))
            held += len(keys[-1])
            if held > 4_000_000:
                yield flush()
                keys, sums, held = [], [], 0
    if keys:
        yield flush()


def pair_counts(items: DataFrame) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, n, pmi, lift, conviction`` for all pairs item_a < item_b.

    ``items``: ``basket, item``. Null items and null baskets are left out, an item
    counts once per basket, further columns are ignored, an empty table gives no
    rows. ``n`` counts baskets with any item, ``lift`` is n_ab n / (n_a n_b),
    ``pmi`` its base-2 logarithm, ``conviction`` (of a => b) is
    (1 - n_b/n) / (1 - n_ab/n_a), null where b always comes with a.
    """
    rows = items.filter("basket is not null and item is not null").select("basket", "item")
    codes = item_codes(rows)
    coded = rows.join(F.broadcast(codes) if codes.count() <= BROADCAST_ITEMS else codes, "item")
    baskets = coded.groupBy("basket").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    weights = written(baskets.groupBy("codes").agg(F.count("*").alias("weight")), "baskets")
    block = lambda i: F.slice("codes", F.col(i) * BLOCK + 1, F.lit(BLOCK))
    last = F.ceil(F.size("codes") / F.lit(BLOCK)).cast("int") - 1
    tiles = (
        weights.withColumn("bi", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("bj", F.explode(F.sequence("bi", last)))
        .select(block("bi").alias("left"), block("bj").alias("right"), (F.col("bi") == F.col("bj")).alias("same"), "weight")
    )
    # a large basket's tiles are spread over tasks
    sums = written(spread(tiles).mapInArrow(_sum_pairs, _SCHEMA).groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    single = sums.filter("a = b").select(F.col("a").alias("code"), F.col("n").alias("n_item"))
    named = single.join(codes, "code").select("code", "item", "n_item")
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n"))
    side = lambda s: named.select(F.col("code").alias(s), F.col("item").alias(f"item_{s}"), F.col("n_item").alias(f"n_{s}"))
    pairs = sums.filter("a < b").withColumnRenamed("n", "n_ab").join(side("a"), "a").join(side("b"), "b").join(F.broadcast(total))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return pairs.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n",
        F.log2(lift).alias("pmi"), lift.alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b") / F.col("n")) / (1 - F.col("n_ab") / F.col("n_a"))).alias("conviction"),
    )


def sign_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = table(spark, sf_dir, "signs")
    return signs.select(F.col("inscription_id").alias("basket"), clean_code(F.col("bennett_id")).alias("item"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_counts(sign_baskets(spark, sf_dir))
    kept = pairs.filter("n_ab >= 5 and n_ab * n >= 12 * n_a * n_b")
    return kept.select(F.col("item_a").alias("sign_a"), F.col("item_b").alias("sign_b"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_counts(sign_baskets(spark, sf_dir))
    return pairs.select(F.col("item_a").alias("sign_a"), F.col("item_b").alias("sign_b"), "n_ab", "n_a", "n_b", *(F.round(c, 6).alias(c) for c in ("pmi", "lift", "conviction")))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}

_PAIRS = """
WITH it AS (
  SELECT DISTINCT inscription_id,
    regexp_replace(upper(regexp_replace(bennett_id, '^\\s+|\\s+$', '', 'g')), '^([A-Z]+)\\s*(.+)$', '\\1 \\2') AS s
  FROM signs WHERE bennett_id IS NOT NULL
), one AS (SELECT s, count(*) AS n FROM it GROUP BY s),
t AS (SELECT count(DISTINCT inscription_id) AS n FROM it),
pr AS (
  SELECT a.s AS sign_a, b.s AS sign_b, count(*) AS n_ab
  FROM it a JOIN it b ON a.inscription_id = b.inscription_id AND a.s < b.s GROUP BY a.s, b.s
), j AS (
  SELECT pr.*, oa.n AS n_a, ob.n AS n_b, t.n AS n
  FROM pr JOIN one oa ON oa.s = sign_a JOIN one ob ON ob.s = sign_b, t
)
"""

SQL = {
    "p4_found": _PAIRS + "SELECT sign_a, sign_b FROM j WHERE n_ab >= 5 AND n_ab * n >= 12 * n_a * n_b",
    "p4_pairs": _PAIRS
    + """SELECT sign_a, sign_b, n_ab, n_a, n_b, round(log2(n_ab * n / (n_a * n_b)), 6) AS pmi, round(n_ab * n / (n_a * n_b), 6) AS lift,
  CASE WHEN n_ab < n_a THEN round((1 - n_b / n) / (1 - n_ab / n_a), 6) END AS conviction FROM j""",
}
