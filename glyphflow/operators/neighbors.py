"""Nearest neighbours of vectors, class similarity, and inputs for sequence models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ranks import numbered
from ..sequences import CLEAN_SQL, TOKENS_SQL, all_tokens, r6
from ..skew import bounded
from ..tables import clean_code, table
from .describe import unit_draw

#: Queries of one broadcast block: 4096 vectors of 64 floats are 1 MB.
QUERY_BLOCK = 4096


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query, vec_id, similarity, rank``: the k rows most alike to each query, itself left out; ties by id.

    ``queries`` is a stated set. It is read block by block; a block is broadcast,
    every task takes its rows' best k per query by matrix product, and the k best
    of those remain. Rows never meet each other.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found, block = None, []

    def search(block):
        ids = np.array([q.vec_id for q in block], np.int64)
        m = np.array([q.embedding for q in block], np.float64)
        shared = spark.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_numpy()
                x = b.column(1).values.to_numpy().reshape(b.num_rows, -1)
                sim = np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, 6)
                sim[q_ids[:, None] == own[None]] = -2
                order = np.lexsort((np.broadcast_to(own, sim.shape), -sim), axis=1)[:, :k]
                at = np.repeat(np.arange(len(q_ids)), order.shape[1])
                col = order.ravel()
                keep = sim[at, col] > -2
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at][keep]), pa.array(own[col][keep]), pa.array(sim[at, col][keep])], names=["query", "vec_id", "similarity"])

        return rows.mapInArrow(run, "query long, vec_id long, similarity double")

    for row in queries.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            found = search(block) if found is None else found.unionByName(search(block))
            block = []
    if block or found is None:
        block = block or []
        if block:
            found = search(block) if found is None else found.unionByName(search(block))
    if found is None:
        return spark.createDataFrame([], "query long, vec_id long, similarity double, rank long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "vec_id")).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def one_nn_accuracy(top: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of queries whose nearest row has their label."""
    near = top.filter("rank = 1").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query").join(labels.select("vec_id", "label"), "vec_id")
    return near.agg(F.count("*").alias("n"), r6(F.avg((F.col("own") == F.col("label")).cast("double"))).alias("accuracy"))


def class_similarity(vectors: DataFrame) -> DataFrame:
    """Mean cosine within each label and to all others, from sums of unit vectors: no pairs are made.

    The sum of pairwise cosines of a class is |s|^2 - n for the sum s of its n unit
    vectors.
    """
    x = vectors.filter("embedding is not null and label is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v))
    unit = x.withColumn("norm", norm).filter("norm > 0").select("label", "vec_id", F.posexplode(F.transform("e", lambda v: v / F.col("norm"))).alias("i", "v"))
    per = unit.groupBy("label", "i").agg(F.sum("v").alias("s"))
    sizes = unit.filter("i = 0").groupBy("label").agg(F.count("*").alias("n"))
    every = per.groupBy("i").agg(F.sum("s").alias("a"))
    own = per.join(bounded(every), "i").groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("a")).alias("sa"))
    total = sizes.agg(F.sum("n").alias("t"))
    rows = own.join(sizes, "label").crossJoin(F.broadcast(total))
    return rows.select("label", "n", F.round(F.try_divide(F.col("ss") - F.col("n"), F.col("n") * (F.col("n") - 1)), 5).alias("intra"), F.round(F.try_divide(F.col("sa") - F.col("ss"), F.col("n") * (F.col("t") - F.col("n"))), 5).alias("inter"))


def vocabulary(tokens: DataFrame, first: int = 4) -> DataFrame:
    """Codes of symbols in order, after ``first`` reserved ones."""
    return numbered(tokens.select("symbol").distinct(), ["symbol"], "code", first)


def padded(tokens: DataFrame, codes: DataFrame, length: int = 32) -> DataFrame:
    """Sequences as arrays of ``length`` codes: longer ones cut into pieces, shorter ones padded with 0."""
    coded = tokens.join(bounded(codes), "symbol").withColumn("code", F.col("code").cast("int"))
    piece = coded.groupBy("seq_id", F.floor(F.col("pos") / length).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("s"))
    ids = F.transform("s", lambda x: x["code"])
    return piece.select("seq_id", "piece", F.concat(ids, F.array_repeat(F.lit(0), length - F.size(ids))).alias("codes"), F.size("s").alias("used"))


def masked(rows: DataFrame, share: float = 0.15, mask: int = 1, seed: int = 42) -> DataFrame:
    """Codes with a share, drawn by md5, replaced by ``mask``, and the targets there (-100 elsewhere)."""
    draw = lambda i: unit_draw(F.lit(str(seed)), "seq_id", "piece", i.cast("string")) < share
    hit = lambda x, i: (x > 0) & draw(i)
    return rows.select("seq_id", "piece", F.transform("codes", lambda x, i: F.when(hit(x, i), F.lit(mask)).otherwise(x)).alias("inputs"), F.transform("codes", lambda x, i: F.when(hit(x, i), x).otherwise(F.lit(-100))).alias("targets"))


def augmented(rows: DataFrame, swaps: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Each sequence as it is, reversed, cropped to at least half, and with a share of its codes swapped for like ones.

    ``swaps(code, like array<int>)`` names the codes that may stand for another; it
    has a row per symbol of the alphabet and travels as one map. Crops and swaps are
    drawn by md5; shorter sequences come first within a curriculum (``stage``).
    """
    used = F.slice("codes", 1, F.col("used"))
    draw = lambda *parts: unit_draw(F.lit(str(seed)), "seq_id", "piece", *parts)
    size = F.greatest(F.lit(1), F.col("used") - F.floor(draw() * (F.floor(F.col("used") / 2) + 1)).cast("int"))
    one_map = swaps.agg(F.map_from_entries(F.collect_list(F.struct("code", "like"))).alias("likes"))

    def swap(x, i):
        like = F.try_element_at("likes", x)
        pick = F.get(like, F.floor(draw(i.cast("string"), F.lit("pick")) * F.size(like)).cast("int"))
        return F.when(draw(i.cast("string")) < share, F.coalesce(pick, x)).otherwise(x)

    forms = {"same": used, "reversed": F.reverse(used), "crop": F.slice(used, F.lit(1), size), "swapped": F.transform(used, swap)}
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("codes")) for k, v in forms.items()))
    return rows.crossJoin(F.broadcast(one_map)).select("seq_id", "piece", F.explode(kinds).alias("k")).select("seq_id", "piece", "k.kind", "k.codes", F.ceil(F.log2(F.size("k.codes") + 1)).alias("stage"))  # one row


def like_codes(codes: DataFrame, values: DataFrame) -> DataFrame:
    """``code, like``: the codes of other symbols whose value begins with the same consonant (``values(symbol, value)``)."""
    from ..functions.text import onset

    c = codes.join(values.select("symbol", onset(F.col("value")).alias("c")).filter("c <> ''"), "symbol").select("code", "c")
    return c.join(c.withColumnRenamed("code", "other"), "c").filter("code <> other").groupBy("code").agg(F.array_sort(F.collect_list(F.col("other").cast("int"))).alias("like"))


def soft_targets(values: DataFrame, evidence: DataFrame) -> DataFrame:
    """``symbol, value, p``: evidence weights of a symbol's candidate values as probabilities; symbols without any get the even share.

    ``values(value)`` is the value inventory, ``evidence(symbol, value, weight)`` may
    repeat and name unknown values, which are left out, like weights of 0 or less.
    """
    known = evidence.join(bounded(values.select("value").distinct()), "value").filter("weight > 0").groupBy("symbol", "value").agg(F.sum("weight").alias("w"))
    total = known.groupBy("symbol").agg(F.sum("w").alias("t"))
    sure = known.join(total, "symbol").select("symbol", "value", r6(F.col("w") / F.col("t")).alias("p"))
    n = values.select("value").distinct().agg(F.count("*").alias("n"))
    bare = evidence.select("symbol").distinct().join(total, "symbol", "left_anti").crossJoin(F.broadcast(n))  # one row
    return sure.unionByName(bare.select("symbol", F.lit("*").alias("value"), r6(1 / F.col("n")).alias("p")))


def triplets(values: DataFrame) -> DataFrame:
    """Anchor, a symbol of the same consonant, and the first symbol of another consonant with the anchor's vowel."""
    from ..functions.text import onset, vowel

    v = values.select("symbol", onset(F.col("value")).alias("c"), vowel(F.col("value")).alias("v")).filter("v is not null")
    p = v.select(F.col("symbol").alias("positive"), "c")
    n = v.select(F.col("symbol").alias("negative"), F.col("c").alias("nc"), "v")
    pos = v.join(p, "c").filter("symbol <> positive")
    neg = v.select("symbol", "c", "v").join(n, "v").filter("c <> nc").groupBy("symbol").agg(F.min("negative").alias("negative"))
    return pos.join(neg, "symbol").select(F.col("symbol").alias("anchor"), "positive", "negative")


def _emb(s, d):
    return table(s, d, "embeddings")


def _queries(s, d):
    return _emb(s, d).filter("vec_id % 20 = 0")


def _sign_values(s, d):
    return table(s, d, "sign_list").filter("sign_type = 'syllabogram'").select(F.col("bennett_id").alias("symbol"), F.col("transliteration").alias("value"))


def _spelt(s, d):
    """How often each legible sign is spelt as which value, in hundredths of confidence."""
    rows = table(s, d, "signs").filter("bennett_id is not null and transliteration is not null")
    return rows.select(clean_code(F.col("bennett_id")).alias("symbol"), F.col("transliteration").alias("value"), F.greatest(F.round(100 * F.coalesce("confidence", F.lit(0.5))), F.lit(0)).cast("long").alias("weight"))


QUERIES = {
    "cosine_topk": lambda s, d: cosine_topk(_emb(s, d), _queries(s, d)),
    "one_nn_accuracy": lambda s, d: one_nn_accuracy(cosine_topk(_emb(s, d), _queries(s, d), 1), _emb(s, d)),
    "intra_inter_similarity": lambda s, d: class_similarity(_emb(s, d)),
    "padded_sequences": lambda s, d: (lambda t: padded(t, vocabulary(t)).select("seq_id", "piece", F.concat_ws(" ", "codes").alias("codes"), "used"))(all_tokens(s, d)),
    "masked_sequences": lambda s, d: (lambda t: masked(padded(t, vocabulary(t))).select("seq_id", "piece", F.concat_ws(" ", "inputs").alias("inputs"), F.concat_ws(" ", "targets").alias("targets")))(all_tokens(s, d)),
    "seeded_augmentation": lambda s, d: (lambda t, v: augmented(padded(t, v), like_codes(v, _sign_values(s, d))).select("seq_id", "piece", "kind", F.concat_ws(" ", "codes").alias("codes"), "stage"))(all_tokens(s, d), vocabulary(all_tokens(s, d))),
    "soft_targets": lambda s, d: soft_targets(_sign_values(s, d).select("value"), _spelt(s, d)),
    "triplets": lambda s, d: triplets(table(s, d, "sign_list").filter("sign_type = 'syllabogram'").select(F.col("bennett_id").alias("symbol"), F.col("transliteration").alias("value"))),
}

_TOP = """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id, round(list_cosine_similarity(q.e, x.embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings x WHERE query <> vec_id),
tp AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 5) """
_PADDED = ", vc AS (SELECT symbol, row_number() OVER (ORDER BY symbol) + 3 AS code FROM (SELECT DISTINCT symbol FROM tok)), pd AS (SELECT seq_id, pos // 32 AS piece, CAST(count(*) AS INT) AS used, list_concat(list(code ORDER BY pos), list_transform(range(32 - count(*)), lambda x: 0)) AS c FROM tok JOIN vc USING (symbol) GROUP BY ALL)"
SQL = {
    "cosine_topk": _TOP + "SELECT * FROM tp",
    "one_nn_accuracy": _TOP + "SELECT count(*) AS n, round(avg(CAST(a.label = b.label AS INT)), 6) AS accuracy FROM tp JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = tp.vec_id WHERE rank = 1",
    "intra_inter_similarity": """WITH p AS (SELECT x.label, y.label AS other, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id)
SELECT label, n, round(avg(c) FILTER (label = other), 5) AS intra, round(avg(c) FILTER (label <> other), 5) AS inter FROM p JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label) GROUP BY ALL""",
    "padded_sequences": TOKENS_SQL
    + """, vc AS (SELECT symbol, row_number() OVER (ORDER BY symbol) + 3 AS code FROM (SELECT DISTINCT symbol FROM tok)), g AS (SELECT seq_id, pos // 32 AS piece, list(code ORDER BY pos) AS c FROM tok JOIN vc USING (symbol) GROUP BY ALL)
SELECT seq_id, piece, array_to_string(list_concat(c, list_transform(range(32 - len(c)), lambda x: 0)), ' ') AS codes, CAST(len(c) AS INT) AS used FROM g""",
    "triplets": """WITH v AS (SELECT bennett_id AS symbol, regexp_extract(lower(transliteration), '^([^aeiou\\d]*)', 1) AS c, nullif(regexp_extract(lower(transliteration), '([aeiou])', 1), '') AS v FROM sign_list WHERE sign_type = 'syllabogram'),
u AS (SELECT * FROM v WHERE v IS NOT NULL), n AS (SELECT x.symbol, min(y.symbol) AS negative FROM u x JOIN u y ON x.v = y.v AND x.c <> y.c GROUP BY 1)
SELECT x.symbol AS anchor, y.symbol AS positive, negative FROM u x JOIN u y ON x.c = y.c AND x.symbol <> y.symbol JOIN n ON n.symbol = x.symbol""",
    "masked_sequences": TOKENS_SQL
    + _PADDED
    + """, m AS (SELECT seq_id, piece, i - 1 AS i, c[i] AS x, c[i] > 0 AND CAST('0x' || substr(md5('42|' || seq_id || '|' || piece || '|' || (i - 1)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < 0.15 AS hit FROM (SELECT *, unnest(range(1, 33)) AS i FROM pd))
SELECT seq_id, piece, string_agg(CASE WHEN hit THEN 1 ELSE x END, ' ' ORDER BY i) AS inputs, string_agg(CASE WHEN hit THEN x ELSE -100 END, ' ' ORDER BY i) AS targets FROM m GROUP BY ALL""",
    "seeded_augmentation": TOKENS_SQL
    + _PADDED
    + """, lk AS (SELECT vc.code, regexp_extract(lower(transliteration), '^([^aeiou\\d]*)', 1) AS o FROM vc JOIN sign_list ON bennett_id = symbol WHERE sign_type = 'syllabogram'),
li AS (SELECT a.code, list(b.code ORDER BY b.code) AS l FROM lk a JOIN lk b ON a.o = b.o AND a.o <> '' AND a.code <> b.code GROUP BY a.code),
cr AS (SELECT *, greatest(1, used - CAST(floor(CAST('0x' || substr(md5('42|' || seq_id || '|' || piece), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * (floor(used / 2) + 1)) AS INT)) AS size FROM pd),
x AS (SELECT *, CAST('0x' || substr(md5('42|' || seq_id || '|' || piece || '|' || (i - 1)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u, CAST('0x' || substr(md5('42|' || seq_id || '|' || piece || '|' || (i - 1) || '|pick'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS v FROM (SELECT seq_id, piece, used, c, unnest(range(1, used + 1)) AS i FROM pd)),
sw AS (SELECT seq_id, piece, 'swapped' AS kind, list(CASE WHEN u < 0.15 THEN coalesce(l[CAST(floor(v * len(l)) AS INT) + 1], c[i]) ELSE c[i] END ORDER BY i) AS k FROM x LEFT JOIN li ON li.code = c[i] GROUP BY ALL),
al AS (SELECT seq_id, piece, 'same' AS kind, c[1:used] AS k FROM cr UNION ALL SELECT seq_id, piece, 'reversed', list_reverse(c[1:used]) FROM cr UNION ALL SELECT seq_id, piece, 'crop', c[1:size] FROM cr UNION ALL SELECT * FROM sw)
SELECT seq_id, piece, kind, array_to_string(k, ' ') AS codes, CAST(ceil(log2(len(k) + 1)) AS BIGINT) AS stage FROM al""",
    "soft_targets": f"""WITH v AS (SELECT DISTINCT transliteration AS value FROM sign_list WHERE sign_type = 'syllabogram'),
e AS (SELECT {CLEAN_SQL} AS symbol, transliteration AS value, greatest(round(100 * coalesce(confidence, 0.5)), 0)::BIGINT AS weight FROM signs WHERE bennett_id IS NOT NULL AND transliteration IS NOT NULL),
k AS (SELECT symbol, value, sum(weight) AS w FROM e JOIN v USING (value) WHERE weight > 0 GROUP BY ALL)
SELECT symbol, value, round(w / sum(w) OVER (PARTITION BY symbol), 6) AS p FROM k UNION ALL SELECT symbol, '*', round(1 / (SELECT count(*) FROM v), 6) FROM (SELECT DISTINCT symbol FROM e) WHERE symbol NOT IN (SELECT symbol FROM k)""",
}
