"""Splitting sequences into words: four strategies, their vote, and scoring against known dividers.

A boundary at ``pos`` means that a word ends before the token at ``pos``. All
strategies see tokens without dividers; the truth marks tokens that a divider
stood before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ranks import numbered
from ..scratch import written
from ..sequences import TOKENS_SQL, dense, neighbours, r6, sign_tokens


def with_truth(tokens: DataFrame, divider) -> DataFrame:
    """Tokens without dividers in dense positions; ``bound`` where a divider came right before."""
    flagged = neighbours(dense(tokens).withColumn("divides", divider), 1, 0, ["divides"])
    kept = flagged.filter(~F.col("divides")).select("seq_id", F.col("pos").alias("raw_pos"), "symbol", F.coalesce("divides_m1", F.lit(False)).alias("bound"))
    return dense(kept).withColumn("bound", F.col("bound") & (F.col("pos") > 0))


def index_pick(values: DataFrame, column: str, share: float) -> DataFrame:
    """``threshold``: the value at index int(n * share) in ascending order (values of types, not of tokens)."""
    ranked = numbered(values.select(F.col(column).alias("v")), ["v"], "i")
    n = ranked.agg(F.count("*").alias("n"))
    ranked = ranked.crossJoin(F.broadcast(n))  # one row
    return ranked.filter(F.col("i") == F.least(F.floor(F.col("n") * share), F.col("n") - 1)).select(F.col("v").alias("threshold"))


def bigrams(tokens: DataFrame) -> DataFrame:
    """``a, b, n``: how often b follows a. Two strategies read it several times, so it is written."""
    step = neighbours(tokens, 0, 1, ["symbol"]).filter("symbol_p1 is not null")
    return written(step.groupBy(F.col("symbol").alias("a"), F.col("symbol_p1").alias("b")).agg(F.count("*").alias("n")), "bigrams")


def by_bigram(tokens: DataFrame, least: int = 5, share: float = 0.25, counts: DataFrame | None = None) -> DataFrame:
    """A boundary between neighbours of seldom transition: at or below the quartile of the frequent ones and under half of the second symbol's share."""
    step = neighbours(tokens, 0, 1, ["symbol"]).filter("symbol_p1 is not null").select("seq_id", "pos", F.col("symbol").alias("a"), F.col("symbol_p1").alias("b"))
    c = bigrams(tokens) if counts is None else counts
    out = c.groupBy("a").agg(F.sum("n").alias("na"))
    into = c.groupBy("b").agg(F.sum("n").alias("nb"))
    total = c.agg(F.sum("n").alias("t"))
    p = c.join(out, "a").join(into, "b").crossJoin(F.broadcast(total)).select("a", "b", "n", (F.col("n") / F.col("na")).alias("p"), (F.col("nb") / F.col("t")).alias("q"))
    low = index_pick(p.filter(F.col("n") >= least), "p", share)
    weak = p.crossJoin(F.broadcast(low)).filter((F.col("p") < F.col("threshold")) & (F.col("p") < 0.5 * F.col("q"))).select("a", "b")
    return step.join(weak, ["a", "b"]).select("seq_id", (F.col("pos") + 1).alias("pos"))


def by_position(tokens: DataFrame, ratio: float = 1 / 3, count: int = 2, total: int = 3) -> DataFrame:
    """A boundary between a symbol that tends to end sequences and one that tends to begin them."""
    step = neighbours(tokens, 1, 1, ["symbol"])
    n = step.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("symbol_m1").isNull()).alias("first"), F.count_if(F.col("symbol_p1").isNull()).alias("last"))
    mark = lambda k: n.filter((F.col(k) >= count) & (F.col("n") >= total) & (F.col(k) / F.col("n") >= ratio)).select("symbol")
    ends, starts = mark("last"), mark("first").withColumnRenamed("symbol", "symbol_p1")
    return step.filter("symbol_p1 is not null").join(ends, "symbol", "left_semi").join(starts, "symbol_p1", "left_semi").select("seq_id", (F.col("pos") + 1).alias("pos"))


def by_entropy(tokens: DataFrame, least: float = 0.5, counts: DataFrame | None = None) -> DataFrame:
    """A boundary where the choice to the right of one symbol and to the left of the next is both wide."""
    step = neighbours(tokens, 0, 1, ["symbol"]).filter("symbol_p1 is not null").select("seq_id", "pos", F.col("symbol").alias("a"), F.col("symbol_p1").alias("b"))
    c = bigrams(tokens) if counts is None else counts
    h = lambda k: c.groupBy(k).agg(r6(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias(f"h_{k}"))
    pairs = c.join(h("a"), "a").join(h("b"), "b").withColumn("h", F.least("h_a", "h_b"))
    mid = index_pick(pairs.select("h"), "h", 0.5)
    wide = pairs.crossJoin(F.broadcast(mid)).filter(F.col("h") >= F.greatest("threshold", F.lit(least))).select("a", "b")
    return step.join(wide, ["a", "b"]).select("seq_id", (F.col("pos") + 1).alias("pos"))


def by_viterbi(tokens: DataFrame, smooth: float = 0.01) -> DataFrame:
    """Two states, begin or go on, the best path per sequence from smoothed counts of begins and successions.

    What a step adds depends on the two symbols and the state it leads to, not on
    the state it comes from: both states of a token continue the same best path, so
    the path goes through the likelier state of each token. That is the whole
    sequence's Viterbi path for any length. A tie is a begin.
    """
    step = neighbours(tokens, 1, 0, ["symbol"])
    first = step.groupBy("symbol").agg(F.count_if(F.col("symbol_m1").isNull()).alias("f"), F.count("*").alias("n"))
    total = first.agg(F.sum("f").alias("heads"), F.count("*").alias("size"))
    inner = step.filter("symbol_m1 is not null").select("seq_id", "pos", F.col("symbol_m1").alias("a"), F.col("symbol").alias("b"))
    pairs = inner.groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    known = pairs.join(first.select(F.col("symbol").alias("a"), F.col("n").alias("n_a")), "a").join(first.select(F.col("symbol").alias("b"), F.col("f").alias("f_b")), "b").crossJoin(F.broadcast(total))
    go = (F.col("n_ab") + smooth) * (F.col("heads") + smooth * F.col("size"))
    begin = (F.col("f_b") + smooth) * (F.col("n_a") + smooth * F.col("size"))
    return inner.join(known.filter(go <= begin).select("a", "b"), ["a", "b"]).select("seq_id", "pos")


def vote(strategies: list[DataFrame]) -> DataFrame:
    """Boundaries that more than half of the strategies set, with the share that did."""
    k = len(strategies)
    return reduce(DataFrame.unionByName, [s.distinct() for s in strategies]).groupBy("seq_id", "pos").agg(F.count("*").alias("votes")).filter(F.col("votes") * 2 > k).withColumn("confidence", r6(F.col("votes") / k))


def score(tokens: DataFrame, predicted: DataFrame, include_truth: bool = False) -> DataFrame:
    """Precision, recall and F1 per sequence, then their means over sequences that have boundaries."""
    truth = tokens.filter("bound").select("seq_id", "pos")
    guess = predicted.select("seq_id", "pos").distinct()
    if include_truth:
        guess = guess.union(truth).distinct()
    both = truth.withColumn("t", F.lit(1)).join(guess.withColumn("g", F.lit(1)), ["seq_id", "pos"], "full")
    n = both.groupBy("seq_id").agg(F.count_if(F.col("t").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("t").alias("t"), F.count("g").alias("g")).filter("t > 0")
    p, r = F.coalesce(F.try_divide("tp", "g"), F.lit(0.0)), F.col("tp") / F.col("t")
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return n.agg(F.count("*").alias("texts"), *(F.round(F.avg(x), 5).alias(k) for k, x in (("precision", p), ("recall", r), ("f1", f))))


def words_of(tokens: DataFrame, bounds: DataFrame) -> DataFrame:
    """The words that boundaries cut: first and last position and spelling."""
    flagged = tokens.join(bounds.select("seq_id", "pos", F.lit(1).alias("b")).distinct(), ["seq_id", "pos"], "left")
    word = F.sum(F.coalesce("b", F.lit(0))).over(W.partitionBy("seq_id").orderBy("pos"))
    return flagged.withColumn("word", word).groupBy("seq_id", "word").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def _tok(s, d):
    return written(with_truth(sign_tokens(s, d).filter("kind in ('syllabogram', 'word divider')"), F.col("kind") == "word divider"), "tokens")


def _strategies(t):
    c = bigrams(t)
    return {"bigram": by_bigram(t, counts=c), "position": by_position(t, 0.1), "entropy": by_entropy(t, counts=c)}


def _vote(t):
    return vote(list(_strategies(t).values()))


def _scores(s, d):
    t = _tok(s, d)
    named = {k: written(b, k) for k, b in _strategies(t).items()}
    named["vote"] = vote(list(named.values()))
    return reduce(DataFrame.unionByName, [score(t, b).withColumn("strategy", F.lit(k)) for k, b in named.items()])


def _longest(s, d):
    t = _tok(s, d)
    w = words_of(t, t.filter("bound")).withColumn("length", F.col("last_pos") - F.col("first_pos") + 1)
    return w.orderBy(F.desc("length"), "seq_id", "first_pos").limit(40).select("seq_id", "first_pos", "length")


QUERIES = {
    "segment_truth": lambda s, d: _tok(s, d).filter("bound").select("seq_id", "pos"),
    "segment_words": lambda s, d: (lambda t: words_of(t, t.filter("bound")).drop("word"))(_tok(s, d)),
    "segment_bigram": lambda s, d: by_bigram(_tok(s, d)),
    "segment_positional": lambda s, d: by_position(_tok(s, d), 0.1),
    "segment_entropy": lambda s, d: by_entropy(_tok(s, d)),
    "segment_consensus": lambda s, d: _vote(_tok(s, d)),
    "segmentation_f1": _scores,
    "segment_viterbi": lambda s, d: by_viterbi(_tok(s, d)),
    "longest_words": _longest,
}

_T = (
    TOKENS_SQL
    + """, sd AS (SELECT seq_id, symbol, raw_pos, kind = 'word divider' AS dv FROM tok WHERE kind IN ('syllabogram', 'word divider')), s1 AS (SELECT *, coalesce(lag(dv) OVER (PARTITION BY seq_id ORDER BY raw_pos), false) AS pb FROM sd),
sg AS (SELECT seq_id, symbol, pb, row_number() OVER (PARTITION BY seq_id ORDER BY raw_pos) - 1 AS pos FROM s1 WHERE NOT dv),
tr AS (SELECT seq_id, pos FROM sg WHERE pb AND pos > 0), stp AS (SELECT seq_id, pos, symbol AS a, lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM sg), cc AS (SELECT a, b, count(*) AS n FROM stp WHERE b IS NOT NULL GROUP BY ALL),
pq AS (SELECT a, b, n, n / sum(n) OVER (PARTITION BY a) AS p, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS q FROM cc),
lo AS (SELECT p AS th FROM (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS k FROM pq WHERE n >= 5) WHERE i = least(floor(k * 0.25), k - 1)),
bg AS (SELECT seq_id, pos + 1 AS pos FROM stp JOIN pq USING (a, b), lo WHERE p < th AND p < 0.5 * q),
fl AS (SELECT symbol, count(*) AS n, count(*) FILTER (m IS NULL) AS f, count(*) FILTER (x IS NULL) AS l FROM (SELECT symbol, lag(pos) OVER w AS m, lead(pos) OVER w AS x FROM sg WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) GROUP BY symbol),
ps AS (SELECT seq_id, pos + 1 AS pos FROM stp WHERE a IN (SELECT symbol FROM fl WHERE l >= 2 AND n >= 3 AND l / n >= 0.1) AND b IN (SELECT symbol FROM fl WHERE f >= 2 AND n >= 3 AND f / n >= 0.1)),
ha AS (SELECT a, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS ha FROM cc GROUP BY a), hb AS (SELECT b, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS hb FROM cc GROUP BY b),
hp AS (SELECT a, b, least(ha, hb) AS h FROM cc JOIN ha USING (a) JOIN hb USING (b)), md AS (SELECT h AS th FROM (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i, count(*) OVER () AS k FROM hp) WHERE i = least(floor(k * 0.5), k - 1)),
en AS (SELECT seq_id, pos + 1 AS pos FROM stp JOIN hp USING (a, b), md WHERE h >= greatest(th, 0.5)),
vt AS (SELECT seq_id, pos, count(*) AS votes FROM (SELECT DISTINCT * FROM bg UNION ALL SELECT DISTINCT * FROM ps UNION ALL SELECT DISTINCT * FROM en) GROUP BY ALL HAVING count(*) * 2 > 3)
"""
)


def _f1(k: str, src: str) -> str:
    return f"""SELECT '{k}' AS strategy, count(*) AS texts, round(avg(p), 5) AS precision, round(avg(r), 5) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 5) AS f1 FROM (
SELECT seq_id, count(*) FILTER (t = 1 AND g = 1) AS tp, CASE WHEN count(g) > 0 THEN count(*) FILTER (t = 1 AND g = 1) / count(g) ELSE 0 END AS p, count(*) FILTER (t = 1 AND g = 1) / count(t) AS r
FROM (SELECT *, 1 AS t FROM tr) x FULL JOIN (SELECT DISTINCT seq_id, pos, 1 AS g FROM {src}) y USING (seq_id, pos) GROUP BY seq_id HAVING count(t) > 0)"""


_WRD = ", wr AS (SELECT seq_id, pos, sum(CASE WHEN pb AND pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos) AS word FROM sg), wo AS (SELECT seq_id, min(pos) AS first_pos, max(pos) AS last_pos FROM wr GROUP BY seq_id, word)"
SQL = {
    "segment_truth": _T + "SELECT seq_id, pos FROM tr",
    "segment_words": _T + _WRD + "SELECT * FROM wo",
    "segment_bigram": _T + "SELECT * FROM bg",
    "segment_positional": _T + "SELECT * FROM ps",
    "segment_entropy": _T + "SELECT * FROM en",
    "segment_consensus": _T + "SELECT seq_id, pos, votes, round(votes / 3, 6) AS confidence FROM vt",
    "segmentation_f1": _T + " UNION ALL ".join(_f1(*x) for x in (("bigram", "bg"), ("position", "ps"), ("entropy", "en"), ("vote", "vt"))),
    "longest_words": _T + _WRD + "SELECT seq_id, first_pos, last_pos - first_pos + 1 AS length FROM wo ORDER BY length DESC, seq_id, first_pos LIMIT 40",
    "segment_viterbi": _T
    + "SELECT seq_id, pos + 1 AS pos FROM stp JOIN cc USING (a, b) JOIN fl x ON x.symbol = a JOIN fl y ON y.symbol = b, (SELECT sum(f) AS heads, count(*) AS size FROM fl) WHERE (cc.n + 0.01::DOUBLE) * (heads + 0.01::DOUBLE * size) <= (y.f + 0.01::DOUBLE) * (x.n + 0.01::DOUBLE * size)",
}
