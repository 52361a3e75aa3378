"""N-gram counts, entropies, association of neighbours and lexical statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import entropy_of
from ..ranks import numbered
from ..sequences import TOKENS_SQL, all_tokens, grams, neighbours, r6, syllables
from ..skew import bounded


def _joined():
    return F.concat_ws(" ", "gram").alias("gram")


def ngram_counts(tokens: DataFrame, most: int) -> DataFrame:
    """``n, gram, count, probability`` for n = 1..most; probability is the share among grams of that n."""
    sets = [grams(tokens, n).select(F.lit(n).alias("n"), _joined()) for n in range(1, most + 1)]
    counts = reduce(DataFrame.unionByName, sets).groupBy("n", "gram").agg(F.count("*").alias("count"))
    totals = counts.groupBy("n").agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(totals), "n").select("n", "gram", "count", r6(F.col("count") / F.col("total")).alias("probability"))


def conditional_entropy(tokens: DataFrame, most: int = 3) -> DataFrame:
    """``k, total_events, unique_contexts, entropy, perplexity`` of the next token given the k before it."""
    out = []
    for k in range(1, most + 1):
        pairs = grams(tokens, k + 1).groupBy(F.slice("gram", 1, k).alias("context"), F.element_at("gram", -1).alias("next")).agg(F.count("*").alias("n"))
        # sum over contexts of n log n minus counts: one row per context, then one row
        context = pairs.groupBy("context").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.log2("n")).alias("s"))
        bits = (F.sum(F.col("c") * F.log2("c")) - F.sum("s")) / F.sum("c")
        out.append(context.agg(F.lit(k).alias("k"), F.sum("c").alias("total_events"), F.count("*").alias("unique_contexts"), bits.alias("h")))
    rows = reduce(DataFrame.unionByName, out).filter("total_events > 0")
    return rows.select("k", "total_events", "unique_contexts", r6("h").alias("entropy"), r6(F.pow(F.lit(2.0), "h")).alias("perplexity"))


def marginal_entropy(tokens: DataFrame) -> DataFrame:
    """Entropy of a token alone, of a token given the one before, and the reduction."""
    one = tokens.groupBy("symbol").agg(F.count("*").alias("n"))
    total = one.agg(F.sum("n").alias("t"))
    h = one.crossJoin(F.broadcast(total)).agg(entropy_of(F.col("n") / F.col("t")).alias("marginal"))  # one row
    c = conditional_entropy(tokens, 1).select(F.col("entropy").alias("conditional"))
    both = h.crossJoin(c)  # one row each
    return both.select(r6("marginal").alias("marginal"), "conditional", F.round(F.try_divide(F.col("marginal") - F.col("conditional"), F.col("marginal")), 5).alias("reduction"))


def joint_entropy(tokens: DataFrame, n: int, relabel: DataFrame | None = None) -> DataFrame:
    """Entropy of n-grams, symbols first relabelled by ``relabel(symbol, label)`` where it knows them."""
    if relabel is not None:
        tokens = tokens.join(relabel, "symbol", "left").withColumn("symbol", F.coalesce("label", "symbol")).drop("label")
    counts = grams(tokens, n).groupBy("gram").agg(F.count("*").alias("c"))
    return counts.agg(F.sum("c").alias("n_grams"), r6(F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def bigram_pmi(tokens: DataFrame, least: int = 3) -> DataFrame:
    """Association of neighbours seen at least ``least`` times: pmi, its weighted part, expected count, log ratio."""
    one = tokens.groupBy("symbol").agg(F.count("*").alias("n"))
    n1 = one.agg(F.sum("n").alias("n1"))
    two = neighbours(tokens, 0, 1, ["symbol"]).filter("symbol_p1 is not null").groupBy("symbol", "symbol_p1").agg(F.count("*").alias("count"))
    n2 = two.agg(F.sum("count").alias("n2"))
    rows = (
        two.filter(F.col("count") >= least)
        .select(F.col("symbol").alias("sign_a"), F.col("symbol_p1").alias("sign_b"), "count")
        .join(one.select(F.col("symbol").alias("sign_a"), F.col("n").alias("n_a")), "sign_a")
        .join(one.select(F.col("symbol").alias("sign_b"), F.col("n").alias("n_b")), "sign_b")
        .crossJoin(F.broadcast(n1))
        .crossJoin(F.broadcast(n2))
    )
    pmi = F.log2((F.col("count") / F.col("n2")) / ((F.col("n_a") / F.col("n1")) * (F.col("n_b") / F.col("n1"))))
    expected = F.col("n_a") * F.col("n_b") / F.col("n1") / F.col("n1") * F.col("n2")
    return rows.select("sign_a", "sign_b", "count", r6(pmi).alias("pmi"), r6(F.col("count") / F.col("n2") * pmi).alias("mi_contribution"), F.round(expected, 4).alias("expected_count"), r6(F.log2(F.col("count") / expected)).alias("log_ratio"))


def smoothed(tokens: DataFrame, k: float = 1.0) -> DataFrame:
    """Add-k probabilities of symbols."""
    one = tokens.groupBy("symbol").agg(F.count("*").alias("n"))
    total = one.agg(F.sum("n").alias("t"), F.count("*").alias("v"))
    return one.crossJoin(F.broadcast(total)).select("symbol", "n", r6((F.col("n") + k) / (F.col("t") + k * F.col("v"))).alias("probability"))


def lexical_stats(tokens: DataFrame) -> DataFrame:
    """Size, richness and concentration of a corpus in one row."""
    one = tokens.groupBy("symbol").agg(F.count("*").alias("n"))
    n = F.col("n")
    top5 = one.orderBy(F.desc("n"), "symbol").limit(5).agg(F.sum("n").alias("top5"))
    stats = one.agg(
        F.sum("n").alias("tokens"), F.count("*").alias("types"), F.sum(n * (n - 1)).alias("nn"), F.sum(n * F.log2("n")).alias("s"),
        F.count_if(n == 1).alias("hapax"), F.count_if(n == 2).alias("dis"), F.max("n").alias("top1"),
        F.max("n").alias("fmax"), F.min("n").alias("flast"),
    )
    size = tokens.groupBy("seq_id").agg(F.count("*").alias("len")).agg(F.avg("len").alias("mean_len"), F.min("len").alias("min_len"), F.max("len").alias("max_len"))
    t = F.col("tokens")
    h = F.log2(t.cast("double")) - F.col("s") / t
    return stats.crossJoin(size).crossJoin(top5).filter("tokens > 0").select(
        "tokens", "types", r6(F.col("types") / t).alias("ttr"), r6(F.try_divide(F.col("nn"), t * (t - 1))).alias("repeat_rate"), r6(h).alias("entropy"),
        r6(F.try_divide(h, F.log2(F.col("types").cast("double")))).alias("normalised_entropy"), "hapax", "dis", r6("mean_len").alias("mean_len"), "min_len", "max_len",
        r6(F.col("top1") / t).alias("top1_share"), r6(F.col("top5") / t).alias("top5_share"),
        r6(F.try_divide(F.ln(F.col("fmax") / F.col("flast")), F.ln(F.col("types").cast("double")))).alias("endpoint_slope"),
    )


def zipf_fit(tokens: DataFrame) -> DataFrame:
    """Least squares of ln frequency on ln rank."""
    one = tokens.groupBy("symbol").agg(F.count("*").alias("n"))
    xy = numbered(one, [F.desc("n"), F.col("symbol")], start=1).select(F.ln(F.col("rank").cast("double")).alias("x"), F.ln("n").alias("y"))
    return xy.agg(F.round(F.regr_slope("y", "x"), 5).alias("slope"), F.round(F.regr_r2("y", "x"), 5).alias("r2"), F.count("*").alias("types"))


def transitions(tokens: DataFrame, column: str) -> DataFrame:
    """Counts and conditional probability of class to class steps."""
    rows = neighbours(tokens, 0, 1, [column]).filter(F.col(column).isNotNull() & F.col(f"{column}_p1").isNotNull())
    pairs = rows.groupBy(F.col(column).alias("a"), F.col(f"{column}_p1").alias("b")).agg(F.count("*").alias("count"))
    sums = pairs.groupBy("a").agg(F.sum("count").alias("t"))
    return pairs.join(sums, "a").select("a", "b", "count", r6(F.col("count") / F.col("t")).alias("probability"))


def recurring_grams(tokens: DataFrame, n: int, least: int = 2) -> DataFrame:
    """Grams that occur in at least ``least`` sequences, with their counts and first place."""
    rows = grams(tokens, n).select("seq_id", "pos", _joined())
    per = rows.groupBy("gram", "seq_id").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    return per.groupBy("gram").agg(F.sum("c").alias("occurrences"), F.count("*").alias("sequences"), F.min("p").alias("least_pos")).filter(F.col("sequences") >= least)


def part_presence(tokens: DataFrame, parts: DataFrame, least: int = 2) -> DataFrame:
    """``parts(part, gram array<string>)`` of one length each; sequences with at least ``least`` different parts."""
    sizes = [r[0] for r in parts.select(F.size("gram")).distinct().collect()]  # lengths of a pattern list
    hits = [grams(tokens, n).join(bounded(parts.filter(F.size("gram") == n)), "gram").select("seq_id", "part").distinct() for n in sizes]
    return reduce(DataFrame.unionByName, hits).groupBy("seq_id").agg(F.count_distinct("part").alias("n_parts")).filter(F.col("n_parts") >= least)


def bigram_disruption(tokens: DataFrame, group_of: DataFrame, least: int = 5) -> DataFrame:
    """How unlike the followers of a symbol are to those of its class.

    ``group_of(symbol, cls)``. Score = 0.4 |h - class mean| / class mean + 0.3 share
    of followers that the rest of the class never has + 0.3 best cosine with another
    class's followers; symbols with fewer than ``least`` followers are left out.
    """
    step = neighbours(tokens, 0, 1, ["symbol"]).filter("symbol_p1 is not null")
    f = step.groupBy("symbol", F.col("symbol_p1").alias("next")).agg(F.count("*").alias("n")).join(group_of, "symbol")
    tot = f.groupBy("symbol", "cls").agg(F.sum("n").alias("t"), (F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h")).filter(F.col("t") >= least)
    mean = tot.groupBy("cls").agg(F.avg("h").alias("mean_h"))
    by_class = f.groupBy("cls", "next").agg(F.sum("n").alias("cn"))
    rare = f.join(by_class, ["cls", "next"]).groupBy("symbol").agg((F.sum(F.when(F.col("cn") == F.col("n"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rare"))
    norm_s = f.groupBy("symbol").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("ns"))
    norm_c = by_class.groupBy("cls").agg(F.sqrt(F.sum(F.col("cn") * F.col("cn"))).alias("nc"))
    other = by_class.join(norm_c, "cls").select(F.col("cls").alias("oc"), "next", "cn", "nc")
    # classes are few: a symbol's follower meets one row per class that has it
    dots = f.join(other, "next").filter("oc <> cls").groupBy("symbol", "oc", "nc").agg(F.sum(F.col("n") * F.col("cn")).alias("dot")).join(norm_s, "symbol")
    best = dots.groupBy("symbol").agg(F.max(F.col("dot") / (F.col("ns") * F.col("nc"))).alias("best"))
    rows = tot.join(mean, "cls").join(rare, "symbol").join(best, "symbol", "left")
    divergence = F.coalesce(F.try_divide(F.abs(F.col("h") - F.col("mean_h")), F.col("mean_h")), F.lit(0.0))
    score = 0.4 * divergence + 0.3 * F.col("rare") + 0.3 * F.coalesce("best", F.lit(0.0))
    return rows.select("symbol", "cls", F.col("t").alias("followers"), F.round(score, 5).alias("score"))


def _kind_of(spark, d):
    from ..tables import table

    return table(spark, d, "sign_list").select(F.col("bennett_id").alias("symbol"), F.substring("transliteration", 1, 1).alias("cls")).filter("cls is not null")


QUERIES = {
    "ngram_counts": lambda s, d: ngram_counts(syllables(s, d), 5),
    "conditional_entropy_k123": lambda s, d: conditional_entropy(syllables(s, d)),
    "marginal_vs_conditional_entropy": lambda s, d: marginal_entropy(syllables(s, d)),
    "joint_entropy_relabelled": lambda s, d: joint_entropy(all_tokens(s, d), 2, _kind_of(s, d).withColumnRenamed("cls", "label")),
    "trigram_joint_entropy": lambda s, d: joint_entropy(all_tokens(s, d), 3),
    "bigram_pmi": lambda s, d: bigram_pmi(syllables(s, d)),
    "add_k_smoothing": lambda s, d: smoothed(all_tokens(s, d)),
    "lexical_stats": lambda s, d: lexical_stats(syllables(s, d)),
    "zipf_ols": lambda s, d: zipf_fit(syllables(s, d)),
    "kind_transitions": lambda s, d: transitions(all_tokens(s, d), "kind"),
    "recurring_grams": lambda s, d: recurring_grams(syllables(s, d), 3),
    "part_presence": lambda s, d: part_presence(all_tokens(s, d), s.createDataFrame([("a", ["AB 73"]), ("b", ["AB 14", "AB 70"]), ("c", ["AB 15", "AB 42"]), ("d", ["DIV 1"])], "part string, gram array<string>")),
    "bigram_disruption": lambda s, d: bigram_disruption(syllables(s, d), _kind_of(s, d)),
}

_COND = """, {p}p AS (SELECT ctx, nxt, count(*) AS n FROM ({q}) GROUP BY ctx, nxt),
{p}c AS (SELECT ctx, sum(n) AS c, sum(n * log2(n)) AS s FROM {p}p GROUP BY ctx)"""


def _cond_sql(k: int) -> str:
    ctx = " || ' ' || ".join(f"lag(symbol, {i}) OVER w" for i in range(k, 0, -1))
    q = f"SELECT {ctx} AS ctx, symbol AS nxt FROM syl WINDOW w AS (PARTITION BY seq_id ORDER BY pos) QUALIFY ctx IS NOT NULL"
    return _COND.format(p=f"k{k}", q=q)


def _cond_row(k: int) -> str:
    h = "(sum(c * log2(c)) - sum(s)) / sum(c)"
    return f"SELECT {k} AS k, CAST(sum(c) AS BIGINT) AS total_events, count(*) AS unique_contexts, round({h}, 6) AS entropy, round(pow(2, {h}), 6) AS perplexity FROM k{k}c HAVING sum(c) > 0"


def _gram_sql(n: int, src: str = "syl", col: str = "symbol") -> str:
    parts = " || ' ' || ".join([col, *(f"lead({col}, {i}) OVER w" for i in range(1, n))])
    return f"SELECT * FROM (SELECT {n} AS n, seq_id, pos, {parts} AS gram FROM {src} WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE gram IS NOT NULL"


_H1 = "log2(sum(c)) - sum(c * log2(c)) / sum(c)"
SQL = {
    "ngram_counts": TOKENS_SQL
    + f", g AS ({' UNION ALL '.join(_gram_sql(n) for n in range(1, 6))}), c AS (SELECT n, gram, count(*) AS count FROM g GROUP BY n, gram) SELECT n, gram, count, round(count / sum(count) OVER (PARTITION BY n), 6) AS probability FROM c",
    "conditional_entropy_k123": TOKENS_SQL + "".join(map(_cond_sql, (1, 2, 3))) + " UNION ALL ".join(map(_cond_row, (1, 2, 3))),
    "marginal_vs_conditional_entropy": TOKENS_SQL
    + _cond_sql(1)
    + f", o AS (SELECT symbol, count(*) AS c FROM syl GROUP BY symbol), m AS (SELECT {_H1} AS marginal FROM o), k AS ({_cond_row(1)}) SELECT round(marginal, 6) AS marginal, entropy AS conditional, round((marginal - entropy) / marginal, 5) AS reduction FROM m, k",
    "joint_entropy_relabelled": TOKENS_SQL
    + f", lab AS (SELECT seq_id, pos, coalesce(substr(translit, 1, 1), symbol) AS symbol FROM tok), g AS ({_gram_sql(2, 'lab')}), c AS (SELECT gram, count(*) AS c FROM g GROUP BY gram) SELECT CAST(sum(c) AS BIGINT) AS n_grams, round({_H1}, 6) AS entropy FROM c",
    "trigram_joint_entropy": TOKENS_SQL + f", g AS ({_gram_sql(3, 'tok')}), c AS (SELECT gram, count(*) AS c FROM g GROUP BY gram) SELECT CAST(sum(c) AS BIGINT) AS n_grams, round({_H1}, 6) AS entropy FROM c",
    "bigram_pmi": TOKENS_SQL
    + """, o AS (SELECT symbol, count(*) AS n FROM syl GROUP BY symbol), n1 AS (SELECT sum(n) AS n1 FROM o),
b AS (SELECT symbol AS a, lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM syl), t AS (SELECT a, b, count(*) AS c FROM b WHERE b IS NOT NULL GROUP BY a, b), n2 AS (SELECT sum(c) AS n2 FROM t)
SELECT a AS sign_a, b AS sign_b, c AS count, round(log2((c / n2) / ((x.n / n1) * (y.n / n1))), 6) AS pmi,
  round(c / n2 * log2((c / n2) / ((x.n / n1) * (y.n / n1))), 6) AS mi_contribution, round(x.n * y.n / n1 / n1 * n2, 4) AS expected_count,
  round(log2(c / (x.n * y.n / n1 / n1 * n2)), 6) AS log_ratio
FROM t JOIN o x ON x.symbol = a JOIN o y ON y.symbol = b, n1, n2 WHERE c >= 3""",
    "add_k_smoothing": TOKENS_SQL + ", o AS (SELECT symbol, count(*) AS n FROM tok GROUP BY symbol) SELECT symbol, n, round((n + 1) / (sum(n) OVER () + count(*) OVER ()), 6) AS probability FROM o",
    "lexical_stats": TOKENS_SQL
    + """, o AS (SELECT symbol, count(*) AS n FROM syl GROUP BY symbol), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, symbol) AS r FROM o),
s AS (SELECT sum(n) AS t, count(*) AS v, sum(n * (n - 1)) AS nn, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) FILTER (n = 1) AS hapax, count(*) FILTER (n = 2) AS dis,
  max(n) FILTER (r = 1) AS top1, sum(n) FILTER (r <= 5) AS top5, max(n) AS fmax, min(n) AS flast FROM r),
l AS (SELECT avg(len) AS mean_len, min(len) AS min_len, max(len) AS max_len FROM (SELECT count(*) AS len FROM syl GROUP BY seq_id))
SELECT CAST(t AS BIGINT) AS tokens, v AS types, round(v / t, 6) AS ttr, round(nn / (t * (t - 1)), 6) AS repeat_rate, round(h, 6) AS entropy, round(h / log2(v), 6) AS normalised_entropy, hapax, dis,
  round(mean_len, 6) AS mean_len, min_len, max_len, round(top1 / t, 6) AS top1_share, round(top5 / t, 6) AS top5_share, round(ln(fmax / flast) / ln(v), 6) AS endpoint_slope FROM s, l""",
    "zipf_ols": TOKENS_SQL
    + ", o AS (SELECT symbol, count(*) AS n FROM syl GROUP BY symbol), r AS (SELECT ln(row_number() OVER (ORDER BY n DESC, symbol)) AS x, ln(n) AS y FROM o) SELECT round(regr_slope(y, x), 5) AS slope, round(regr_r2(y, x), 5) AS r2, count(*) AS types FROM r",
    "kind_transitions": TOKENS_SQL
    + ", p AS (SELECT kind AS a, lead(kind) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM tok), c AS (SELECT a, b, count(*) AS count FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b) SELECT a, b, count, round(count / sum(count) OVER (PARTITION BY a), 6) AS probability FROM c",
    "recurring_grams": TOKENS_SQL + f", g AS ({_gram_sql(3)}) SELECT gram, count(*) AS occurrences, count(DISTINCT seq_id) AS sequences, min(pos) AS least_pos FROM g GROUP BY gram HAVING count(DISTINCT seq_id) >= 2",
    "part_presence": TOKENS_SQL
    + f""", g AS ({_gram_sql(1, 'tok')} UNION ALL {_gram_sql(2, 'tok')}), p(part, gram) AS (VALUES ('a', 'AB 73'), ('b', 'AB 14 AB 70'), ('c', 'AB 15 AB 42'), ('d', 'DIV 1'))
SELECT seq_id, count(DISTINCT part) AS n_parts FROM g JOIN p USING (gram) GROUP BY seq_id HAVING count(DISTINCT part) >= 2""",
    "bigram_disruption": TOKENS_SQL
    + """, st AS (SELECT symbol, lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS nxt FROM syl),
f AS (SELECT st.symbol, nxt, cls, count(*) AS n FROM st JOIN (SELECT bennett_id AS symbol, substr(transliteration, 1, 1) AS cls FROM sign_list WHERE transliteration IS NOT NULL) USING (symbol) WHERE nxt IS NOT NULL GROUP BY ALL),
tot AS (SELECT symbol, cls, sum(n) AS t, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM f GROUP BY ALL HAVING sum(n) >= 5),
mean AS (SELECT cls, avg(h) AS mean_h FROM tot GROUP BY cls), bc AS (SELECT cls, nxt, sum(n) AS cn FROM f GROUP BY ALL),
rare AS (SELECT symbol, sum(CASE WHEN cn = n THEN n ELSE 0 END) / sum(n) AS rare FROM f JOIN bc USING (cls, nxt) GROUP BY symbol),
ns AS (SELECT symbol, sqrt(sum(n * n)) AS ns FROM f GROUP BY symbol), nc AS (SELECT cls, sqrt(sum(cn * cn)) AS nc FROM bc GROUP BY cls),
best AS (SELECT symbol, max(dot / (ns * nc)) AS best FROM (SELECT f.symbol, bc.cls AS oc, sum(n * cn) AS dot FROM f JOIN bc ON bc.nxt = f.nxt AND bc.cls <> f.cls GROUP BY ALL) JOIN ns USING (symbol) JOIN nc ON nc.cls = oc GROUP BY symbol)
SELECT symbol, cls, CAST(t AS BIGINT) AS followers, round(0.4 * coalesce(abs(h - mean_h) / nullif(mean_h, 0), 0) + 0.3 * rare + 0.3 * coalesce(best, 0), 5) AS score
FROM tot JOIN mean USING (cls) JOIN rare USING (symbol) LEFT JOIN best USING (symbol)""",
}
