"""Unordered co-occurrence within a unit: counts, association, matrices and cross tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import jaccard
from ..sequences import TOKENS_SQL, all_tokens, r6
from ..skew import one_task, skew_join
from ..tables import table


def cooccurrence(tokens: DataFrame, unit: str = "seq_id", least: int = 1, together: int = 1) -> DataFrame:
    """``a, b, n`` for a <= b: in how many units both occur; the diagonal is a symbol's own units.

    Only symbols with ``least`` tokens or more take part. A unit's distinct symbols
    are one array; equal arrays collapse before pairs are made, and pairs are summed
    map-side, so a hot symbol or unit costs no more than its distinct companions.
    """
    kept = tokens.filter(F.col(unit).isNotNull() & F.col("symbol").isNotNull()).select(unit, "symbol")
    if least > 1:
        often = kept.groupBy("symbol").count().filter(F.col("count") >= least).select("symbol")
        kept = kept.join(often, "symbol", "left_semi")
    sets = kept.groupBy(unit).agg(F.sort_array(F.collect_set("symbol")).alias("s"))
    weights = sets.groupBy("s").agg(F.count("*").alias("w"))
    left = weights.select("w", "s", F.posexplode("s").alias("i", "a"))
    pairs = left.select("w", "a", F.explode(F.slice("s", F.col("i") + 1, F.size("s") - F.col("i"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("n")).filter((F.col("a") == F.col("b")) | (F.col("n") >= together))


def association(cooc: DataFrame) -> DataFrame:
    """Jaccard, pmi and t-score of pairs a < b.

    ``pmi_pair_total`` and ``tscore`` take probabilities over the sum of all pair
    counts with the diagonal.
    """
    diag = cooc.filter("a = b")
    total = cooc.agg(F.sum("n").alias("t"))
    side = lambda x: diag.select(F.col("a").alias(x), F.col("n").alias(f"n_{x}"))
    rows = cooc.filter("a < b").join(side("a"), "a").join(side("b"), "b").crossJoin(F.broadcast(total))
    expected = F.col("n_a") * F.col("n_b") / F.col("t")
    return rows.select(
        "a", "b", "n", r6(jaccard(F.col("n"), F.col("n_a"), F.col("n_b"))).alias("jaccard"),
        r6(F.log2(F.col("n") / expected)).alias("pmi_pair_total"), r6((F.col("n") - expected) / F.sqrt("n")).alias("tscore"),
    )


def matrix_summary(cooc: DataFrame) -> DataFrame:
    """Symbols, non-zero pairs with the diagonal, possible pairs and density."""
    s = cooc.agg(F.count("*").alias("non_zero"), F.count_if(F.col("a") == F.col("b")).alias("symbols"), F.sum("n").alias("total"))
    possible = F.col("symbols") * (F.col("symbols") + 1) / 2
    return s.select("symbols", "non_zero", possible.cast("long").alias("possible"), r6(F.try_divide("non_zero", possible)).alias("density"), "total")


def edge_list(pairs: DataFrame, value: str, least: float = 0.0, negatives: bool = False) -> DataFrame:
    """Finite weights of at least ``least`` in size; negative ones only on request."""
    v = F.col(value)
    kept = pairs.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) & (F.abs(v) >= least))
    return (kept if negatives else kept.filter(v >= 0)).select("a", "b", r6(v).alias("weight"))


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``row`` by the stated values of ``column``, one column each."""
    out = rows.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"c_{i}") for i, v in enumerate(values)), F.count("*").alias("total"))
    return out


def kind_pairs(tokens: DataFrame, kind_a: str, kind_b: str) -> DataFrame:
    """Distinct units in which a symbol of one kind meets a symbol of another, top 5 partners each."""
    from pyspark.sql import Window as W

    named = tokens.select("seq_id", "symbol", "kind").distinct()
    kinds = named.select("symbol", "kind").distinct()
    pairs = cooccurrence(named).filter("a <> b")
    both = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    k = lambda x: kinds.select(F.col("symbol").alias(x), F.col("kind").alias(f"kind_{x}"))
    rows = both.join(k("a"), "a").join(k("b"), "b").filter((F.col("kind_a") == kind_a) & (F.col("kind_b") == kind_b))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("n"), "b"))
    return rows.select("a", "b", "n", rank.cast("long").alias("rank")).filter("rank <= 5")


def greedy_clusters(cooc: DataFrame, least: int = 2, similar: float = 0.15) -> DataFrame:
    """First-come clusters: seeds by frequency take every free symbol similar enough.

    Pair statistics are distributed; the assignment depends on its order and runs
    over the alphabet's pair table in one task.
    """

    def run(batches):
        import pandas as pd

        rows = pd.concat([b for b in batches] or [pd.DataFrame({"a": [], "b": [], "n": [], "j": []})])
        freq = {r.a: r.n for r in rows[rows.a == rows.b].itertuples()}
        near = {(r.a, r.b) for r in rows.itertuples() if r.a != r.b and r.n >= least and r.j >= similar}
        near |= {(b, a) for a, b in near}
        taken: dict[str, int] = {}
        for k, seed in enumerate(sorted(freq, key=lambda x: (-freq[x], x))):
            if seed in taken:
                continue
            for other in [seed, *sorted(x for x in freq if x not in taken and (seed, x) in near)]:
                taken[other] = k
        names = {k: min(s for s, c in taken.items() if c == k) for k in set(taken.values())}
        yield pd.DataFrame({"symbol": list(taken), "cluster": [names[c] for c in taken.values()]})

    diag = cooc.filter("a = b")
    side = lambda x: diag.select(F.col("a").alias(x), F.col("n").alias(f"n_{x}"))
    scored = cooc.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.col("n").cast("long").alias("n"), jaccard(F.col("n"), F.col("n_a"), F.col("n_b")).alias("j"))
    return one_task(scored, 5_000_000, "greedy clusters").mapInPandas(run, "symbol string, cluster string")


def _words(s, d):
    """Tokens with their word as unit: words.sign_sequences names the raw positions of a word."""
    w = table(s, d, "words").filter("inscription_id is not null").select("inscription_id", "word_index", F.explode("sign_sequences").alias("raw_pos")).distinct()
    w = w.groupBy(F.col("inscription_id").alias("seq_id"), "raw_pos").agg(F.min("word_index").alias("word"))
    return all_tokens(s, d).join(w, ["seq_id", "raw_pos"]).withColumn("unit", F.concat_ws("/", "seq_id", "word"))


def _tokens_with_site(s, d):
    ins = table(s, d, "inscriptions").groupBy(F.col("id").alias("seq_id")).agg(F.min("findspot_id").alias("findspot_id"), F.min(F.regexp_extract("minoan_period", "^([A-Z]{2})", 1)).alias("period"))
    return skew_join(all_tokens(s, d).filter("kind = 'logogram'"), ins, ["seq_id"], "inner")


QUERIES = {
    "cooc_counts": lambda s, d: cooccurrence(all_tokens(s, d), least=5),
    "cooc_word_counts": lambda s, d: cooccurrence(_words(s, d), unit="unit"),
    "cooc_association": lambda s, d: association(cooccurrence(all_tokens(s, d))),
    "cooc_summary": lambda s, d: matrix_summary(cooccurrence(all_tokens(s, d))),
    "cooc_edges": lambda s, d: edge_list(association(cooccurrence(all_tokens(s, d))), "pmi_pair_total", 0.5),
    "crosstab_all_sites": lambda s, d: _tokens_with_site(s, d).groupBy("symbol", "findspot_id").agg(F.count("*").alias("n")),
    "crosstab_period": lambda s, d: crosstab(_tokens_with_site(s, d), "symbol", "period", ["EM", "MM", "LM"]),
    "fraction_logogram_pairs": lambda s, d: kind_pairs(all_tokens(s, d), "fraction", "logogram"),
    "logogram_clusters": lambda s, d: greedy_clusters(cooccurrence(all_tokens(s, d).filter("kind = 'logogram'"))),
}


def _cooc(src: str = "tok", unit: str = "seq_id") -> str:
    return f""", it AS (SELECT DISTINCT {unit} AS u, symbol FROM {src}), co AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n FROM it x JOIN it y ON x.u = y.u AND x.symbol <= y.symbol GROUP BY ALL)"""


_ASSOC = """, tt AS (SELECT sum(n) AS t FROM co), dg AS (SELECT a, n FROM co WHERE a = b),
asc_ AS (SELECT co.a, co.b, co.n, round(co.n / (x.n + y.n - co.n), 6) AS jaccard, round(log2(co.n / (x.n * y.n / t)), 6) AS pmi_pair_total, round((co.n - x.n * y.n / t) / sqrt(co.n), 6) AS tscore
  FROM co JOIN dg x ON x.a = co.a JOIN dg y ON y.a = co.b, tt WHERE co.a < co.b)"""
_SITE = """, ins AS (SELECT id, min(findspot_id) AS findspot_id, min(regexp_extract(minoan_period, '^([A-Z]{2})', 1)) AS period FROM inscriptions GROUP BY id),
lg AS (SELECT tok.*, findspot_id, period FROM tok JOIN ins ON id = seq_id WHERE kind = 'logogram')"""
SQL = {
    "cooc_counts": TOKENS_SQL + ", often AS (SELECT * FROM tok WHERE symbol IN (SELECT symbol FROM tok GROUP BY symbol HAVING count(*) >= 5))" + _cooc("often") + "SELECT a, b, n FROM co",
    "cooc_word_counts": TOKENS_SQL
    + """, w AS (SELECT inscription_id AS seq_id, raw_pos, min(word_index) AS word FROM (SELECT inscription_id, word_index, unnest(sign_sequences) AS raw_pos FROM words WHERE inscription_id IS NOT NULL) GROUP BY ALL),
tw AS (SELECT tok.*, concat_ws('/', seq_id, word) AS unit FROM tok JOIN w USING (seq_id, raw_pos))"""
    + _cooc("tw", "unit")
    + "SELECT a, b, n FROM co",
    "cooc_association": TOKENS_SQL + _cooc() + _ASSOC + "SELECT * FROM asc_",
    "cooc_summary": TOKENS_SQL
    + _cooc()
    + "SELECT count(*) FILTER (a = b) AS symbols, count(*) AS non_zero, CAST(count(*) FILTER (a = b) * (count(*) FILTER (a = b) + 1) / 2 AS BIGINT) AS possible, round(count(*) / (count(*) FILTER (a = b) * (count(*) FILTER (a = b) + 1) / 2), 6) AS density, CAST(sum(n) AS BIGINT) AS total FROM co",
    "cooc_edges": TOKENS_SQL + _cooc() + _ASSOC + "SELECT a, b, pmi_pair_total AS weight FROM asc_ WHERE pmi_pair_total >= 0.5",
    "crosstab_all_sites": TOKENS_SQL + _SITE + "SELECT symbol, findspot_id, count(*) AS n FROM lg GROUP BY ALL",
    "crosstab_period": TOKENS_SQL + _SITE + "SELECT symbol, " + ", ".join(f"count(*) FILTER (period = '{p}') AS c_{i}" for i, p in enumerate(("EM", "MM", "LM"))) + ", count(*) AS total FROM lg GROUP BY symbol",
    "fraction_logogram_pairs": TOKENS_SQL
    + """, it AS (SELECT DISTINCT seq_id, symbol, kind FROM tok), p AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n FROM it x JOIN it y USING (seq_id) WHERE x.kind = 'fraction' AND y.kind = 'logogram' GROUP BY ALL)
SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM p QUALIFY rank <= 5""",
    "logogram_clusters": TOKENS_SQL.replace("WITH t0", "WITH RECURSIVE t0")
    + ", lo AS (SELECT * FROM tok WHERE kind = 'logogram')"
    + _cooc("lo")
    + """, dg AS (SELECT a, n FROM co WHERE a = b), nr AS (SELECT co.a, co.b FROM co JOIN dg x ON x.a = co.a JOIN dg y ON y.a = co.b WHERE co.a < co.b AND co.n >= 2 AND co.n / (x.n + y.n - co.n) >= 0.15),
nb AS (SELECT a, list(b) AS l FROM (SELECT a, b FROM nr UNION ALL SELECT b, a FROM nr) GROUP BY a), od AS (SELECT dg.a, coalesce(l, []) AS l, row_number() OVER (ORDER BY n DESC, dg.a) AS k FROM dg LEFT JOIN nb ON nb.a = dg.a),
gr(k, taken, grp) AS (SELECT 0::BIGINT, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL
SELECT od.k, CASE WHEN list_contains(taken, a) THEN taken ELSE list_concat(taken, [a], list_filter(l, lambda x: NOT list_contains(taken, x))) END, CASE WHEN list_contains(taken, a) THEN CAST([] AS VARCHAR[]) ELSE list_concat([a], list_filter(l, lambda x: NOT list_contains(taken, x))) END FROM gr JOIN od ON od.k = gr.k + 1)
SELECT unnest(grp) AS symbol, list_min(grp) AS cluster FROM gr""",
}
