"""Where symbols stand: initial, medial, final profiles, their clusters and outliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import euclidean, kl_divergence
from ..sequences import TOKENS_SQL, all_tokens, lengths, neighbours, r6, syllables
from ..skew import one_task, skew_join
from ..tables import table


def placed(tokens: DataFrame) -> DataFrame:
    """Adds the flags ``initial``, ``medial``, ``final``; a token alone is both initial and final."""
    rows = neighbours(tokens, 0, 1, ["pos"])
    first, last = F.col("pos") == 0, F.col("pos_p1").isNull()
    return rows.withColumns({"initial": first, "final": last, "medial": ~first & ~last})


def profiles(tokens: DataFrame) -> DataFrame:
    """``symbol, n_initial, n_medial, n_final, total, occurrences``; total counts places, occurrences tokens."""
    n = lambda c: F.count_if(c).alias(f"n_{c}")
    rows = placed(tokens).groupBy("symbol").agg(n("initial"), n("medial"), n("final"), F.count("*").alias("occurrences"))
    return rows.withColumn("total", F.col("n_initial") + F.col("n_medial") + F.col("n_final"))


def fractions(tokens: DataFrame, denominator: str = "total") -> DataFrame:
    """Profile fractions over places (``total``) or tokens (``occurrences``), with their entropy and a label."""
    p = profiles(tokens)
    f = {k: F.col(f"n_{k}") / F.col(denominator) for k in ("initial", "medial", "final")}
    h = F.lit(0.0) - sum((F.when(x > 0, x * F.log2(x)).otherwise(0.0) for x in f.values()), F.lit(0.0))
    label = F.when(f["initial"] > 0.5, "initial").when(f["final"] > 0.5, "final").when(f["medial"] > 0.5, "medial").otherwise("flexible")
    return p.select("symbol", "n_initial", "n_medial", "n_final", F.col(denominator).alias("total"), *(r6(x).alias(k) for k, x in f.items()), r6(h).alias("entropy"), label.alias("bias"))


def relative_bins(tokens: DataFrame, bins: int = 10) -> DataFrame:
    """Per symbol the entropy of its relative position in ``bins`` bins; tokens alone in their sequence stand at 0."""
    rows = skew_join(tokens, lengths(tokens), ["seq_id"], "inner")
    rel = F.when(F.col("len") > 1, F.col("pos") / (F.col("len") - 1)).otherwise(0.0)
    b = F.least(F.floor(rel * bins), F.lit(bins - 1))
    c = rows.groupBy("symbol", b.alias("bin")).agg(F.count("*").alias("n"))
    s = c.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.count("*").alias("bins"))
    return s.select("symbol", "n", "bins", r6(F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n")).alias("entropy"))


def affix_candidates(tokens: DataFrame, share: float = 0.5, least: int = 5) -> DataFrame:
    f = fractions(tokens).filter(F.col("total") >= least)
    kinds = F.when(F.col("initial") >= share, "prefix").when(F.col("final") >= share, "suffix")
    return f.select("symbol", kinds.alias("affix"), "total", F.greatest("initial", "final").alias("strength")).filter("affix is not null")


def medial_poor(tokens: DataFrame, most: float = 0.15, least: int = 5) -> DataFrame:
    return fractions(tokens).filter((F.col("medial") < most) & (F.col("total") >= least)).select("symbol", "total", "medial")


def class_anomaly(tokens: DataFrame, class_of: DataFrame, least: int = 5) -> DataFrame:
    """KL divergence and distance of each profile from the mean of its class (``class_of(symbol, cls)``)."""
    f = fractions(tokens).filter(F.col("total") >= least).join(class_of, "symbol")
    means = f.groupBy("cls").agg(*(F.avg(k).alias(f"mean_{k}") for k in ("initial", "medial", "final")), F.count("*").alias("members"))
    rows = f.join(means, "cls").filter("members >= 2")
    own, mean = [F.col(k) for k in ("initial", "medial", "final")], [F.col(f"mean_{k}") for k in ("initial", "medial", "final")]
    return rows.select("symbol", "cls", "members", F.round(kl_divergence(own, mean), 5).alias("divergence"), F.round(euclidean(own, mean), 5).alias("distance"))


def symbol_report(tokens: DataFrame, symbol: str, final_over: float = 0.4, medial_over: float = 0.5) -> DataFrame:
    f = fractions(tokens).filter(F.col("symbol") == symbol)
    return f.withColumn("verdict", F.when(F.col("final") > final_over, "final").when(F.col("medial") > medial_over, "medial").otherwise("free")).drop("bias")


def nearest_prototype(tokens: DataFrame, prototypes: DataFrame) -> DataFrame:
    """The prototype (``name, p_initial, p_medial, p_final``; a handful of rows) nearest to each profile."""
    f = fractions(tokens)
    own, ref = [F.col(k) for k in ("initial", "medial", "final")], [F.col(f"p_{k}") for k in ("initial", "medial", "final")]
    near = f.crossJoin(F.broadcast(prototypes)).withColumn("d", r6(euclidean(own, ref)))  # prototypes x alphabet
    return near.groupBy("symbol").agg(F.min(F.struct("d", "name")).alias("m")).select("symbol", F.col("m.name").alias("prototype"), F.col("m.d").alias("distance"))


def kmeans(tokens: DataFrame, k: int, seed: int = 42, rounds: int = 100) -> DataFrame:
    """K-means of profiles: Forgy start, empty clusters reseeded by the farthest point.

    Profiles are one row per symbol of the alphabet, so they are clustered in one
    place; ``label`` names a cluster by the fraction its centroid exceeds 0.4 in.
    """

    def run(batches):
        import pandas as pd

        rows = [b for b in batches if len(b)]
        if not rows:
            return
        df = pd.concat(rows).sort_values("symbol", ignore_index=True)
        x = df[["initial", "medial", "final"]].to_numpy(float)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        own = None
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            new = d.argmin(1)
            for j in range(len(c)):
                if not (new == j).any():
                    new[d.min(1).argmax()] = j
            if own is not None and (new == own).all():
                break
            own = new
            c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        best = c.argmax(1)
        names = np.where(c.max(1) > 0.4, np.array(["initial", "medial", "final"])[best], "flexible")
        yield pd.DataFrame({"symbol": df.symbol, "cluster": own.astype("int32"), "label": names[own], "distance": np.sqrt(((x - c[own]) ** 2).sum(1))})

    small = fractions(tokens).select("symbol", "initial", "medial", "final")
    return one_task(small, 1_000_000, "k-means").mapInPandas(run, "symbol string, cluster int, label string, distance double")


def _classes(s, d):
    return table(s, d, "sign_list").filter("sign_type = 'syllabogram'").select(F.col("bennett_id").alias("symbol"), F.substring("transliteration", -1, 1).alias("cls"))


def _prototypes(s):
    return s.createDataFrame([("start", 0.8, 0.1, 0.1), ("middle", 0.1, 0.8, 0.1), ("end", 0.1, 0.1, 0.8), ("even", 0.34, 0.33, 0.33)], "name string, p_initial double, p_medial double, p_final double")


QUERIES = {
    "positional_profile": lambda s, d: profiles(all_tokens(s, d)),
    "positional_entropy": lambda s, d: fractions(syllables(s, d)),
    "positional_by_occurrence": lambda s, d: fractions(syllables(s, d), "occurrences"),
    "relative_bins": lambda s, d: relative_bins(syllables(s, d)),
    "boundary_candidates": lambda s, d: affix_candidates(all_tokens(s, d), 0.15),
    "medial_poor_symbols": lambda s, d: medial_poor(all_tokens(s, d), 0.85),
    "class_kl_anomaly": lambda s, d: class_anomaly(syllables(s, d), _classes(s, d)),
    "symbol_report": lambda s, d: symbol_report(all_tokens(s, d), "AB 73"),
    "nearest_prototype": lambda s, d: nearest_prototype(syllables(s, d), _prototypes(s)),
    "kmeans_profiles": lambda s, d: kmeans(syllables(s, d), 4),
}


def _prof(src: str) -> str:
    return f""", pl AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS len FROM {src}),
pr AS (SELECT symbol, count(*) FILTER (pos = 0) AS n_initial, count(*) FILTER (pos > 0 AND pos < len - 1) AS n_medial, count(*) FILTER (pos = len - 1) AS n_final, count(*) AS occurrences FROM pl GROUP BY symbol),
pf AS (SELECT *, n_initial + n_medial + n_final AS total FROM pr)"""


def _frac(den: str) -> str:
    h = " + ".join(f"CASE WHEN n_{k} > 0 THEN n_{k} / {den} * log2(n_{k} / {den}) ELSE 0 END" for k in ("initial", "medial", "final"))
    return f""", fr AS (SELECT symbol, n_initial, n_medial, n_final, {den} AS total, round(n_initial / {den}, 6) AS initial, round(n_medial / {den}, 6) AS medial, round(n_final / {den}, 6) AS final,
  round(0.0 - ({h}), 6) AS entropy, CASE WHEN n_initial / {den} > 0.5 THEN 'initial' WHEN n_final / {den} > 0.5 THEN 'final' WHEN n_medial / {den} > 0.5 THEN 'medial' ELSE 'flexible' END AS bias FROM pf)"""


_KL_SUM = lambda a: "(" + " + ".join(f"({a}{k} + 1e-10)" for k in ("initial", "medial", "final")) + ")"
_KL = " + ".join(f"(({k} + 1e-10) / {_KL_SUM('')}) * log2((({k} + 1e-10) / {_KL_SUM('')}) / ((mean_{k} + 1e-10) / {_KL_SUM('mean_')}))" for k in ("initial", "medial", "final"))
SQL = {
    "positional_profile": TOKENS_SQL + _prof("tok") + "SELECT symbol, n_initial, n_medial, n_final, occurrences, total FROM pf",
    "positional_entropy": TOKENS_SQL + _prof("syl") + _frac("total") + "SELECT * FROM fr",
    "positional_by_occurrence": TOKENS_SQL + _prof("syl") + _frac("occurrences") + "SELECT * FROM fr",
    "relative_bins": TOKENS_SQL
    + _prof("syl")
    + """, c AS (SELECT symbol, least(floor(CASE WHEN len > 1 THEN pos / (len - 1) ELSE 0.0 END * 10), 9) AS bin, count(*) AS n FROM pl GROUP BY ALL)
SELECT symbol, CAST(sum(n) AS BIGINT) AS n, count(*) AS bins, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY symbol""",
    "boundary_candidates": TOKENS_SQL
    + _prof("tok")
    + _frac("total")
    + """SELECT * FROM (SELECT symbol, CASE WHEN initial >= 0.15 THEN 'prefix' WHEN final >= 0.15 THEN 'suffix' END AS affix, total, greatest(initial, final) AS strength FROM fr WHERE total >= 5) WHERE affix IS NOT NULL""",
    "medial_poor_symbols": TOKENS_SQL + _prof("tok") + _frac("total") + "SELECT symbol, total, medial FROM fr WHERE medial < 0.85 AND total >= 5",
    "class_kl_anomaly": TOKENS_SQL
    + _prof("syl")
    + _frac("total")
    + f""", f AS (SELECT fr.*, right(transliteration, 1) AS cls FROM fr JOIN sign_list ON bennett_id = symbol WHERE total >= 5),
m AS (SELECT cls, avg(initial) AS mean_initial, avg(medial) AS mean_medial, avg(final) AS mean_final, count(*) AS members FROM f GROUP BY cls)
SELECT symbol, cls, members, round({_KL}, 5) AS divergence, round(sqrt((initial - mean_initial) ** 2 + (medial - mean_medial) ** 2 + (final - mean_final) ** 2), 5) AS distance FROM f JOIN m USING (cls) WHERE members >= 2""",
    "symbol_report": TOKENS_SQL
    + _prof("tok")
    + _frac("total")
    + "SELECT symbol, n_initial, n_medial, n_final, total, initial, medial, final, entropy, CASE WHEN final > 0.4 THEN 'final' WHEN medial > 0.5 THEN 'medial' ELSE 'free' END AS verdict FROM fr WHERE symbol = 'AB 73'",
    "nearest_prototype": TOKENS_SQL
    + _prof("syl")
    + _frac("total")
    + """, p(name, a, b, c) AS (VALUES ('start', 0.8, 0.1, 0.1), ('middle', 0.1, 0.8, 0.1), ('end', 0.1, 0.1, 0.8), ('even', 0.34, 0.33, 0.33)),
d AS (SELECT symbol, name, round(sqrt((initial - CAST(a AS DOUBLE)) ** 2 + (medial - CAST(b AS DOUBLE)) ** 2 + (final - CAST(c AS DOUBLE)) ** 2), 6) AS d FROM fr, p)
SELECT symbol, name AS prototype, d AS distance FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d, name) = 1""",
}
