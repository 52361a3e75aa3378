"""Descriptive statistics, grouping sets, envelopes, candidate grids and permutation tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sequences import TOKENS_SQL, all_tokens, grams, r6
from ..skew import bounded
from ..tables import table


def describe(df: DataFrame, by: list[str], value: str, accuracy: int | None = None) -> DataFrame:
    """Count, mean, population deviation, extremes and linear quartiles of a value per group.

    Exact quartiles hold a group's distinct values in one place; with ``accuracy``
    they come from a sketch of that size, off by at most count / accuracy ranks.
    """
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = F.percentile(value, at) if accuracy is None else F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy)
    out = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("q"))
    return out.select(*by, "count", r6("mean").alias("mean"), r6("std").alias("std"), r6("min").alias("min"), r6("max").alias("max"), *(r6(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((25, 50, 75))))


def rollup_levels(df: DataFrame, a: str, b: str, value: str, least: int = 2) -> DataFrame:
    """All, per a, per b, and per pair with at least ``least`` rows, in one pass by grouping sets."""
    level = F.grouping_id(a, b)
    name = F.when(level == 3, "all").when(level == 1, a).when(level == 2, b).otherwise(f"{a} x {b}")
    out = df.cube(a, b).agg(level.alias("__l"), name.alias("level"), F.count("*").alias("count"), r6(F.avg(value)).alias("mean"))
    label = F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    return out.filter((F.col("__l") > 0) | (F.col("count") >= least)).select("level", label.alias("label"), "count", "mean")


def envelope(df: DataFrame, stats: DataFrame, by: list[str], value: str) -> DataFrame:
    """Whether a value lies within two deviations of its group's mean and within 1.5 interquartile ranges of the quartiles."""
    rows = df.join(F.broadcast(stats) if stats.count() <= 100_000 else stats, by)
    z = F.try_divide(F.col(value) - F.col("mean"), F.col("std"))
    iqr = F.col("p75") - F.col("p25")
    inside = (F.col(value) >= F.col("p25") - 1.5 * iqr) & (F.col(value) <= F.col("p75") + 1.5 * iqr)
    part = F.when(F.col(value) <= F.col("p25"), 25).when(F.col(value) <= F.col("p50"), 50).when(F.col(value) <= F.col("p75"), 75).otherwise(100)
    return rows.withColumns({"z": r6(z), "within_2sd": F.abs(z) <= 2, "within_fence": inside, "quarter": part})


def candidate_grid(symbols: DataFrame, grid: DataFrame, evidence: DataFrame, most: float) -> DataFrame:
    """Cells (cls, grp) of a grid that a symbol may stand in: those whose mean is within ``most`` of its own.

    ``symbols(symbol, own)``, ``grid(cls, grp)``, ``evidence(cls, grp, mean)``.
    Values fall into bins of width ``most`` and a symbol meets the cells of three
    bins; cells without evidence are open to every symbol, and a symbol with no
    cell left keeps all: those rows are the result itself.
    """
    cells = grid.join(evidence, ["cls", "grp"], "left")
    bin_of = lambda c: F.floor(F.col(c) / most)
    mine = symbols.withColumn("bin", F.explode(F.array(*(bin_of("own") + i for i in (-1, 0, 1)))))
    near = mine.join(cells.filter("mean is not null").withColumn("bin", bin_of("mean")), "bin").filter(F.abs(F.col("own") - F.col("mean")) <= most)
    unknown = cells.filter("mean is null").select("cls", "grp", F.lit(1).alias("any"))
    free = symbols.withColumn("any", F.lit(1)).join(bounded(unknown), "any")
    kept = near.select("symbol", "cls", "grp").unionByName(free.select("symbol", "cls", "grp"))
    empty = symbols.join(kept.select("symbol").distinct(), "symbol", "left_anti").withColumn("any", F.lit(1))
    return kept.unionByName(empty.join(bounded(grid.withColumn("any", F.lit(1))), "any").select("symbol", "cls", "grp"))


def unit_draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of its arguments: the same for any partitioning."""
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16**12))


def permutation_test(tokens: DataFrame, queries: DataFrame, n: int, reps: int = 200, seed: int = 42) -> DataFrame:
    """How often chance grams, drawn symbol by symbol from corpus frequencies, match the corpus as often as the queries do.

    ``queries(gram)`` holds dash-joined n-grams of symbols. A replication draws as
    many grams as there are queries; its count is how many occur in the corpus.
    """
    seen = grams(tokens, n).select(F.concat_ws("-", "gram").alias("gram")).distinct()
    freq = tokens.groupBy("symbol").agg(F.count("*").alias("c"))
    from pyspark.sql import Window as W

    w = W.orderBy("symbol")  # the alphabet
    total = freq.agg(F.sum("c").alias("t"))
    cum = freq.crossJoin(F.broadcast(total)).select("symbol", ((F.sum("c").over(w) - F.col("c")) / F.col("t")).alias("lo"), (F.sum("c").over(w) / F.col("t")).alias("hi"))
    k = queries.count()
    observed = queries.join(seen, "gram", "left_semi").count()
    spark = tokens.sparkSession
    draws = spark.range(reps * k * n).select((F.col("id") / (k * n)).cast("long").alias("rep"), (F.col("id") / n % k).cast("long").alias("q"), (F.col("id") % n).alias("i"))
    draws = draws.withColumn("u", unit_draw(F.lit(str(seed)), "rep", "q", "i"))
    drawn = draws.join(bounded(cum), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    made = drawn.groupBy("rep", "q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "symbol"))), lambda x: x["symbol"]), "-").alias("gram"))
    hits = made.join(seen, "gram", "left_semi").groupBy("rep").agg(F.count("*").alias("hits"))
    every = spark.range(reps).select(F.col("id").alias("rep")).join(hits, "rep", "left").select(F.coalesce("hits", F.lit(0)).alias("hits"))
    return every.agg(
        F.lit(observed).cast("long").alias("observed"), F.round(F.avg("hits"), 5).alias("expected"), r6(F.avg((F.col("hits") >= observed).cast("double"))).alias("p_value"),
        r6((F.sum((F.col("hits") >= observed).cast("long")) + 1) / F.lit(reps + 1)).alias("p_corrected"),
    )


def shuffle_null(tokens: DataFrame, reps: int = 5, seed: int = 7) -> DataFrame:
    """Successions of equal symbols per replication when each sequence is put in a random order (0 = as it stands).

    The order is that of a hash draw per token, so it costs one dense ranking per
    replication and no sequence has to be one row.
    """
    from ..sequences import dense, neighbours

    out = [neighbours(tokens, 0, 1, ["symbol"]).agg(F.lit(0).alias("rep"), F.count_if(F.col("symbol") == F.col("symbol_p1")).alias("repeats"))]
    for r in range(1, reps + 1):
        mixed = tokens.select("seq_id", "symbol", (unit_draw(F.lit(str(seed)), F.lit(str(r)), "seq_id", "pos") * F.lit(float(16**12))).cast("long").alias("raw_pos"))
        out.append(neighbours(dense(mixed, 1 << 44), 0, 1, ["symbol"]).agg(F.lit(r).alias("rep"), F.count_if(F.col("symbol") == F.col("symbol_p1")).alias("repeats")))
    return reduce(DataFrame.unionByName, out)


def _parts(s, d):
    return table(s, d, "part")


_Q = ["AB 73-AB 14", "AB 14-AB 70", "AB 70-AB 15", "AB 02-AB 03", "AB 06-AB 81"]
QUERIES = {
    "describe_by_class": lambda s, d: describe(_parts(s, d), ["p_brand"], "p_retailprice"),
    "grouping_sets_profile": lambda s, d: rollup_levels(_parts(s, d), "p_brand", "p_type", "p_size"),
    "iqr_envelope": lambda s, d: envelope(_parts(s, d), describe(_parts(s, d), ["p_brand"], "p_retailprice"), ["p_brand"], "p_retailprice").select("p_partkey", "z", "within_2sd", "within_fence", "quarter"),
    "candidate_grid_elimination": lambda s, d: candidate_grid(
        _parts(s, d).groupBy(F.col("p_name").alias("symbol")).agg(r6(F.avg("p_size")).alias("own")),
        _parts(s, d).select(F.col("p_brand").alias("cls"), F.col("p_type").alias("grp")).distinct(),
        _parts(s, d).groupBy(F.col("p_brand").alias("cls"), F.col("p_type").alias("grp")).agg(r6(F.avg("p_size")).alias("mean")),
        0.5,
    ),
    "permutation_test_md5": lambda s, d: permutation_test(all_tokens(s, d), s.createDataFrame([(q,) for q in _Q], "gram string"), 2),
    "permutation_test_1000": lambda s, d: permutation_test(all_tokens(s, d), s.createDataFrame([(q,) for q in _Q], "gram string"), 2, 1000),
    "shuffle_null": lambda s, d: shuffle_null(all_tokens(s, d)),
}

_DESC = "WITH ds AS (SELECT p_brand, count(p_retailprice) AS count, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS std, round(min(p_retailprice), 6) AS min, round(max(p_retailprice), 6) AS max, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.75), 6) AS p75 FROM part GROUP BY p_brand) "
SQL = {
    "describe_by_class": _DESC + "SELECT * FROM ds",
    "grouping_sets_profile": """SELECT CASE grouping(p_brand, p_type) WHEN 3 THEN 'all' WHEN 1 THEN 'p_brand' WHEN 2 THEN 'p_type' ELSE 'p_brand x p_type' END AS level, concat_ws('/', p_brand, p_type) AS label, count(*) AS count, round(avg(p_size), 6) AS mean
FROM part GROUP BY CUBE (p_brand, p_type) HAVING grouping(p_brand, p_type) > 0 OR count(*) >= 2""",
    "iqr_envelope": _DESC
    + """SELECT p_partkey, round((p_retailprice - mean) / nullif(std, 0), 6) AS z, abs((p_retailprice - mean) / nullif(std, 0)) <= 2 AS within_2sd, p_retailprice BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25) AS within_fence,
CAST(CASE WHEN p_retailprice <= p25 THEN 25 WHEN p_retailprice <= p50 THEN 50 WHEN p_retailprice <= p75 THEN 75 ELSE 100 END AS INT) AS quarter FROM part JOIN ds USING (p_brand)""",
    "candidate_grid_elimination": """WITH s AS (SELECT p_name AS symbol, round(avg(p_size), 6) AS own FROM part GROUP BY 1), c AS (SELECT p_brand AS cls, p_type AS grp, round(avg(p_size), 6) AS mean FROM part GROUP BY ALL),
k AS (SELECT symbol, cls, grp FROM s, c WHERE abs(own - mean) <= 0.5) SELECT * FROM k UNION ALL SELECT symbol, cls, grp FROM s, c WHERE symbol NOT IN (SELECT symbol FROM k)""",
    "permutation_test_md5": TOKENS_SQL
    + f""", q(gram) AS (VALUES {', '.join(f"('{x}')" for x in _Q)}), sn AS (SELECT DISTINCT gram FROM (SELECT symbol || '-' || lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS gram FROM tok) WHERE gram IS NOT NULL),
fr AS (SELECT symbol, count(*) AS c FROM tok GROUP BY symbol), cu AS (SELECT symbol, (sum(c) OVER (ORDER BY symbol) - c) / sum(c) OVER () AS lo, sum(c) OVER (ORDER BY symbol) / sum(c) OVER () AS hi FROM fr),
dr AS (SELECT id // 10 AS rep, id // 2 % 5 AS q, id % 2 AS i FROM range(2000) t(id)), du AS (SELECT *, CAST('0x' || substr(md5('42|' || rep || '|' || q || '|' || i), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM dr),
md AS (SELECT rep, q, string_agg(symbol, '-' ORDER BY i) AS gram FROM du JOIN cu ON u >= lo AND u < hi GROUP BY ALL), h AS (SELECT rep, count(*) AS hits FROM md WHERE gram IN (SELECT gram FROM sn) GROUP BY rep),
e AS (SELECT coalesce(hits, 0) AS hits FROM range(200) r(rep) LEFT JOIN h USING (rep)), o AS (SELECT count(*) AS observed FROM q WHERE gram IN (SELECT gram FROM sn))
SELECT observed, round(avg(hits), 5) AS expected, round(avg(CAST(hits >= observed AS INT)), 6) AS p_value, round((sum(CAST(hits >= observed AS INT)) + 1) / 201, 6) AS p_corrected FROM e, o GROUP BY observed""",
    "permutation_test_1000": TOKENS_SQL
    + f""", q(gram) AS (VALUES {', '.join(f"('{x}')" for x in _Q)}), sn AS (SELECT DISTINCT gram FROM (SELECT symbol || '-' || lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS gram FROM tok) WHERE gram IS NOT NULL),
fr AS (SELECT symbol, count(*) AS c FROM tok GROUP BY symbol), cu AS (SELECT symbol, (sum(c) OVER (ORDER BY symbol) - c) / sum(c) OVER () AS lo, sum(c) OVER (ORDER BY symbol) / sum(c) OVER () AS hi FROM fr),
dr AS (SELECT id // 10 AS rep, id // 2 % 5 AS q, id % 2 AS i FROM range(10000) t(id)), du AS (SELECT *, CAST('0x' || substr(md5('42|' || rep || '|' || q || '|' || i), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM dr),
md AS (SELECT rep, q, string_agg(symbol, '-' ORDER BY i) AS gram FROM du JOIN cu ON u >= lo AND u < hi GROUP BY ALL), h AS (SELECT rep, count(*) AS hits FROM md WHERE gram IN (SELECT gram FROM sn) GROUP BY rep),
e AS (SELECT coalesce(hits, 0) AS hits FROM range(1000) r(rep) LEFT JOIN h USING (rep)), o AS (SELECT count(*) AS observed FROM q WHERE gram IN (SELECT gram FROM sn))
SELECT observed, round(avg(hits), 5) AS expected, round(avg(CAST(hits >= observed AS INT)), 6) AS p_value, round((sum(CAST(hits >= observed AS INT)) + 1) / 1001, 6) AS p_corrected FROM e, o GROUP BY observed""",
    "shuffle_null": TOKENS_SQL
    + """, md AS (SELECT seq_id, symbol, rep, CASE WHEN rep = 0 THEN pos ELSE CAST('0x' || substr(md5('7|' || rep || '|' || seq_id || '|' || pos), 1, 12) AS BIGINT) END AS o FROM tok, range(6) r(rep)),
n AS (SELECT rep, symbol = lead(symbol) OVER (PARTITION BY rep, seq_id ORDER BY o) AS same FROM md) SELECT CAST(rep AS INT) AS rep, count(*) FILTER (same) AS repeats FROM n GROUP BY rep""",
}
