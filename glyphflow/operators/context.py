"""What stands around a token: wide contexts, band joins, walks to a blocker, enrichment of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import hypergeom_pmf
from ..sequences import TOKENS_SQL, all_tokens, neighbours, r6
from ..tables import table


def wide_context(tokens: DataFrame, anchor: Column, k: int = 3) -> DataFrame:
    """The k tokens before and after each anchor as columns, nearest first."""
    return neighbours(tokens, k, k, ["symbol"]).filter(anchor)


def masked_context(tokens: DataFrame, k: int = 5) -> DataFrame:
    """``tokens array``: the 2k + 1 symbols around each token, itself masked, the outside padded."""
    rows = neighbours(tokens, k, k, ["symbol"])
    pad = lambda c: F.coalesce(F.col(c), F.lit("<pad>"))
    window = [pad(f"symbol_m{i}") for i in range(k, 0, -1)] + [F.lit("<mask>")] + [pad(f"symbol_p{i}") for i in range(1, k + 1)]
    return rows.select("seq_id", "pos", F.col("symbol").alias("target"), F.concat_ws(" ", *window).alias("window"))


def band_join(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Pairs of a left and a right token of one sequence at most k positions apart.

    Positions are binned by k + 1 and each left row meets three bins, so the join
    key is (seq_id, bin) and a long sequence spreads over its bins.
    """
    width = k + 1
    a = left.select("seq_id", F.col("pos").alias("pos_a"), F.col("symbol").alias("a")).withColumn("bin", F.explode(F.array(*((F.floor(F.col("pos_a") / width) + i) for i in (-1, 0, 1)))))
    b = right.select("seq_id", F.col("pos").alias("pos_b"), F.col("symbol").alias("b")).withColumn("bin", F.floor(F.col("pos_b") / width))
    return a.join(b, ["seq_id", "bin"]).filter((F.abs(F.col("pos_a") - F.col("pos_b")) <= k) & (F.col("pos_a") != F.col("pos_b"))).drop("bin")


def until_blocked(tokens: DataFrame, anchor: Column, blocker: Column, wanted: Column, reach: int = 5) -> DataFrame:
    """Wanted tokens on both sides of each anchor, in order, by ``raw_pos`` at most ``reach`` away and before the first blocker.

    Other tokens and missing positions are passed over.
    """
    rows = neighbours(tokens.withColumns({"stop": F.coalesce(blocker, F.lit(False)), "want": F.coalesce(wanted, F.lit(False))}), reach, reach, ["symbol", "raw_pos", "stop", "want"]).filter(anchor)
    sides = {}
    for side in "mp":
        free, out = F.lit(True), []
        for i in range(1, reach + 1):
            near = F.coalesce(F.abs(F.col(f"raw_pos_{side}{i}") - F.col("raw_pos")) <= reach, F.lit(False))
            free = free & near & ~F.col(f"stop_{side}{i}")
            out.append(F.when(free & F.col(f"want_{side}{i}"), F.col(f"symbol_{side}{i}")))
        sides[side] = F.concat_ws(" ", *(reversed(out) if side == "m" else out))
    return rows.select("seq_id", "pos", "symbol", sides["m"].alias("left"), sides["p"].alias("right"))


def neighbour_profile(tokens: DataFrame, anchor: Column, k: int = 3, top: int = 10) -> DataFrame:
    """Per anchor symbol its ``top`` companions within k places, with their share."""
    wide = wide_context(tokens, anchor, k)
    slots = [f"symbol_{s}{i}" for s in "mp" for i in range(1, k + 1)]
    each = wide.select(F.col("symbol").alias("anchor"), F.explode(F.array(*slots)).alias("near")).filter("near is not null")
    c = each.groupBy("anchor", "near").agg(F.count("*").alias("n"))
    w = W.partitionBy("anchor")  # alphabet x alphabet rows
    rank = F.row_number().over(w.orderBy(F.desc("n"), "near")).cast("long")
    return c.select("anchor", "near", "n", r6(F.col("n") / F.sum("n").over(w)).alias("share"), rank.alias("rank")).filter(F.col("rank") <= top)


def slots(tokens: DataFrame, anchor: Column, cls: Column, k: int = 3, sides: str = "both") -> DataFrame:
    """``cls, symbol, n``: how often a symbol fills a place around anchors of a class."""
    wide = wide_context(tokens, anchor, k).withColumn("cls", cls)
    names = [f"symbol_{s}{i}" for s in ("mp" if sides == "both" else "p" if sides == "after" else "m") for i in range(1, k + 1)]
    return wide.select("cls", F.explode(F.array(*names)).alias("symbol")).filter("symbol is not null").groupBy("cls", "symbol").agg(F.count("*").alias("n"))


def distinctiveness(counts: DataFrame) -> DataFrame:
    """Rate of a symbol in a class over its rate in all other classes; infinite where no other has it."""
    by_c = counts.groupBy("cls").agg(F.sum("n").alias("nc"))
    by_s = counts.groupBy("symbol").agg(F.sum("n").alias("ns"))
    total = counts.agg(F.sum("n").alias("t"))
    rows = counts.join(by_c, "cls").join(by_s, "symbol").crossJoin(F.broadcast(total))
    own = F.col("n") / F.col("nc")
    rest = F.try_divide(F.col("ns") - F.col("n"), F.col("t") - F.col("nc"))
    return rows.select("cls", "symbol", "n", F.when(rest < 1e-10, F.lit(None).cast("double")).otherwise(r6(own / F.nullif(rest, F.lit(0.0)))).alias("ratio"), (rest < 1e-10).alias("only_here"))


def enrichment(counts: DataFrame, least: int = 3) -> DataFrame:
    """Upper hypergeometric tail, fold and family-wise level of each (class, symbol) seen ``least`` times in all."""
    by_c = counts.groupBy("cls").agg(F.sum("n").alias("nc"))
    by_s = counts.groupBy("symbol").agg(F.sum("n").alias("ns")).filter(F.col("ns") >= least)
    total = counts.agg(F.sum("n").alias("t"))
    rows = counts.join(by_c, "cls").join(by_s, "symbol").crossJoin(F.broadcast(total))
    tests = rows.agg(F.count("*").alias("tests"))
    # the first term by factorials, each further one by its ratio to the one before
    ratio = lambda k: (F.col("ns") - k) * (F.col("nc") - k) / F.greatest((k + 1) * (F.col("t") - F.col("ns") - F.col("nc") + k + 1), F.lit(1))
    start = F.struct(hypergeom_pmf(F.col("n"), F.col("t"), F.col("ns"), F.col("nc")).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.col("n"), F.least("nc", "ns")), start, lambda x, k: F.struct((x["term"] * ratio(k)).alias("term"), (x["sum"] + x["term"]).alias("sum")))["sum"]
    p = rows.select("cls", "symbol", "n", "nc", "ns", "t", tail.alias("p"))
    fold = F.col("n") * F.col("t") / (F.col("nc") * F.col("ns"))
    level = F.lit(0.05) / F.col("tests")
    return p.crossJoin(F.broadcast(tests)).select("cls", "symbol", "n", F.round(F.least("p", F.lit(1.0)), 5).alias("p_value"), F.round(fold, 9).alias("fold"), (F.col("p") < level).alias("family_wise"))


def contingency(rows: DataFrame, flag_a: Column, flag_b: Column) -> DataFrame:
    """2 x 2 counts, both rates, their ratio, the probability of this very table, and of all tables no likelier (two-sided test)."""
    a, b = F.coalesce(flag_a, F.lit(False)), F.coalesce(flag_b, F.lit(False))
    n = rows.agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))
    ra, rb = F.try_divide("n11", F.col("n11") + F.col("n10")), F.try_divide("n01", F.col("n01") + F.col("n00"))
    total = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    marked, drawn = F.col("n11") + F.col("n01"), F.col("n11") + F.col("n10")
    pmf = hypergeom_pmf(F.col("n11"), total, marked, drawn)
    every = F.transform(F.sequence(F.greatest(marked + drawn - total, F.lit(0)), F.least(marked, drawn)), lambda k: hypergeom_pmf(k, total, marked, drawn))
    two = F.aggregate(F.filter(every, lambda p: p <= pmf * (1 + 1e-7)), F.lit(0.0), lambda x, p: x + p)
    return n.select("n11", "n10", "n01", "n00", r6(ra).alias("rate_a"), r6(rb).alias("rate_not_a"), r6(F.try_divide(ra, rb)).alias("enrichment"), F.round(pmf, 8).alias("table_probability"), F.round(F.least(two, F.lit(1.0)), 6).alias("two_sided"))


def rule_accuracy(rows: DataFrame, rule: Column, truth: Column) -> DataFrame:
    """Accuracy of a rule, of always saying the majority, and the lift."""
    s = rows.filter(truth.isNotNull()).agg(F.avg((rule == truth).cast("double")).alias("acc"), F.avg(truth.cast("double")).alias("share"), F.count("*").alias("n"))
    base = F.greatest(F.col("share"), 1 - F.col("share"))
    return s.select("n", r6("acc").alias("accuracy"), r6(base).alias("majority"), r6(F.col("acc") - base).alias("lift"))


def class_steps(tokens: DataFrame, first: Column, second: str) -> DataFrame:
    """Adjacent pairs of a token in one class and the next in another."""
    rows = neighbours(tokens, 0, 1, ["symbol", "kind"]).filter(first & (F.col("kind_p1") == second))
    return rows.groupBy("symbol", F.col("symbol_p1").alias("next")).agg(F.count("*").alias("n"))


def around_marked_words(tokens: DataFrame, divider: Column, mark: Column) -> DataFrame:
    """Words (between dividers) that hold a marked token, with the words before and after."""
    flagged = tokens.withColumn("d", divider.cast("long"))
    word = F.sum("d").over(W.partitionBy("seq_id").orderBy("pos"))
    words = flagged.withColumn("word", word).filter("d = 0").groupBy("seq_id", "word").agg(F.max(mark.cast("int")).alias("marked"), F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"))
    w = W.partitionBy("seq_id").orderBy("word")
    none = F.lit(-1).cast("long")  # there is no word before or after
    out = words.select("*", F.coalesce(F.lag("to_pos").over(w), none).alias("before_to"), F.coalesce(F.lead("from_pos").over(w), none).alias("after_from"))
    return out.filter("marked = 1").drop("marked", "word")


_LOGO = "kind = 'logogram'"
QUERIES = {
    "context_window_wide": lambda s, d: wide_context(all_tokens(s, d), F.col("kind") == "logogram").drop("raw_pos", "kind", "translit", "character"),
    "padded_windows": lambda s, d: masked_context(all_tokens(s, d)),
    "band_join_pm5": lambda s, d: band_join(all_tokens(s, d).filter(_LOGO), all_tokens(s, d).filter("kind = 'numeral'"), 5),
    "blocker_scan": lambda s, d: until_blocked(all_tokens(s, d), F.col("kind") == "logogram", F.col("kind").isin("logogram", "fraction", "numeral"), F.col("kind") == "syllabogram"),
    "neighbour_profile": lambda s, d: neighbour_profile(all_tokens(s, d), F.col("kind") == "logogram"),
    "class_distinctiveness": lambda s, d: distinctiveness(slots(all_tokens(s, d), F.col("kind") == "logogram", F.substring("translit", 1, 3))),
    "hypergeom_enrichment": lambda s, d: enrichment(slots(all_tokens(s, d), F.col("kind") == "logogram", F.substring("translit", 1, 3), sides="after")),
    "contingency_rates": lambda s, d: contingency(table(s, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"),
    "rule_vs_majority": lambda s, d: rule_accuracy(table(s, d, "lineitem"), F.col("l_quantity") > 25, F.col("l_returnflag") == "R"),
    "class_steps": lambda s, d: class_steps(all_tokens(s, d), F.col("kind") == "syllabogram", "logogram"),
    "affix_neighbours": lambda s, d: around_marked_words(all_tokens(s, d), F.col("kind") == "word divider", F.col("kind") == "logogram"),
    "json_props_extract": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
}

_W = "WINDOW w AS (PARTITION BY seq_id ORDER BY pos)"
_WIDE = ", wide AS (SELECT seq_id, pos, symbol, kind, translit, " + ", ".join([f"lag(symbol, {i}) OVER w AS symbol_m{i}" for i in (1, 2, 3)] + [f"lead(symbol, {i}) OVER w AS symbol_p{i}" for i in (1, 2, 3)]) + f" FROM tok {_W})"


def _slot_sql(sides: str) -> str:
    return _WIDE + ", cnt AS (SELECT cls, symbol, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT substr(translit, 1, 3) AS cls, symbol_{s}{i} AS symbol FROM wide WHERE kind = 'logogram'" for s in sides for i in (1, 2, 3)) + ") WHERE symbol IS NOT NULL GROUP BY ALL)"


_PAD = " || ' ' || ".join([f"coalesce(lag(symbol, {i}) OVER w, '<pad>')" for i in range(5, 0, -1)] + ["'<mask>'"] + [f"coalesce(lead(symbol, {i}) OVER w, '<pad>')" for i in range(1, 6)])
_LNC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_PMF = f"exp({_LNC.format('ns', 'k')} + {_LNC.format('(t - ns)', '(nc - k)')} - {_LNC.format('t', 'nc')})"
SQL = {
    "context_window_wide": TOKENS_SQL + _WIDE + "SELECT seq_id, pos, symbol, symbol_m1, symbol_m2, symbol_m3, symbol_p1, symbol_p2, symbol_p3 FROM wide WHERE kind = 'logogram'",
    "padded_windows": TOKENS_SQL + f"SELECT seq_id, pos, symbol AS target, {_PAD} AS window FROM tok {_W}",
    "band_join_pm5": TOKENS_SQL + "SELECT x.seq_id, x.pos AS pos_a, x.symbol AS a, y.pos AS pos_b, y.symbol AS b FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND abs(x.pos - y.pos) <= 5 WHERE x.kind = 'logogram' AND y.kind = 'numeral'",
    "blocker_scan": TOKENS_SQL
    + """, an AS (SELECT seq_id, pos, raw_pos, symbol FROM tok WHERE kind = 'logogram'),
nr AS (SELECT x.seq_id, x.pos, x.raw_pos, y.raw_pos - x.raw_pos AS d, y.symbol, y.kind FROM an x JOIN tok y ON y.seq_id = x.seq_id AND abs(y.raw_pos - x.raw_pos) BETWEEN 1 AND 5),
bl AS (SELECT seq_id, pos, coalesce(min(d) FILTER (d > 0), 6) AS hi, coalesce(max(d) FILTER (d < 0), -6) AS lo FROM nr WHERE kind IN ('logogram', 'fraction', 'numeral') GROUP BY ALL),
ok AS (SELECT nr.* FROM nr LEFT JOIN bl USING (seq_id, pos) WHERE kind = 'syllabogram' AND d < coalesce(hi, 6) AND d > coalesce(lo, -6))
SELECT an.seq_id, an.pos, an.symbol, coalesce(string_agg(ok.symbol, ' ' ORDER BY d) FILTER (d < 0), '') AS left, coalesce(string_agg(ok.symbol, ' ' ORDER BY d) FILTER (d > 0), '') AS right FROM an LEFT JOIN ok USING (seq_id, pos) GROUP BY ALL""",
    "neighbour_profile": TOKENS_SQL
    + _WIDE
    + ", e AS ("
    + " UNION ALL ".join(f"SELECT symbol AS anchor, symbol_{s}{i} AS near FROM wide WHERE kind = 'logogram'" for s in "mp" for i in (1, 2, 3))
    + "), c AS (SELECT anchor, near, count(*) AS n FROM e WHERE near IS NOT NULL GROUP BY ALL) SELECT anchor, near, n, round(n / sum(n) OVER (PARTITION BY anchor), 6) AS share, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, near) AS rank FROM c QUALIFY rank <= 10",
    "class_distinctiveness": TOKENS_SQL
    + _slot_sql("mp")
    + """, r AS (SELECT *, sum(n) OVER (PARTITION BY cls) AS nc, sum(n) OVER (PARTITION BY symbol) AS ns, sum(n) OVER () AS t FROM cnt)
SELECT cls, symbol, n, CASE WHEN (ns - n) / (t - nc) >= 1e-10 THEN round(n / nc / ((ns - n) / (t - nc)), 6) END AS ratio, (ns - n) / (t - nc) < 1e-10 AS only_here FROM r""",
    "hypergeom_enrichment": TOKENS_SQL
    + _slot_sql("p")
    + f""", r AS (SELECT *, sum(n) OVER (PARTITION BY cls) AS nc, sum(n) OVER (PARTITION BY symbol) AS ns, sum(n) OVER () AS t FROM cnt), f AS (SELECT * FROM r WHERE ns >= 3),
k AS (SELECT *, unnest(range(n, CAST(least(nc, ns) AS BIGINT) + 1)) AS k FROM f), p AS (SELECT cls, symbol, n, nc, ns, t, sum({_PMF}) AS p FROM k WHERE nc - k <= t - ns GROUP BY ALL)
SELECT cls, symbol, n, round(least(p, 1), 5) AS p_value, round(n * t / (nc * ns), 9) AS fold, p < 0.05 / (SELECT count(*) FROM f) AS family_wise FROM p""",
    "contingency_rates": f"""WITH c AS (SELECT count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM (SELECT o_orderstatus = 'F' AS a, o_orderpriority = '1-URGENT' AS b FROM orders)),
d AS (SELECT *, n11 AS k, n11 + n01 AS ns, n11 + n10 AS nc, n11 + n10 + n01 + n00 AS t FROM c)
SELECT n11, n10, n01, n00, round(n11 / nc, 6) AS rate_a, round(n01 / (n01 + n00), 6) AS rate_not_a, round((n11 / nc) / (n01 / (n01 + n00)), 6) AS enrichment, round({_PMF}, 8) AS table_probability,
round(least((SELECT sum(q) FROM (SELECT {_PMF} AS q FROM (SELECT ns, nc, t, unnest(range(CAST(greatest(ns + nc - t, 0) AS BIGINT), CAST(least(ns, nc) AS BIGINT) + 1)) AS k FROM d)) WHERE q <= (SELECT {_PMF} FROM d) * (1 + 1e-7)), 1), 6) AS two_sided FROM d""",
    "rule_vs_majority": "SELECT n, round(acc, 6) AS accuracy, round(greatest(share, 1 - share), 6) AS majority, round(acc - greatest(share, 1 - share), 6) AS lift FROM (SELECT count(*) AS n, avg(CAST((l_quantity > 25) = (l_returnflag = 'R') AS INT)) AS acc, avg(CAST(l_returnflag = 'R' AS INT)) AS share FROM lineitem)",
    "class_steps": TOKENS_SQL + f", s AS (SELECT kind, symbol, lead(symbol) OVER w AS next, lead(kind) OVER w AS nk FROM tok {_W}) SELECT symbol, next, count(*) AS n FROM s WHERE kind = 'syllabogram' AND nk = 'logogram' GROUP BY ALL",
    "affix_neighbours": TOKENS_SQL
    + """, f AS (SELECT *, sum(CASE WHEN kind = 'word divider' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos) AS word FROM tok),
wd AS (SELECT seq_id, word, max(CASE WHEN kind = 'logogram' THEN 1 ELSE 0 END) AS marked, min(pos) AS from_pos, max(pos) AS to_pos FROM f WHERE kind <> 'word divider' GROUP BY ALL),
o AS (SELECT *, lag(to_pos) OVER (PARTITION BY seq_id ORDER BY word) AS before_to, lead(from_pos) OVER (PARTITION BY seq_id ORDER BY word) AS after_from FROM wd)
SELECT seq_id, from_pos, to_pos, coalesce(before_to, -1) AS before_to, coalesce(after_from, -1) AS after_from FROM o WHERE marked = 1""",
    "json_props_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
