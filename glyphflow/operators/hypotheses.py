"""Hypothesis work over symbols: cohesion, link scores, proposals, ablation, bootstrapping and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cv_label, fraction_value, onset, vowel, weighted_levenshtein
from ..scratch import written
from ..sequences import TOKENS_SQL, all_tokens, grams, neighbours, r6, syllables
from ..skew import bounded, one_task
from ..tables import table
from .cooc import cooccurrence
from .describe import unit_draw
from .evidence import plausibility
from .matching import _PATTERNS, _pat, frame_links, match_score, window_levenshtein
from .words import _types


def link_cohesion(tokens: DataFrame, links: DataFrame) -> DataFrame:
    """Share of adjacent pairs that are linked, against what the symbols' frequencies let expect (``links(a, b)``, a < b)."""
    step = neighbours(tokens, 0, 1, ["symbol"]).filter("symbol_p1 is not null and symbol <> symbol_p1")
    pairs = step.groupBy(F.least("symbol", "symbol_p1").alias("a"), F.greatest("symbol", "symbol_p1").alias("b")).agg(F.count("*").alias("n"))
    one = tokens.groupBy("symbol").agg(F.count("*").alias("c"))
    total = one.agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("t2"))
    linked = links.select("a", "b").distinct()
    seen = pairs.join(linked.withColumn("l", F.lit(1)), ["a", "b"], "left").agg(F.sum("n").alias("pairs"), F.coalesce(F.sum(F.when(F.col("l") == 1, F.col("n"))), F.lit(0)).alias("hit"))
    side = lambda x: one.select(F.col("symbol").alias(x), F.col("c").alias(f"c_{x}"))
    chance = linked.join(side("a"), "a").join(side("b"), "b").agg(F.coalesce(F.sum(F.col("c_a") * F.col("c_b") * 2), F.lit(0)).alias("w"))
    return seen.crossJoin(chance).crossJoin(total).select(  # one row each
        "pairs", F.col("hit").alias("linked"), r6(F.try_divide("hit", "pairs")).alias("observed"), r6(F.try_divide(F.col("w"), F.col("t") * F.col("t") - F.col("t2"))).alias("expected")
    )


def fraction_pairs(tokens: DataFrame) -> DataFrame:
    """Fractions with the whole numbers that stand right before them: count and mean."""
    step = neighbours(tokens, 1, 0, ["symbol", "kind"]).filter("kind = 'fraction' and kind_m1 = 'numeral'")
    whole = F.regexp_extract("symbol_m1", r"(\d+)", 1).try_cast("long")
    return step.groupBy("symbol").agg(F.count("*").alias("n"), r6(F.avg(whole)).alias("mean_whole"))


def propose_fractions(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Values for fractions that have none: first the complement of a known partner, then the unused value of best score, then the first unused.

    ``known(symbol, value)`` with nulls for the open ones; ``pairs(a, b, n)`` how
    often two fractions share a text. The assignment is sequential over the dozen
    fraction signs; only the pair statistics are distributed.
    """

    def run(batches):
        import pandas as pd

        df = pd.concat(list(batches))
        value = {r.a: r.value for r in df[df.b.isna()].itertuples()}
        near = {(r.a, r.b): r.n for r in df[df.b.notna()].itertuples()}
        pool = [1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 6, 1 / 8, 2 / 3, 3 / 4, 1 / 10, 1 / 12, 1 / 16, 1 / 20, 1 / 24, 1 / 30]
        out = {s: (v, "known") for s, v in value.items() if v == v and v is not None}
        used = {round(v, 6) for v, _ in out.values()}
        for s in sorted(x for x in value if x not in out):
            partners = sorted((-n, p) for (a, p), n in near.items() if a == s and p in out)
            pick, how = None, ""
            for _, p in partners:
                rest = round(1 - out[p][0], 6)
                if 0 < rest < 1 and rest not in used:
                    pick, how = rest, "complement"
                    break
            if pick is None:
                free = [v for v in pool if round(v, 6) not in used]
                pick, how = (free[0], "scored" if partners else "first") if free else (None, "none")
            out[s] = (pick, how)
            if pick is not None:
                used.add(round(pick, 6))
        yield pd.DataFrame({"symbol": list(out), "value": [v for v, _ in out.values()], "how": [h for _, h in out.values()]})

    rows = known.select(F.col("symbol").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("long").alias("n"), F.col("value").cast("double").alias("value"))
    rows = rows.unionByName(pairs.select("a", "b", F.col("n").cast("long").alias("n"), F.lit(None).cast("double").alias("value")))
    return one_task(rows, 1_000_000, "fraction proposals").mapInPandas(run, "symbol string, value double, how string")


def rollup_matches(matches: DataFrame) -> DataFrame:
    """Per symbol of the matched windows: matches, sequences, mean distance and patterns."""
    each = matches.select("seq_id", "pattern", "distance", F.explode(F.array_distinct(F.split("word", "-"))).alias("sign"))
    return each.groupBy("sign").agg(F.count("*").alias("matches"), F.count_distinct("seq_id").alias("texts"), r6(F.avg("distance")).alias("mean_distance"), F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"))


def shadow_lexicon(matches: DataFrame, most: int = 1) -> DataFrame:
    """Best reading of every matched form, whether all its matches agree, and how many there are."""
    best = F.min(F.struct("distance", "pattern")).alias("m")
    return matches.groupBy("word").agg(best, F.count("*").alias("n"), (F.count_distinct("pattern") == 1).alias("consistent")).filter(F.col("m.distance") <= most).select("word", "m.pattern", "m.distance", "n", "consistent")


def site_spread(matches: DataFrame, sites: DataFrame) -> DataFrame:
    return matches.join(sites, "seq_id").groupBy("pattern", "site").agg(F.count("*").alias("n"))


def chance_model(n_windows: Column, pattern_length: Column, alphabet: int, n_patterns: int = 1) -> tuple[Column, Column]:
    """Expected exact matches of random grams, and the chance of at least one."""
    p = F.pow(F.lit(1.0 / alphabet), pattern_length)
    expected = n_windows * p * n_patterns
    return expected, 1 - F.exp(-expected)


def term_test(terms: DataFrame, substitutes: DataFrame) -> DataFrame:
    """Canonical against substituted spelling of terms, by weighted edit distance to the attested form.

    ``terms(term, canonical, attested)``; ``substitutes(symbol, value)`` replaces
    syllables of the canonical form.
    """
    each = terms.select("term", "canonical", "attested", F.posexplode(F.split("canonical", "-")).alias("i", "symbol")).join(bounded(substitutes), "symbol", "left")
    spelt = each.groupBy("term", "canonical", "attested").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("value", "symbol").alias("v")))).alias("s"))
    rows = spelt.select("term", "canonical", "attested", F.array_join(F.transform("s", lambda x: x["v"]), "-").alias("substituted"))
    a, b = (F.bround(weighted_levenshtein(F.col(c), F.col("attested"))).cast("int") for c in ("canonical", "substituted"))
    return rows.select("term", "substituted", a.alias("before"), b.alias("after")).withColumn("verdict", F.when(F.col("after") < F.col("before"), "better").when(F.col("after") > F.col("before"), "worse").otherwise("same"))


def before_after(tokens: DataFrame, relabel: DataFrame) -> DataFrame:
    """Consistency of a corpus under its own values and under new ones (``relabel(symbol, value)``): share of CV syllables, bigram entropy, types."""
    rows = tokens.join(bounded(relabel), "symbol", "left").withColumn("after", F.coalesce("value", "translit"))

    def metrics(c, name):
        cv = F.avg(cv_label(F.col(c)).isin("V", "CV").cast("double"))
        one = rows.agg(r6(cv).alias("cv"), F.count_distinct(c).cast("double").alias("types"))
        two = grams(rows.drop("symbol").withColumnRenamed(c, "symbol") if c != "symbol" else rows, 2).groupBy("gram").agg(F.count("*").alias("n"))
        h = two.agg(r6(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("bigram_entropy"))
        return one.crossJoin(h).unpivot([], ["cv", "types", "bigram_entropy"], "metric", name)  # one row each

    return metrics("translit", "before").join(metrics("after", "after"), "metric").withColumn("change", r6(F.col("after") - F.col("before")))


def completion_score(tokens: DataFrame, values: DataFrame, hide: float = 0.2, seed: int = 1) -> DataFrame:
    """How well values (``symbol, value``) order a corpus: entropy of final vowels, held-out surprise of consonant steps, share of the top 3 beginnings."""
    rows = tokens.join(bounded(values), "symbol").withColumns({"c": onset(F.col("value")), "v": F.coalesce(vowel(F.col("value")), F.lit("-"))})
    step = neighbours(rows, 0, 1, ["c"])
    ends = step.filter("c_p1 is null").groupBy("v").agg(F.count("*").alias("n")).agg(r6(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("final_entropy"))
    flagged = step.filter("c_p1 is not null").withColumn("held", unit_draw(F.lit(str(seed)), F.col("seq_id")) < hide)
    seen = flagged.filter("not held").groupBy("c", "c_p1").agg(F.count("*").alias("n"))
    of = seen.groupBy("c").agg(F.sum("n").alias("t"))
    size = rows.agg(F.count_distinct("c").alias("k"))
    probe = flagged.filter("held").groupBy("c", "c_p1").agg(F.count("*").alias("m")).join(seen, ["c", "c_p1"], "left").join(of, "c", "left").crossJoin(F.broadcast(size))
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + F.col("k"))
    cross = probe.agg(r6(-F.sum(F.col("m") * F.log2(p)) / F.sum("m")).alias("held_out_bits"))
    first = rows.filter("pos = 0").groupBy("c").agg(F.count("*").alias("n"))
    top = first.select("n", F.row_number().over(W.orderBy(F.desc("n"), "c")).alias("r")).agg(r6(F.sum(F.when(F.col("r") <= 3, F.col("n"))) / F.sum("n")).alias("top3_share"))
    return ends.crossJoin(cross).crossJoin(top)  # one row each


def bootstrap(links: DataFrame, known: DataFrame, start: float = 0.60, step: float = 0.05, floor: float = 0.45, most: int = 20) -> DataFrame:
    """Classes spread from known symbols over links to the fixpoint.

    In each cycle an open symbol takes the class that holds at least the threshold
    of its linked weight to known ones; the threshold falls by ``step`` per cycle
    down to ``floor``; it ends when a cycle at the floor accepts none.
    ``links(a, b, weight)`` both ways, ``known(symbol, cls)``. State is one row per
    symbol, written per cycle.
    """
    state = written(known.select("symbol", "cls", F.lit(0).alias("cycle")), "known")
    for i in range(1, most + 1):
        threshold = max(start - step * (i - 1), floor)
        votes = links.join(state.select(F.col("symbol").alias("b"), "cls"), "b").join(state.select(F.col("symbol").alias("a")), "a", "left_anti").groupBy("a", "cls").agg(F.sum("weight").alias("w"))
        total = votes.groupBy("a").agg(F.sum("w").alias("t"), F.max(F.struct("w", "cls")).alias("best"))
        new = written(total.filter(F.col("best.w") >= threshold * F.col("t")).select(F.col("a").alias("symbol"), "best.cls", F.lit(i).alias("cycle")), "accepted")
        if not new.limit(1).count():
            if threshold <= floor:
                break
            continue
        state = written(state.unionByName(new), "known")
    return state


def oracle_ablation(links: DataFrame, known: DataFrame, trials: int = 4, hide: float = 0.2, seed: int = 3) -> DataFrame:
    """Per trial: known symbols hidden by hash, how many the strongest link of one cycle restores, and the share that chance would."""
    t = known.sparkSession.range(trials).select(F.col("id").alias("trial"))
    rows = known.crossJoin(t).withColumn("hidden", unit_draw(F.lit(str(seed)), "trial", "symbol") < hide)  # alphabet x trials
    seen = rows.filter("not hidden").select("trial", F.col("symbol").alias("b"), "cls")
    votes = links.join(seen, "b").groupBy("trial", F.col("a").alias("symbol"), "cls").agg(F.sum("weight").alias("w"))
    best = votes.groupBy("trial", "symbol").agg(F.max(F.struct("w", "cls")).alias("m")).select("trial", "symbol", F.col("m.cls").alias("guess"))
    test = rows.filter("hidden").join(best, ["trial", "symbol"], "left")
    classes = known.agg(F.count_distinct("cls").alias("k"))
    right = F.count_if(F.coalesce(F.col("guess") == F.col("cls"), F.lit(False)))
    out = test.groupBy("trial").agg(F.count("*").alias("hidden"), right.alias("restored")).crossJoin(F.broadcast(classes))
    return out.select("trial", "hidden", "restored", r6(F.col("restored") / F.col("hidden")).alias("recovery"), r6(1 / F.col("k")).alias("chance"))


def random_completion(open_symbols: DataFrame, candidates: DataFrame, scored: Column, tries: int = 50, seed: int = 5, top: int = 5) -> DataFrame:
    """Consensus of the ``top`` best of many random completions.

    Every try draws one candidate per open symbol by hash; ``scored`` is a row's
    score over (symbol, candidate); ``candidates(candidate, idx)`` counts from 0.
    """
    n = candidates.count()
    t = open_symbols.sparkSession.range(tries).select(F.col("id").alias("try"))
    drawn = open_symbols.crossJoin(t).withColumn("idx", F.floor(unit_draw(F.lit(str(seed)), "try", "symbol") * n)).join(bounded(candidates), "idx")
    rows = drawn.withColumn("score", scored)
    best = rows.groupBy("try").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "try").limit(top)
    votes = rows.join(F.broadcast(best.select("try")), "try").groupBy("symbol", "candidate").agg(F.count("*").alias("votes"))
    return votes.groupBy("symbol").agg(F.max(F.struct("votes", "candidate")).alias("m")).select("symbol", "m.candidate", "m.votes")


def family_matches(tokens: DataFrame, entries: DataFrame, least_size: int = 3) -> DataFrame:
    """Per family of a word list: entries tried, windows that match exactly or by one token, distinct entries and texts that match.

    ``entries(family, pattern)``: of a family with any pattern of ``least_size``
    tokens only those are tried, else all. All families run in one plan.
    """
    long = F.size(F.split("pattern", "-")) >= least_size
    kept = entries.filter("family is not null and pattern is not null").distinct().withColumn("long", long)
    any_long = kept.groupBy("family").agg(F.max("long").alias("any_long"))
    kept = kept.join(bounded(any_long), "family").filter(F.col("long") | ~F.col("any_long")).select("family", "pattern")
    hits = window_levenshtein(tokens, kept.select("pattern")).join(bounded(kept), "pattern")
    found = hits.groupBy("family").agg(F.count_if(F.col("distance") == 0).alias("exact"), F.count_if(F.col("distance") == 1).alias("one_edit"), F.count_distinct("pattern").alias("matched"), F.count_distinct("seq_id").alias("texts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return kept.groupBy("family").agg(F.count("*").alias("entries")).join(found, "family", "left").select("family", "entries", *map(zero, ("exact", "one_edit", "matched", "texts")))


def deep_dive(matches: DataFrame, context: DataFrame, meaning: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` matches per pattern, enriched: plausibility of the meaning in its context, score and rank.

    ``context(seq_id, words array)``, ``meaning(pattern, words array)``.
    """
    m = matches.join(bounded(meaning.withColumnRenamed("words", "meant")), "pattern", "left").join(context.withColumnRenamed("words", "around"), "seq_id", "left")
    fits = plausibility(F.col("meant"), F.col("around"))
    score = match_score(F.size(F.split("word", "-")), F.col("distance"), fits >= 0.5)
    rows = m.select("pattern", "seq_id", "pos", "word", "distance", r6(fits).alias("plausibility"), score.alias("score"))
    rank = F.row_number().over(W.partitionBy("pattern").orderBy(F.desc("score"), F.desc("plausibility"), "seq_id", "pos"))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)


_FAMILIES = [("a", "ne-ri"), ("a", "da-da-ta"), ("b", "pa-ro"), ("b", "ku-ro"), ("c", "sa-ra-me"), ("c", "mu-re-zo-ri"), ("d", "xx-yy-zz")]


def _near_kinds(s, d):
    return all_tokens(s, d).groupBy("seq_id").agg(F.array_sort(F.collect_set("kind")).alias("words"))


def _dive(s, d):
    meaning = s.createDataFrame([("ku-ro", ["numeral", "fraction"]), ("pa-ro", ["logogram"]), ("ne-ri", None)], "pattern string, words array<string>")
    return deep_dive(window_levenshtein(syllables(s, d), _pat(s)), _near_kinds(s, d), meaning)


def _vlinks(s, d):
    return frame_links(syllables(s, d)).filter("side = 'V'")


def _both(s, d):
    f = frame_links(syllables(s, d), 3).filter("side = 'C'").select("a", "b", "weight")
    return f.unionByName(f.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def _classes(s, d):
    return table(s, d, "sign_list").filter("sign_type = 'syllabogram'").select(F.col("bennett_id").alias("symbol"), F.coalesce(vowel(F.col("transliteration")), F.lit("-")).alias("cls"))


def _values(s, d):
    return table(s, d, "sign_list").filter("sign_type = 'syllabogram'").select(F.col("bennett_id").alias("symbol"), F.col("transliteration").alias("value"))


def _sites(s, d):
    i = table(s, d, "inscriptions").groupBy(F.col("id").alias("seq_id")).agg(F.min("findspot_id").alias("k"))
    return i.join(table(s, d, "findspots").groupBy(F.col("id").alias("k")).agg(F.min("site").alias("site")), "k").select("seq_id", "site")


def _chance(s, d):
    n = grams(syllables(s, d), 2).agg(F.count("*").alias("windows"))
    e, p = chance_model(F.col("windows"), F.lit(2), 75, len(_PATTERNS))
    return n.select("windows", r6(e).alias("expected"), r6(p).alias("at_least_one"))


def _terms(s, d):
    t = s.createDataFrame([("total", "ku-ro", "ki-ro"), ("whole", "po-to-ku-ro", "pa-ta-ku-ro"), ("place", "pa-i-to", "pa-i-to")], "term string, canonical string, attested string")
    return term_test(t, s.createDataFrame([("ku", "ki"), ("to", "ta")], "symbol string, value string"))


def _fractions(s, d):
    known = table(s, d, "sign_list").filter("sign_type = 'fraction'").select(F.col("bennett_id").alias("symbol"), fraction_value(F.col("transliteration")).alias("value"))
    c = cooccurrence(all_tokens(s, d).filter("kind = 'fraction'")).filter("a < b")
    return propose_fractions(known, c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")))


QUERIES = {
    "link_cohesion": lambda s, d: link_cohesion(syllables(s, d), _vlinks(s, d)),
    "fraction_whole_numbers": lambda s, d: fraction_pairs(all_tokens(s, d)),
    "fraction_proposals": _fractions,
    "match_rollup": lambda s, d: rollup_matches(window_levenshtein(syllables(s, d), _pat(s))),
    "shadow_lexicon": lambda s, d: shadow_lexicon(window_levenshtein(syllables(s, d), _pat(s))),
    "match_sites": lambda s, d: site_spread(window_levenshtein(syllables(s, d), _pat(s)), _sites(s, d)),
    "chance_model": _chance,
    "family_matches": lambda s, d: family_matches(syllables(s, d), s.createDataFrame(_FAMILIES, "family string, pattern string")),
    "deep_dive": _dive,
    "term_tests": _terms,
    "before_after": lambda s, d: before_after(syllables(s, d), s.createDataFrame([("AB 73", "xa"), ("AB 14", "strem")], "symbol string, value string")),
    "completion_score": lambda s, d: completion_score(syllables(s, d), _values(s, d)),
    "bootstrap_fixpoint": lambda s, d: bootstrap(_both(s, d), _classes(s, d).filter("symbol < 'AB 30'")),
    "oracle_ablation": lambda s, d: oracle_ablation(_both(s, d), _classes(s, d)),
    "random_completion": lambda s, d: random_completion(_classes(s, d).select("symbol"), s.createDataFrame([(i, v) for i, v in enumerate("aeiou")], "idx long, candidate string"), F.length(F.concat("symbol", "candidate")) + F.when(F.col("candidate") == "a", 1).otherwise(0)),
}

from .matching import _LINKS, _VAL, _WIN  # noqa: E402

SQL = {
    "link_cohesion": TOKENS_SQL
    + _LINKS
    + """, li AS (SELECT DISTINCT a, b FROM lk WHERE side = 'V' AND shared >= 3), pr AS (SELECT least(symbol, nx) AS a, greatest(symbol, nx) AS b, count(*) AS n FROM (SELECT symbol, lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM syl) WHERE nx IS NOT NULL AND symbol <> nx GROUP BY ALL),
o AS (SELECT symbol, count(*) AS c FROM syl GROUP BY symbol), w AS (SELECT coalesce(sum(x.c * y.c * 2), 0) AS w FROM li JOIN o x ON x.symbol = a JOIN o y ON y.symbol = b), t AS (SELECT sum(c) AS t, sum(c * c) AS t2 FROM o),
sn AS (SELECT sum(n) AS pairs, coalesce(sum(n) FILTER ((a, b) IN (SELECT (a, b) FROM li)), 0) AS linked FROM pr)
SELECT CAST(pairs AS BIGINT) AS pairs, CAST(linked AS BIGINT) AS linked, round(linked / pairs, 6) AS observed, round(w / (t * t - t2), 6) AS expected FROM sn, w, t""",
    "fraction_whole_numbers": TOKENS_SQL
    + "SELECT symbol, count(*) AS n, round(avg(CAST(regexp_extract(pm, '(\\d+)', 1) AS BIGINT)), 6) AS mean_whole FROM (SELECT symbol, kind, lag(symbol) OVER w AS pm, lag(kind) OVER w AS pk FROM tok WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE kind = 'fraction' AND pk = 'numeral' GROUP BY symbol",
    "match_rollup": _WIN
    + ", e AS (SELECT seq_id, pattern, distance, unnest(list_distinct(string_split(word, '-'))) AS sign FROM hit) SELECT sign, count(*) AS matches, count(DISTINCT seq_id) AS texts, round(avg(distance), 6) AS mean_distance, string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS patterns FROM e GROUP BY sign",
    "shadow_lexicon": _WIN + "SELECT word, min((distance, pattern))[2] AS pattern, min(distance) AS distance, count(*) AS n, count(DISTINCT pattern) = 1 AS consistent FROM hit GROUP BY word",
    "match_sites": _WIN
    + ", i AS (SELECT id AS seq_id, min(findspot_id) AS k FROM inscriptions GROUP BY id), f AS (SELECT id AS k, min(site) AS site FROM findspots GROUP BY id) SELECT pattern, site, count(*) AS n FROM hit JOIN i USING (seq_id) JOIN f USING (k) GROUP BY ALL",
    "chance_model": TOKENS_SQL
    + f", w AS (SELECT count(*) AS windows FROM (SELECT lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM syl) WHERE nx IS NOT NULL) SELECT windows, round(windows * pow(1.0 / 75, 2) * {len(_PATTERNS)}, 6) AS expected, round(1 - exp(-(windows * pow(1.0 / 75, 2) * {len(_PATTERNS)})), 6) AS at_least_one FROM w",
    "oracle_ablation": TOKENS_SQL
    + _LINKS
    + """, l AS (SELECT a, b, weight FROM lk WHERE side = 'C' AND shared >= 3 UNION ALL SELECT b, a, weight FROM lk WHERE side = 'C' AND shared >= 3),
kn AS (SELECT bennett_id AS symbol, coalesce(nullif(regexp_extract(lower(transliteration), '([aeiou])', 1), ''), '-') AS cls FROM sign_list WHERE sign_type = 'syllabogram'),
r AS (SELECT *, CAST('0x' || substr(md5('3|' || trial || '|' || symbol), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < 0.2 AS hid FROM kn, range(4) t(trial)),
v AS (SELECT trial, l.a AS symbol, cls, sum(weight) AS w FROM l JOIN r ON r.symbol = l.b WHERE NOT hid GROUP BY ALL), b AS (SELECT trial, symbol, cls AS guess FROM v QUALIFY row_number() OVER (PARTITION BY trial, symbol ORDER BY w DESC, cls DESC) = 1)
SELECT r.trial, count(*) AS hidden, count(*) FILTER (guess = cls) AS restored, round(count(*) FILTER (guess = cls) / count(*), 6) AS recovery, round(1 / (SELECT count(DISTINCT cls) FROM kn), 6) AS chance FROM r LEFT JOIN b USING (trial, symbol) WHERE hid GROUP BY r.trial""",
    "before_after": TOKENS_SQL
    + ", b AS (SELECT seq_id, pos, translit AS v, symbol FROM syl), a AS (SELECT seq_id, pos, CASE symbol WHEN 'AB 73' THEN 'xa' WHEN 'AB 14' THEN 'strem' ELSE v END AS v FROM b)"
    + "".join(
        f", {x}q AS (SELECT v, regexp_replace(translate(regexp_replace(lower(v), '[^\\p{{L}}]', '', 'g'), 'aeiou', 'VVVVV'), '[^V]', 'C', 'g') AS q, v || '|' || lead(v) OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM {x}), {x}g AS (SELECT g, count(*) AS n FROM {x}q WHERE g IS NOT NULL GROUP BY g),"
        f" {x}m AS (SELECT 'cv' AS metric, round(avg(CASE WHEN q <> '' THEN CAST(q IN ('V', 'CV') AS INT) END), 6) AS x FROM {x}q UNION ALL SELECT 'types', count(DISTINCT v) FROM {x}q UNION ALL SELECT 'bigram_entropy', round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) FROM {x}g)"
        for x in "ba"
    )
    + " SELECT metric, bm.x AS before, am.x AS after, round(am.x - bm.x, 6) AS change FROM bm JOIN am USING (metric)",
    "completion_score": TOKENS_SQL
    + """, r AS (SELECT seq_id, pos, regexp_extract(lower(transliteration), '^([^aeiou\\d]*)', 1) AS c, coalesce(nullif(regexp_extract(lower(transliteration), '([aeiou])', 1), ''), '-') AS v FROM syl JOIN sign_list ON bennett_id = symbol AND sign_type = 'syllabogram'),
st AS (SELECT *, lead(c) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM r), fe AS (SELECT count(*) AS n FROM st WHERE nx IS NULL GROUP BY v),
fg AS (SELECT c, nx, CAST('0x' || substr(md5('1|' || seq_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < 0.2 AS held FROM st WHERE nx IS NOT NULL),
sn AS (SELECT c, nx, count(*) AS n FROM fg WHERE NOT held GROUP BY ALL), sc AS (SELECT c, sum(n) AS t FROM sn GROUP BY c), pb AS (SELECT c, nx, count(*) AS m FROM fg WHERE held GROUP BY ALL),
tp AS (SELECT n, row_number() OVER (ORDER BY n DESC, c) AS k FROM (SELECT c, count(*) AS n FROM r WHERE pos = 0 GROUP BY c))
SELECT (SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) FROM fe) AS final_entropy, (SELECT round(-sum(m * log2((coalesce(n, 0) + 1) / (coalesce(t, 0) + (SELECT count(DISTINCT c) FROM r)))) / sum(m), 6) FROM pb LEFT JOIN sn USING (c, nx) LEFT JOIN sc USING (c)) AS held_out_bits,
(SELECT round(sum(n) FILTER (k <= 3) / sum(n), 6) FROM tp) AS top3_share""",
    "bootstrap_fixpoint": TOKENS_SQL
    + _LINKS
    + ", l AS (SELECT a, b, weight FROM lk WHERE side = 'C' AND shared >= 3 UNION ALL SELECT b, a, weight FROM lk WHERE side = 'C' AND shared >= 3), s0 AS MATERIALIZED (SELECT bennett_id AS symbol, coalesce(nullif(regexp_extract(lower(transliteration), '([aeiou])', 1), ''), '-') AS cls, 0 AS cycle FROM sign_list WHERE sign_type = 'syllabogram' AND bennett_id < 'AB 30')"
    + "".join(
        f", s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT a, cls, {i} FROM (SELECT a, cls, w, sum(w) OVER (PARTITION BY a) AS t FROM (SELECT l.a, s.cls, sum(weight) AS w FROM l JOIN s{i - 1} s ON s.symbol = l.b WHERE l.a NOT IN (SELECT symbol FROM s{i - 1}) GROUP BY ALL)"
        f" QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, cls DESC) = 1) WHERE w >= {max(0.60 - 0.05 * (i - 1), 0.45)!r}::DOUBLE * t)"
        for i in range(1, 21)
    )
    + " SELECT symbol, cls, CAST(cycle AS INT) AS cycle FROM s20",
    "random_completion": """WITH o AS (SELECT bennett_id AS symbol FROM sign_list WHERE sign_type = 'syllabogram'), d AS (SELECT symbol, t, ['a', 'e', 'i', 'o', 'u'][CAST(floor(CAST('0x' || substr(md5('5|' || t || '|' || symbol), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * 5) AS INT) + 1] AS candidate FROM o, range(50) r(t)),
b AS (SELECT t FROM (SELECT t, sum(length(symbol || candidate) + CASE WHEN candidate = 'a' THEN 1 ELSE 0 END) AS total FROM d GROUP BY t) ORDER BY total DESC, t LIMIT 5), v AS (SELECT symbol, candidate, count(*) AS votes FROM d WHERE t IN (SELECT t FROM b) GROUP BY ALL)
SELECT symbol, candidate, votes FROM v QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY votes DESC, candidate DESC) = 1""",
    "family_matches": _WIN.replace(_VAL, ", ".join(f"('{p}')" for _, p in _FAMILIES if p != "ne-ri"))
    + f", fa(family, pattern) AS (VALUES {', '.join(f'{x!r}' for x in _FAMILIES if x != ('a', 'ne-ri'))})"
    + " SELECT family, count(DISTINCT fa.pattern) AS entries, count(*) FILTER (distance = 0) AS exact, count(*) FILTER (distance = 1) AS one_edit, count(DISTINCT hit.pattern) AS matched, count(DISTINCT seq_id) AS texts FROM fa LEFT JOIN hit USING (pattern) GROUP BY family",
    "deep_dive": _WIN
    + """, cx AS (SELECT seq_id, list(DISTINCT kind) AS ws FROM tok GROUP BY seq_id), mn(pattern, ms) AS (VALUES ('ku-ro', ['numeral', 'fraction']), ('pa-ro', ['logogram']), ('ne-ri', NULL)),
z AS (SELECT hit.*, coalesce(len(list_intersect(ms, ws)) / len(ws), 0.5) AS fit, len(string_split(word, '-')) AS k FROM hit JOIN cx USING (seq_id) LEFT JOIN mn USING (pattern)),
y AS (SELECT pattern, seq_id, pos, word, distance, round(fit, 6) AS plausibility, CAST(greatest(0, least(100, least(60, 15 * k) - 20 * distance + CASE WHEN fit >= 0.5 THEN 20 ELSE 0 END)) AS INT) AS score FROM z)
SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY score DESC, plausibility DESC, seq_id, pos) AS rank FROM y QUALIFY rank <= 5""",
}
