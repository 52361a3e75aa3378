"""Combining evidence into scores and decisions; every rule is a column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clamp, round_product, rounded_mean
from ..functions.text import code_number
from ..sequences import CLEAN_SQL, TOKENS_SQL
from ..tables import clean_code, table

# Weights of the five transfer signals and of the two-hypothesis comparison.
TRANSFER = {"visual": 0.35, "positional": 0.20, "frequency": 0.10, "toponym": 0.25, "ngram": 0.10}
CONFLICT = (0.35, 0.20, 0.25, 0.20)


def weighted(scores: dict[str, tuple[Column, float]], neutral: float | None = None) -> Column:
    """Weighted mean over the scores that are not null; or, with ``neutral``, over all with that in their place."""
    if neutral is not None:
        return sum(F.coalesce(c, F.lit(neutral)) * w for c, w in scores.values()) / sum(w for _, w in scores.values())
    top = sum(F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in scores.values())
    return F.try_divide(top, sum(F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in scores.values()))


def steps(value: Column, bands: list[tuple[float, float]], below: float) -> Column:
    """A step function: the first band whose lower bound the value reaches."""
    out = F.lit(below)
    for bound, score in sorted(bands):
        out = F.when(value >= bound, F.lit(score)).otherwise(out)
    return F.when(value.isNotNull(), out)


def rules_fired(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, joined by '; '."""
    return F.concat_ws("; ", *(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))


def severity(rules: dict[str, Column]) -> Column:
    n = sum(F.coalesce(c, F.lit(False)).cast("int") for c in rules.values())
    return F.when(n >= 3, "high").when(n == 2, "medium").when(n == 1, "low").otherwise("none")


def decide(support: Column, against: Column, override: Column | None = None, confirm: float = 0.7, revise: float = 0.5) -> Column:
    """CONFIRM, REVISE or UNCERTAIN; an override wins."""
    rule = F.when((support >= confirm) & (F.coalesce(against, F.lit(0.0)) < revise), "CONFIRM").when(against >= revise, "REVISE").otherwise("UNCERTAIN")
    return F.coalesce(override, rule) if override is not None else rule


def agreement(a: Column, b: Column) -> Column:
    """True, False, or null where either is unknown."""
    return F.when(a.isNotNull() & b.isNotNull(), a == b)


def triangulate(agreements: list[Column]) -> tuple[Column, Column]:
    """How many agree (0 for none known), and whether some agree while others do not."""
    yes = sum(F.coalesce(c, F.lit(False)).cast("int") for c in agreements)
    no = sum(F.coalesce(~c, F.lit(False)).cast("int") for c in agreements)
    return yes, (yes > 0) & (no > 0)


def resolve(first: list[Column], second: list[Column], weights=CONFLICT, cap: float = 0.95) -> tuple[Column, Column]:
    """The better of two hypotheses by weighted scores, and a confidence that grows with the margin up to ``cap``."""
    a, b = (sum(c * w for c, w in zip(x, weights, strict=True)) for x in (first, second))
    winner = F.when(a > b, "first").when(b > a, "second").otherwise("tie")
    return winner, F.least(F.lit(cap), 0.5 + F.abs(a - b))


def reweigh(base: Column, favoured: Column, disfavoured: Column) -> Column:
    """A prior doubled or halved, at most 100."""
    return F.least(F.lit(100.0), base * F.when(favoured, 2.0).when(disfavoured, 0.5).otherwise(1.0))


def compose(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """A -> B -> C with the weaker of the two confidences (rank 1 HIGH .. 3 LOW); of repeated links the best."""
    best = lambda df: df.groupBy("src", "dst").agg(F.min("rank").alias("rank"))
    x = best(ab).select("src", F.col("dst").alias("via"), F.col("rank").alias("r1"))
    y = best(bc).select(F.col("src").alias("via"), "dst", F.col("rank").alias("r2"))
    return x.join(y, "via").select("src", "via", "dst", F.greatest("r1", "r2").alias("rank"))


def evidence_table(driver: DataFrame, key: str, tables: list[DataFrame]) -> DataFrame:
    """Left joins of keyed tables to the driver, whose rows decide."""
    return reduce(lambda a, b: a.join(b, key, "left"), tables, driver)


def narrowed(allowed: Column, by: Column) -> Column:
    """The intersection, or what was allowed if it would be empty."""
    both = F.array_intersect(allowed, by)
    return F.when(F.size(both) > 0, both).otherwise(allowed)


def verdict(criteria: list[Column]) -> Column:
    n = sum(F.coalesce(c, F.lit(False)).cast("int") for c in criteria)
    return F.when(n >= 4, "SUPPORTED").when(n >= 3, "POSSIBLE").when(n >= 1, "WEAK").otherwise("FALSIFIED")


def rank_score(verdict_: Column) -> Column:
    return F.when(verdict_ == "SUPPORTED", 2.0).when(verdict_ == "POSSIBLE", 1.0).when(verdict_ == "WEAK", 0.5).otherwise(0.0)


def reverse_lookup(values: DataFrame) -> DataFrame:
    """``value, ids, n``: all symbols with a value (``values(symbol, value)``; the dictionary, not the corpus)."""
    rows = values.filter("symbol is not null and value is not null").distinct()
    return rows.groupBy("value").agg(F.array_join(F.array_sort(F.collect_set("symbol")), " ").alias("ids"), F.count("*").alias("n"))


def anchor_score(length: Column, distance: Column, texts: Column, sites: Column, certain: Column, initial: Column, known: Column) -> Column:
    """Seven additive factors of a place-name anchor, 0..100."""
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return clamp(F.least(10 * length, F.lit(40)) - 15 * distance + F.least(5 * texts, F.lit(20)) + F.least(5 * sites, F.lit(15)) + yes(certain, 10) + yes(initial, 5) + yes(known, 10), 0, 100)


def plausibility(meaning: Column, context: Column) -> Column:
    """Share of a match's context words that belong to its meaning's field; half where either is unknown."""
    both = F.try_divide(F.size(F.array_intersect(meaning, context)), F.size(context))
    return F.coalesce(both.cast("double"), F.lit(0.5))


def feature_table(stats: DataFrame, rules: dict[str, list[tuple[str, str]]], default: str = "unknown") -> DataFrame:
    """``feature, value``: for each feature the first of its (condition, value) rules that a row of statistics meets."""
    out = []
    for feature, cases in rules.items():
        v = F.coalesce(*(F.when(F.expr(c), F.lit(x)) for c, x in cases), F.lit(default))
        out.append(F.struct(F.lit(feature).alias("feature"), v.alias("value")))
    return stats.select(F.explode(F.array(*out)).alias("f")).select("f.*")


def confidence(streams: dict[str, tuple[Column, float]], divergence: Column, anomalous: Column, disruption: Column) -> Column:
    """0..100: weighted mean of the known streams above 0, less penalties; 0 without any stream.

    A divergence over 1 costs ten times itself, at most 30, an anomalous symbol at
    least 20; a disruption over 0.4 costs a hundred times the excess, at most 25.
    """
    mean = weighted({k: (F.when(c > 0, c), w) for k, (c, w) in streams.items()})
    zero = F.lit(0.0)
    place = F.greatest(F.when(divergence > 1, F.least(10 * divergence, F.lit(30.0))).otherwise(zero), F.when(F.coalesce(anomalous, F.lit(False)), 20.0).otherwise(zero))
    order = F.when(disruption > 0.4, F.least((disruption - 0.4) * 100, F.lit(25.0))).otherwise(zero)
    return F.coalesce(clamp(mean - place - order, 0.0, 100.0), zero)


def decide_value(current: Column, sources: list[tuple[str, Column]], leading: str, sure: Column, anomalous: Column, score: Column, bar: float = 50.0) -> tuple[Column, Column]:
    """A decision on a symbol's value, and the best guess.

    ``sources`` are named proposals in order of trust, the first two being ``leading``
    and its second. All agreeing with ``current`` (or with none known) CONFIRM it;
    two or more agreeing on another REVISE; a lone one CONFIRMs if it is the leading
    source, else REVISEs; disagreement is UNCERTAIN and the vote, ties by trust, gives
    the guess. Later rules win: the first two agreeing REVISE or CONFIRM if ``sure``,
    CONFIRM a value that is current otherwise, and disagreeing while ``sure`` leave it
    UNCERTAIN; an anomalous symbol on which they agree against ``current`` is REVISEd;
    an unknown symbol with one source and a score below ``bar`` stays UNCERTAIN.
    """
    now = F.coalesce(current, F.lit("?"))
    named = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("n"), c.alias("v"))) for n, c in sources)))
    values = F.transform(named, lambda x: x["v"])
    kinds, k = F.size(F.array_distinct(values)), F.size(values)
    first = F.get(values, F.lit(0))
    votes = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-F.array_position(values, v)).alias("at"), v.alias("v")))
    voted = F.array_max(votes)["v"]
    decision = (
        F.when(kinds == 0, "UNCERTAIN").when(kinds > 1, "UNCERTAIN").when((first == now) | (now == "?"), "CONFIRM").when(k >= 2, "REVISE")
        .otherwise(F.when(F.get(named, F.lit(0))["n"] == leading, "CONFIRM").otherwise("REVISE"))
    )
    guess = F.when(kinds == 0, now).when(kinds == 1, first).otherwise(voted)
    x, y = sources[0][1], sources[1][1]
    both, sure, odd = x.isNotNull() & y.isNotNull(), F.coalesce(sure, F.lit(False)), F.coalesce(anomalous, F.lit(False))
    agree, clash = both & (x == y), both & (x != y)
    decision = F.when(agree & sure & (x != now) & (now != "?"), "REVISE").when(agree & sure, "CONFIRM").when(agree & ((x == now) | (now == "?")), "CONFIRM").when(clash & sure, "UNCERTAIN").otherwise(decision)
    guess = F.when(agree & (sure | (x == now) | (now == "?")), x).otherwise(guess)
    moved = odd & agree & (x != now) & (now != "?")
    decision, guess = F.when(moved, "REVISE").otherwise(decision), F.when(moved, x).otherwise(guess)
    return F.when((now == "?") & (decision == "CONFIRM") & (k <= 1) & (score < bar), "UNCERTAIN").otherwise(decision), guess


def misalignment(final: Column, initial: Column, shared: Column, neighbours: Column, expected: Column, observed: Column, entropy: Column) -> dict[str, Column]:
    """Six signs that a borrowed value does not fit a symbol, as named rules."""
    return {
        "position": F.greatest(final, initial) > 0.6, "no shared companions": shared == 0, "few companions": neighbours < 3,
        "too frequent": observed > 3 * expected, "too rare": observed * 3 < expected, "scattered": entropy > 1.5,
    }


def typology_stats(tokens: DataFrame, values: DataFrame) -> DataFrame:
    """One row of statistics for :data:`TYPOLOGY` (``values(symbol, value)`` of the sign list)."""
    from .ngrams import lexical_stats
    from .positional import fractions

    f = fractions(tokens).join(F.broadcast(values), "symbol", "left")  # the alphabet
    lone = F.coalesce(F.col("value").isin("a", "e", "i", "o", "u"), F.lit(False))
    prof = f.agg(
        F.count_if(F.col("final") > 0.3).alias("final_biased"), F.count_if(F.col("initial") > 0.3).alias("initial_biased"), F.count_if(F.col("bias") == "flexible").alias("flexible"),
        F.count_if(F.col("final") > 0.25).alias("suffix_like"), F.count_if((F.col("initial") >= 0.5) & (F.col("total") >= 5)).alias("prefixes"), F.count_if((F.col("final") >= 0.5) & (F.col("total") >= 5)).alias("suffixes"),
        F.count_if(lone).alias("vowels"), F.count_if(lone & (F.col("initial") > 0.3)).alias("leading_vowels"), F.count_if(lone & (F.col("initial") > 0.4)).alias("articles"),
    )
    from ..sequences import neighbours

    step = neighbours(tokens, 0, 1, ["symbol"]).filter("symbol_p1 is not null").groupBy("symbol", "symbol_p1").agg(F.count("*").alias("n"))
    named = step.join(F.broadcast(values.select("symbol", F.col("value").alias("v1"))), "symbol").join(F.broadcast(values.select(F.col("symbol").alias("symbol_p1"), F.col("value").alias("v2"))), "symbol_p1")
    has = lambda c, x: F.lower(c).contains(x)
    nt = (has(F.col("v1"), "n") & has(F.col("v2"), "t")) | (has(F.col("v1"), "t") & has(F.col("v2"), "n"))
    pairs = named.agg(F.count_if((F.col("symbol") == F.col("symbol_p1")) & (F.col("n") >= 2)).alias("doubled"), F.count_if(nt & (F.col("n") > 3)).alias("nt_pairs"))
    return lexical_stats(tokens).crossJoin(prof).crossJoin(pairs)  # one row each


#: Features of a language that statistics of its signs suggest; the last rule of each always holds.
TYPOLOGY = {
    "word order": [("(final_biased + 1) / (initial_biased + 1) > 1.5", "SOV"), ("(final_biased + 1) / (initial_biased + 1) < 0.7", "VSO"), ("true", "uncertain")],
    "adpositions": [("suffixes > prefixes and suffixes >= 2", "postpositions"), ("prefixes > suffixes", "prepositions"), ("true", "uncertain")],
    "gender": [("leading_vowels >= 2", "possible"), ("true", "no evidence")],
    "case": [("final_biased >= 5", "possible"), ("true", "limited")],
    "agglutination": [("max_len >= 6 and doubled >= 3", "possible"), ("max_len >= 6", "limited"), ("true", "no evidence")],
    "ergativity": [("flexible >= 5", "possible"), ("true", "no evidence")],
    "vowel harmony": [("true", "cannot be told")],
    "root system": [("true", "limited")],
    "participle": [("nt_pairs > 0", "possible"), ("true", "no evidence")],
    "definite article": [("articles > 0", "possible"), ("true", "no evidence")],
    "substrate suffixes": [("suffix_like > 0", "present"), ("true", "none")],
    "place-name suffixes": [("true", "attested")],
    "morphological type": [("entropy > 5.5 and repeat_rate < 0.05", "agglutinative-like"), ("entropy > 4.5", "mixed"), ("true", "uncertain")],
    "construct state": [("true", "cannot be told")],
    "conjugation": [("prefixes >= 3", "possible"), ("true", "uncertain")],
    "voice": [("true", "cannot be told")],
    "plural formation": [("true", "cannot be told")],
    "vowel system": [("vowels >= 4", "full"), ("vowels > 0", "partial"), ("true", "uncertain")],
    "inventory": [("types < 40", "small"), ("types < 90", "syllabary"), ("true", "large")],
    "concentration": [("top1_share > 0.2", "high"), ("top1_share > 0.05", "middle"), ("true", "low")],
}


def _signs(s, d):
    """Per symbol of the sign list: records, texts, mean confidence, share of doubtful spellings, and its value."""
    rows = table(s, d, "signs").filter("bennett_id is not null").select(clean_code(F.col("bennett_id")).alias("symbol"), "inscription_id", "confidence", "transliteration")
    doubt = (F.col("transliteration").isNull() | F.col("transliteration").contains("?")).cast("double")
    n = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("inscription_id").alias("texts"), rounded_mean(F.col("confidence")).alias("conf"), round_product(F.avg(doubt), 6).alias("doubt"))
    known = table(s, d, "sign_list").select(F.col("bennett_id").alias("symbol"), F.col("sign_type").alias("kind"), F.col("transliteration").alias("value"), F.col("linear_b_character").isNotNull().alias("lb"), code_number(F.col("bennett_id")).alias("num"))
    return evidence_table(known, "symbol", [n])


def _c(n):
    return F.col(n)


def _transfer(s, d):
    sig = {
        "visual": F.when(_c("lb"), 90.0), "positional": steps(_c("texts").cast("double"), [(10, 40), (50, 70), (200, 90)], 10.0), "frequency": clamp(_c("n") / 100, 0, 100),
        "toponym": clamp(_c("conf") * 100, 0, 100), "ngram": (1 - _c("doubt")) * 100,
    }
    return _signs(s, d).select("symbol", F.round(weighted({k: (v, TRANSFER[k]) for k, v in sig.items()}, 50.0), 9).alias("score"), F.round(weighted({k: (v, TRANSFER[k]) for k, v in sig.items()}), 9).alias("known_only"))


_RULES = {"seldom": "n < 20", "doubtful": "doubt > 0.1", "unsure": "conf < 0.8"}


def _decisions(s, d):
    r = {k: F.expr(v) for k, v in _RULES.items()}
    over = F.when(_c("kind") == "metrical", "UNCERTAIN")
    return _signs(s, d).select("symbol", rules_fired(r).alias("rules"), severity(r).alias("severity"), decide(_c("conf"), _c("doubt") * 5, over).alias("decision"))


def _triangulation(s, d):
    yes, conflict = triangulate([agreement(_c("lb"), _c("texts") >= 100), agreement(_c("conf") > 0.85, _c("doubt") < 0.06), agreement(_c("num") < 60, _c("n") > 100)])
    v = verdict([_c("lb"), _c("texts") >= 100, _c("conf") > 0.85, _c("doubt") < 0.06])
    return _signs(s, d).select("symbol", yes.alias("convergence"), conflict.alias("conflict"), v.alias("verdict"), rank_score(v).alias("rank"))


def _conflicts(s, d):
    df = _signs(s, d).filter("n is not null")
    a = [_c("conf"), 1 - _c("doubt"), clamp(_c("texts") / 500, 0, 1), F.lit(0.5)]
    b = [F.when(_c("lb"), 0.9).otherwise(0.2), clamp(_c("n") / 1000, 0, 1), F.lit(0.4), _c("doubt") * 2]
    w, conf = resolve(a, b)
    return df.select("symbol", w.alias("winner"), round_product(conf, 5).alias("confidence"), round_product(reweigh(_c("conf") * 60, _c("lb"), _c("doubt") > 0.08), 6).alias("prior"))


def _refined(s, d):
    """Every symbol's value decided from the sign list, its usual spelling and the spelling of its like in the other script."""
    rows = table(s, d, "signs").filter("bennett_id is not null and transliteration <> ''").select(clean_code(F.col("bennett_id")).alias("symbol"), F.col("transliteration").alias("v"))
    usual = rows.groupBy("symbol", "v").agg(F.count("*").alias("k")).groupBy("symbol").agg(F.max(F.struct("k", "v")).alias("m"), F.sum("k").alias("t"))
    df = evidence_table(_signs(s, d), "symbol", [usual.select("symbol", F.col("m.v").alias("usual"), F.round(F.col("m.k") / F.col("t"), 6).alias("share"))])
    score = F.round(confidence({"transfer": (F.when(_c("lb"), 80.0), 2.0), "spelling": (_c("share") * 100, 1.5), "records": (_c("conf") * 100, 1.5)}, _c("doubt") * 12, _c("doubt") > 0.1, 1 - _c("share")), 5)
    odd = _c("doubt") > 0.1
    decision, guess = decide_value(_c("value"), [("LB", F.when(_c("lb"), _c("value"))), ("CM", F.when(_c("share") > 0.5, _c("usual"))), ("GC", F.when(_c("conf") > 0.85, F.lower("usual")))], "LB", _c("share") > 0.9, odd, score)
    return df.select("symbol", score.alias("score"), decision.alias("decision"), guess.alias("guess"))


def _misaligned(s, d):
    """The six rules on every syllabogram: places, companions shared with others of its consonant, frequency."""
    from ..functions.text import onset
    from ..sequences import neighbours, syllables
    from .positional import fractions

    t = syllables(s, d)
    c = _values(s, d).select("symbol", onset(F.col("value")).alias("c"))
    step = neighbours(t, 0, 1, ["symbol"]).filter("symbol_p1 is not null").select("symbol", F.col("symbol_p1").alias("next")).distinct().join(F.broadcast(c), "symbol")
    fans = step.groupBy("c", "next").agg(F.count("*").alias("fans"))
    near = step.join(fans, ["c", "next"]).groupBy("symbol").agg(F.count("*").alias("neighbours"), F.count_if(F.col("fans") > 1).alias("shared"))
    f = fractions(t)
    mean = f.agg(F.avg("total").alias("expected"))
    df = f.join(near, "symbol", "left").crossJoin(F.broadcast(mean)).fillna(0, ["neighbours", "shared"])  # one row
    r = misalignment(_c("final"), _c("initial"), _c("shared"), _c("neighbours"), _c("expected"), _c("total"), _c("entropy"))
    return df.select("symbol", rules_fired(r).alias("rules"), severity(r).alias("severity"))


def _values(s, d):
    return table(s, d, "sign_list").select(F.col("bennett_id").alias("symbol"), F.col("transliteration").alias("value"))


def _features(s, d):
    from ..sequences import syllables

    return feature_table(typology_stats(syllables(s, d), _values(s, d)), TYPOLOGY)


QUERIES = {
    "reverse_lookup": lambda s, d: reverse_lookup(table(s, d, "sign_list").select(F.col("bennett_id").alias("symbol"), F.col("sign_type").alias("value"))),
    "typology_features": _features,
    "anchor_scores": lambda s, d: _signs(s, d).select("symbol", F.round(anchor_score(F.length("value"), F.lit(1), F.coalesce("texts", F.lit(0)), F.lit(1), F.col("conf") > 0.85, F.col("num") == 1, F.col("lb")), 3).alias("score")),
    "weighted_evidence": _transfer,
    "decision_rules": _decisions,
    "triangulation": _triangulation,
    "conflict_resolution": _conflicts,
    "refined_values": _refined,
    "misalignment": _misaligned,
    "two_hop_links": lambda s, d: compose(
        table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_quantity") > 40, 1).when(F.col("l_quantity") > 20, 2).otherwise(3).alias("rank")),
        table(s, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.when(F.col("s_acctbal") > 5000, 1).otherwise(2).alias("rank")),
    ),
}

_CU = f"WITH g AS (SELECT {CLEAN_SQL} AS symbol, inscription_id, confidence, transliteration FROM signs WHERE bennett_id IS NOT NULL), o AS (SELECT symbol, count(*) AS n, count(DISTINCT inscription_id) AS texts, round(avg(confidence), 6) AS conf, round(avg(CAST(transliteration IS NULL OR contains(transliteration, '?') AS INT)), 6) AS doubt FROM g GROUP BY 1), cu AS (SELECT bennett_id AS symbol, sign_type AS kind, transliteration AS value, linear_b_character IS NOT NULL AS lb, try_cast(regexp_extract(bennett_id, '(\\d+)', 1) AS INT) AS num, n, texts, conf, doubt FROM sign_list LEFT JOIN o ON o.symbol = bennett_id) "
_SIG = {
    "visual": "CASE WHEN lb THEN 90 END", "positional": "CASE WHEN texts IS NULL THEN NULL WHEN texts >= 200 THEN 90 WHEN texts >= 50 THEN 70 WHEN texts >= 10 THEN 40 ELSE 10 END",
    "frequency": "CASE WHEN n IS NOT NULL THEN least(greatest(n / 100, 0), 100) ELSE 0 END", "toponym": "CASE WHEN conf IS NOT NULL THEN least(greatest(conf * 100, 0), 100) ELSE 0 END", "ngram": "(1 - doubt) * 100",
}
_DBL = lambda x: f"CAST({x} AS DOUBLE)"
SQL = {
    "reverse_lookup": "SELECT sign_type AS value, string_agg(DISTINCT bennett_id, ' ' ORDER BY bennett_id) AS ids, count(DISTINCT bennett_id) AS n FROM sign_list WHERE sign_type IS NOT NULL GROUP BY 1",
    "anchor_scores": _CU
    + "SELECT symbol, CAST(round(least(greatest(least(10 * length(value), 40) - 15 + least(5 * coalesce(texts, 0), 20) + 5 + CASE WHEN conf > 0.85 THEN 10 ELSE 0 END + CASE WHEN num = 1 THEN 5 ELSE 0 END + CASE WHEN lb THEN 10 ELSE 0 END, 0), 100), 3) AS DOUBLE) AS score FROM cu",
    "weighted_evidence": _CU
    + "SELECT symbol, round("
    + " + ".join(f"coalesce({_DBL(_SIG[k])}, 50) * {_DBL(w)}" for k, w in TRANSFER.items())
    + ", 9) AS score, round(("
    + " + ".join(f"coalesce({_DBL(_SIG[k])} * {_DBL(w)}, 0)" for k, w in TRANSFER.items())
    + ") / ("
    + " + ".join(f"CASE WHEN ({_SIG[k]}) IS NOT NULL THEN {_DBL(w)} ELSE 0 END" for k, w in TRANSFER.items())
    + "), 9) AS known_only FROM cu",
    "decision_rules": _CU
    + """SELECT symbol, concat_ws('; ', CASE WHEN n < 20 THEN 'seldom' END, CASE WHEN doubt > 0.1 THEN 'doubtful' END, CASE WHEN conf < 0.8 THEN 'unsure' END) AS rules,
CASE coalesce(CAST(n < 20 AS INT), 0) + coalesce(CAST(doubt > 0.1 AS INT), 0) + coalesce(CAST(conf < 0.8 AS INT), 0) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS severity,
CASE WHEN kind = 'metrical' THEN 'UNCERTAIN' WHEN conf >= 0.7 AND coalesce(doubt * 5, 0) < 0.5 THEN 'CONFIRM' WHEN doubt * 5 >= 0.5 THEN 'REVISE' ELSE 'UNCERTAIN' END AS decision FROM cu""",
    "triangulation": _CU
    + """, g2 AS (SELECT *, lb = (texts >= 100) AS g1, (conf > 0.85) = (doubt < 0.06) AS g2, (num < 60) = (n > 100) AS g3,
coalesce(CAST(lb AS INT), 0) + coalesce(CAST(texts >= 100 AS INT), 0) + coalesce(CAST(conf > 0.85 AS INT), 0) + coalesce(CAST(doubt < 0.06 AS INT), 0) AS k FROM cu),
h AS (SELECT *, CAST(coalesce(CAST(g1 AS INT), 0) + coalesce(CAST(g2 AS INT), 0) + coalesce(CAST(g3 AS INT), 0) AS INT) AS convergence, coalesce(CAST(NOT g1 AS INT), 0) + coalesce(CAST(NOT g2 AS INT), 0) + coalesce(CAST(NOT g3 AS INT), 0) AS no FROM g2)
SELECT symbol, convergence, convergence > 0 AND no > 0 AS conflict, CASE WHEN k >= 4 THEN 'SUPPORTED' WHEN k >= 3 THEN 'POSSIBLE' WHEN k >= 1 THEN 'WEAK' ELSE 'FALSIFIED' END AS verdict,
CAST(CASE WHEN k >= 4 THEN 2 WHEN k >= 3 THEN 1 WHEN k >= 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS rank FROM h""",
    "conflict_resolution": _CU
    + """, z AS (SELECT *, conf * 0.35::DOUBLE + (1 - doubt) * 0.2::DOUBLE + least(greatest(texts / 500, 0), 1) * 0.25::DOUBLE + 0.5::DOUBLE * 0.2::DOUBLE AS a,
CASE WHEN lb THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END * 0.35::DOUBLE + least(greatest(n / 1000, 0), 1) * 0.2::DOUBLE + 0.4::DOUBLE * 0.25::DOUBLE + doubt * 2 * 0.2::DOUBLE AS b FROM cu WHERE n IS NOT NULL)
SELECT symbol, CASE WHEN a > b THEN 'first' WHEN b > a THEN 'second' ELSE 'tie' END AS winner, CASE WHEN a IS NULL OR b IS NULL THEN 0.95::DOUBLE ELSE round(least(0.95, 0.5 + abs(a - b)), 5) END AS confidence,
CASE WHEN conf IS NULL THEN 100 ELSE round(least(100, conf * 60 * CASE WHEN lb THEN 2.0::DOUBLE WHEN doubt > 0.08 THEN 0.5 ELSE 1 END), 6) END AS prior FROM z""",
    "refined_values": _CU
    + """, u0 AS (SELECT symbol, transliteration AS v, count(*) AS k FROM g WHERE transliteration <> '' GROUP BY ALL), u AS (SELECT symbol, v AS usual, round(k / sum(k) OVER (PARTITION BY symbol), 6) AS share, row_number() OVER (PARTITION BY symbol ORDER BY k DESC, v DESC) AS r FROM u0),
e AS (SELECT cu.*, usual, share FROM cu LEFT JOIN u ON u.symbol = cu.symbol AND r = 1),
s AS (SELECT *, CASE WHEN lb THEN value END AS x, CASE WHEN share > 0.5 THEN usual END AS y, CASE WHEN conf > 0.85 THEN lower(usual) END AS z, CASE WHEN lb THEN 2.0::DOUBLE ELSE 0 END AS w1, CASE WHEN share > 0 THEN 1.5::DOUBLE ELSE 0 END AS w2, CASE WHEN conf > 0 THEN 1.5::DOUBLE ELSE 0 END AS w3,
greatest(CASE WHEN doubt * 12 > 1 THEN least(doubt * 120, 30) ELSE 0 END, CASE WHEN doubt > 0.1 THEN 20 ELSE 0 END) AS p1, CASE WHEN 1 - share > 0.4 THEN least((1 - share - 0.4::DOUBLE) * 100, 25) ELSE 0 END AS p2, coalesce(value, '?') AS now FROM e),
t AS (SELECT *, round(CASE WHEN w1 + w2 + w3 > 0 THEN least(greatest((80 * w1 + coalesce(share, 0) * 100 * w2 + coalesce(conf, 0) * 100 * w3) / (w1 + w2 + w3) - p1 - p2, 0), 100) ELSE 0 END, 5) AS score, list_filter([x, y, z], lambda v: v IS NOT NULL) AS vs FROM s),
q AS (SELECT *, len(vs) AS k, len(list_distinct(vs)) AS kinds, x IS NOT NULL AND y IS NOT NULL AND x = y AS agree, x IS NOT NULL AND y IS NOT NULL AND x <> y AS clash, coalesce(share > 0.9, false) AS sure, coalesce(doubt > 0.1, false) AS odd,
CASE WHEN len(list_filter(vs, lambda v: v = vs[1])) >= len(list_filter(vs, lambda v: v <> vs[1])) OR vs[2] <> vs[3] THEN vs[1] ELSE vs[2] END AS voted FROM t),
d1 AS (SELECT *, CASE WHEN agree AND sure AND x <> now AND now <> '?' THEN 'REVISE' WHEN agree AND sure THEN 'CONFIRM' WHEN agree AND (x = now OR now = '?') THEN 'CONFIRM' WHEN clash AND sure THEN 'UNCERTAIN' WHEN kinds <> 1 THEN 'UNCERTAIN' WHEN vs[1] = now OR now = '?' THEN 'CONFIRM' WHEN k >= 2 THEN 'REVISE' WHEN x IS NOT NULL THEN 'CONFIRM' ELSE 'REVISE' END AS de,
CASE WHEN agree AND (sure OR x = now OR now = '?') THEN x WHEN kinds = 0 THEN now WHEN kinds = 1 THEN vs[1] ELSE voted END AS gu FROM q),
d2 AS (SELECT *, CASE WHEN odd AND agree AND x <> now AND now <> '?' THEN 'REVISE' ELSE de END AS d2, CASE WHEN odd AND agree AND x <> now AND now <> '?' THEN x ELSE gu END AS g2 FROM d1)
SELECT symbol, score, CASE WHEN now = '?' AND d2 = 'CONFIRM' AND k <= 1 AND score < 50 THEN 'UNCERTAIN' ELSE d2 END AS decision, g2 AS guess FROM d2""",
    "typology_features": TOKENS_SQL
    + """, ln AS (SELECT count(*) AS len FROM syl GROUP BY seq_id), o AS (SELECT symbol, count(*) AS n FROM syl GROUP BY symbol),
lx AS (SELECT (SELECT max(len) FROM ln) AS max_len, count(*) AS types, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 6) AS repeat_rate, round(max(n) / sum(n), 6) AS top1_share FROM o),
pl AS (SELECT symbol, pos = 0 AS i, lead(pos) OVER (PARTITION BY seq_id ORDER BY pos) IS NULL AS f FROM syl), pf AS (SELECT symbol, count(*) FILTER (i) AS ni, count(*) FILTER (f) AS nf, count(*) FILTER (NOT i AND NOT f) AS nm FROM pl GROUP BY symbol),
fr AS (SELECT symbol, ni + nf + nm AS total, round(ni / (ni + nf + nm), 6) AS ini, round(nf / (ni + nf + nm), 6) AS fin, ni / (ni + nf + nm) <= 0.5 AND nf / (ni + nf + nm) <= 0.5 AND nm / (ni + nf + nm) <= 0.5 AS flex, coalesce(transliteration IN ('a', 'e', 'i', 'o', 'u'), false) AS lone FROM pf LEFT JOIN sign_list ON bennett_id = symbol),
pr AS (SELECT count(*) FILTER (fin > 0.3) AS final_biased, count(*) FILTER (ini > 0.3) AS initial_biased, count(*) FILTER (flex) AS flexible, count(*) FILTER (fin > 0.25) AS suffix_like, count(*) FILTER (ini >= 0.5 AND total >= 5) AS prefixes, count(*) FILTER (fin >= 0.5 AND total >= 5) AS suffixes, count(*) FILTER (lone) AS vowels, count(*) FILTER (lone AND ini > 0.3) AS leading_vowels, count(*) FILTER (lone AND ini > 0.4) AS articles FROM fr),
bg AS (SELECT symbol AS a, lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS b, translit AS v1, lead(translit) OVER (PARTITION BY seq_id ORDER BY pos) AS v2 FROM syl), bc AS (SELECT a, b, lower(min(v1)) AS v1, lower(min(v2)) AS v2, count(*) AS n FROM bg WHERE b IS NOT NULL GROUP BY a, b),
nt AS (SELECT count(*) FILTER (a = b AND n >= 2) AS doubled, count(*) FILTER (n > 3 AND ((contains(v1, 'n') AND contains(v2, 't')) OR (contains(v1, 't') AND contains(v2, 'n')))) AS nt_pairs FROM bc)
"""
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, v in cases)} END AS value FROM lx, pr, nt" for f, cases in TYPOLOGY.items()),
    "two_hop_links": """WITH x AS (SELECT l_partkey AS src, l_suppkey AS via, min(CASE WHEN l_quantity > 40 THEN 1 WHEN l_quantity > 20 THEN 2 ELSE 3 END) AS r1 FROM lineitem GROUP BY ALL),
y AS (SELECT s_suppkey AS via, CAST(s_nationkey AS BIGINT) AS dst, min(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 2 END) AS r2 FROM supplier GROUP BY ALL) SELECT src, via, dst, CAST(greatest(r1, r2) AS INT) AS rank FROM x JOIN y USING (via)""",
    "misalignment": TOKENS_SQL
    + """, c AS (SELECT bennett_id AS symbol, regexp_extract(lower(transliteration), '^([^aeiou\\d]*)', 1) AS c FROM sign_list), st AS (SELECT DISTINCT symbol, nx AS next, c FROM (SELECT symbol, lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM syl) JOIN c USING (symbol) WHERE nx IS NOT NULL),
fn AS (SELECT c, next, count(*) AS fans FROM st GROUP BY ALL), nr AS (SELECT symbol, count(*) AS neighbours, count(*) FILTER (fans > 1) AS shared FROM st JOIN fn USING (c, next) GROUP BY symbol),
pl AS (SELECT symbol, pos = 0 AS i, lead(pos) OVER (PARTITION BY seq_id ORDER BY pos) IS NULL AS f FROM syl), pf AS (SELECT symbol, count(*) FILTER (i) AS ni, count(*) FILTER (f) AS nf, count(*) FILTER (NOT i AND NOT f) AS nm FROM pl GROUP BY symbol),
fr AS (SELECT symbol, ni + nf + nm AS total, ni / (ni + nf + nm) AS a, nf / (ni + nf + nm) AS b, nm / (ni + nf + nm) AS m FROM pf), e AS (SELECT *, round(-(CASE WHEN a > 0 THEN a * log2(a) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b) ELSE 0 END + CASE WHEN m > 0 THEN m * log2(m) ELSE 0 END), 6) AS h FROM fr),
r AS (SELECT e.symbol, [CASE WHEN greatest(round(a, 6), round(b, 6)) > 0.6 THEN 'position' END, CASE WHEN coalesce(shared, 0) = 0 THEN 'no shared companions' END, CASE WHEN coalesce(neighbours, 0) < 3 THEN 'few companions' END, CASE WHEN total > 3 * (SELECT avg(total) FROM e) THEN 'too frequent' END,
CASE WHEN total * 3 < (SELECT avg(total) FROM e) THEN 'too rare' END, CASE WHEN h > 1.5 THEN 'scattered' END] AS x FROM e LEFT JOIN nr USING (symbol))
SELECT symbol, array_to_string(list_filter(x, lambda v: v IS NOT NULL), '; ') AS rules, CASE WHEN k >= 3 THEN 'high' WHEN k = 2 THEN 'medium' WHEN k = 1 THEN 'low' ELSE 'none' END AS severity FROM (SELECT *, len(list_filter(x, lambda v: v IS NOT NULL)) AS k FROM r)""",
}
