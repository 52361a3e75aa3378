"""Matching sequences: exact, one edit, windows, shared frames and substitutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sequences import TOKENS_SQL, grams, neighbours, syllables
from ..skew import bounded
from ..tables import table
from .words import _types


def exact_match(gram_table: DataFrame, queries: DataFrame) -> DataFrame:
    """Every place of each query gram (``query_id, gram``)."""
    return gram_table.join(bounded(queries, 50_000), "gram")


def _edit_keys(column: str, pattern: bool) -> Column:
    """What a word must share with a pattern to be at most one token away, as an array of keys.

    ``=`` itself; per place what is left without it (a token replaced); ``-`` the
    word without one token, which is a pattern (a token too many), and ``+`` the word
    itself, which is a pattern without one. Two words share at most one key, save
    that equal ones share their places too.
    """
    p = F.split(column, "-")
    n = F.size(p)
    without = lambda i: F.array_join(F.concat(F.slice(p, F.lit(1), i - 1), F.slice(p, i + 1, n)), "-")
    places = F.sequence(F.lit(1), n)
    mark = lambda m, c: F.concat(F.lit(m), c)
    dropped = F.array_distinct(F.transform(places, without))
    whole, shorter = ("-", "+") if pattern else ("+", "-")
    replaced = F.transform(places, lambda i: F.concat_ws("|", n.cast("string"), i.cast("string"), without(i)))
    return F.concat(F.array(mark("=", F.col(column)), mark(whole, F.col(column))), F.transform(dropped, lambda c: mark(shorter, c)), replaced)


def _within_one(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (with ``word``) and patterns at most one token apart, once per pair, by one equi-join on shared keys."""
    keyed = rows.withColumn("key", F.explode(_edit_keys("word", False)))
    wanted = patterns.select("pattern", F.explode(_edit_keys("pattern", True)).alias("key"))
    same = F.startswith("key", F.lit("="))
    met = keyed.join(bounded(wanted), "key").filter(same | (F.col("word") != F.col("pattern")))
    return met.withColumn("distance", F.when(same, 0).otherwise(1)).drop("key")


def one_edit_pairs(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """``word, pattern, distance`` with a distance of at most one token.

    ``words(word)`` and ``patterns(pattern)`` are dash-joined tokens. Both sides
    explode to what they share with a neighbour and meet there, so no side is
    compared with all of the other and a key's pairs are the result itself.
    """
    return _within_one(words.select("word").filter("word is not null").distinct(), patterns.select("pattern").filter("pattern is not null").distinct()).select("word", "pattern", "distance")


def token_levenshtein(a: str, b: str):
    """Edit distance of dash-joined tokens: each distinct token becomes one character."""
    x, y = F.split(a, "-"), F.split(b, "-")
    both = F.array_distinct(F.concat(x, y))
    code = lambda arr: F.array_join(F.transform(arr, lambda t: F.char(F.array_position(both, t) + 32)), "")
    return F.levenshtein(code(x), code(y))


def window_levenshtein(tokens: DataFrame, patterns: DataFrame, most: int = 1) -> DataFrame:
    """Windows of a pattern's length give or take one token within ``most`` edits.

    ``patterns(pattern)``: a stated list. Up to one edit windows and patterns meet by
    the keys they share (:func:`one_edit_pairs`), without a shuffle while the keys of
    the patterns are few; beyond, distinct windows are measured against each pattern.
    """
    patterns = patterns.select("pattern").filter("pattern is not null").distinct()
    sizes = sorted({n for r in patterns.select(F.size(F.split("pattern", "-")).alias("n")).distinct().collect() for n in (r.n - 1, r.n, r.n + 1) if n > 0})
    if not sizes:
        sizes = [1]
    rows = neighbours(tokens, 0, sizes[-1] - 1, ["translit"])
    part = lambda k: F.col("translit" if k == 0 else f"translit_p{k}")
    words = F.array(*(F.when(part(n - 1).isNotNull(), F.concat_ws("-", *map(part, range(n)))) for n in sizes))
    windows = rows.select("seq_id", "pos", F.explode(words).alias("word")).filter("word is not null")
    if most <= 1:
        out = _within_one(windows, patterns).filter(F.col("distance") <= most)
    else:
        near = F.abs(F.size(F.split("word", "-")) - F.size(F.split("pattern", "-"))) <= 1
        pairs = windows.select("word").distinct().join(bounded(patterns), near).withColumn("distance", token_levenshtein("word", "pattern"))
        out = windows.join(pairs.filter(F.col("distance") <= most), "word")
    return out.select("seq_id", "pos", "word", "pattern", "distance")


def best_per_group(matches: DataFrame, group: str) -> DataFrame:
    """The match of least distance per group (ties: longest, then first word), and whether several patterns claim it."""
    best = F.min(F.struct("distance", (-F.length("word")).alias("l"), "word", "pattern")).alias("m")
    return matches.groupBy(group).agg(best, (F.count_distinct("pattern") >= 2).alias("ambiguous")).select(group, "m.word", "m.pattern", "m.distance", "ambiguous")


def substring_positions(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """All, also overlapping, positions of a string in each text (1-based)."""
    m = len(pattern)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - m + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(m)) == pattern)
    return texts.filter(F.contains(F.col(text), F.lit(pattern))).select(key, F.explode(at).alias("place"))


def hamming_one(gram_table: DataFrame, n: int) -> DataFrame:
    """Pairs of n-grams that differ in one place, by joining grams with that place masked.

    A mask shared by m grams gives m(m-1)/2 pairs, which is the output itself; grams
    are distinct, so m is bounded by the alphabet.
    """
    g = gram_table.groupBy("gram").agg(F.count("*").alias("n"))
    masked = g.select("gram", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("place"), F.transform("gram", lambda x, j: F.when(j == i, F.lit("*")).otherwise(x)).alias("frame")))).alias("m")).select("gram", "n", "m.place", "m.frame")
    b = masked.select(F.col("gram").alias("gram_b"), F.col("n").alias("n_b"), "place", "frame")
    pairs = masked.join(b, ["place", "frame"]).filter(F.col("gram") < F.col("gram_b"))
    return pairs.select("place", F.concat_ws(" ", "gram").alias("gram_a"), F.concat_ws(" ", "gram_b").alias("gram_b"), F.least("n", "n_b").alias("support"))


def substitution_kinds(pairs: DataFrame, value_of: DataFrame) -> DataFrame:
    """Pairs of swapped symbols, classified by what their values share (``value_of(symbol, value)``)."""
    pick = lambda c: F.get(F.split(c, "\\|"), F.col("place"))
    rows = pairs.select(pick("ga").alias("a"), pick("gb").alias("b"), "place", "support")
    v = lambda x: value_of.select(F.col("symbol").alias(x), F.col("value").alias(f"v_{x}"))
    from ..functions.text import onset, vowel

    rows = rows.join(v("a"), "a").join(v("b"), "b")
    same_c, same_v = onset(F.col("v_a")) == onset(F.col("v_b")), vowel(F.col("v_a")) == vowel(F.col("v_b"))
    kind = F.when(same_c & same_v, "same").when(same_c, "vowel_change").when(same_v, "consonant_change").otherwise("other")
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return rows.groupBy(lo.alias("a"), hi.alias("b"), kind.alias("kind")).agg(F.count("*").alias("frames"), F.sum("support").alias("support"))


def frame_links(tokens: DataFrame, least: int = 3) -> DataFrame:
    """Symbols that share right neighbours (``C``) or left ones (``V``): in how many, and how often."""
    two = neighbours(tokens, 0, 1, ["symbol"]).filter("symbol_p1 is not null").groupBy(F.col("symbol").alias("l"), F.col("symbol_p1").alias("r")).agg(F.count("*").alias("n"))

    def side(own, other, name):  # bigram types: at most alphabet squared
        x = two.select(F.col(own).alias("a"), F.col(other).alias("k"), F.col("n").alias("na"))
        y = two.select(F.col(own).alias("b"), F.col(other).alias("k"), F.col("n").alias("nb"))
        pairs = x.join(y, "k").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.least("na", "nb")).alias("weight"))
        return pairs.filter(F.col("shared") >= least).select("a", "b", F.lit(name).alias("side"), "shared", "weight")

    return side("l", "r", "C").unionByName(side("r", "l", "V"))


def triangles(links: DataFrame) -> DataFrame:
    """s1-s2 linked by C, s2-s3 by V, s1-s3 by either; each set of three once."""
    both = links.select("a", "b", "side").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "side"))
    c = both.filter("side = 'C'").select(F.col("a").alias("s1"), F.col("b").alias("s2"))
    v = both.filter("side = 'V'").select(F.col("a").alias("s2"), F.col("b").alias("s3"))
    e = both.select(F.col("a").alias("s1"), F.col("b").alias("s3")).distinct()
    t = c.join(v, "s2").filter("s1 <> s3").join(e, ["s1", "s3"])
    return t.select(F.array_join(F.array_sort(F.array("s1", "s2", "s3")), " ~ ").alias("triple")).distinct()


def successors(tokens: DataFrame, dense: bool) -> DataFrame:
    """Successor counts over dense positions, or only over raw positions that follow without gap."""
    step = neighbours(tokens, 0, 1, ["symbol", "raw_pos"]).filter("symbol_p1 is not null")
    if not dense:
        step = step.filter("raw_pos_p1 = raw_pos + 1")
    return step.groupBy("symbol", F.col("symbol_p1").alias("next")).agg(F.count("*").alias("n")).filter("n >= 2")


def suffix_coverage(types: DataFrame, suffixes: list[str]) -> DataFrame:
    """Per suffix: word types with it anywhere, at the end, and texts."""
    each = types.select("word", "n", "texts", F.explode(F.array(*map(F.lit, suffixes))).alias("suffix"))
    inside = F.concat(F.lit("-"), "word", F.lit("-")).contains(F.concat(F.lit("-"), "suffix", F.lit("-")))
    end = F.endswith(F.concat(F.lit("-"), "word"), F.concat(F.lit("-"), "suffix"))
    return each.groupBy("suffix").agg(F.count_if(inside).alias("hits"), F.count_if(end).alias("final"), F.sum(F.when(end, F.col("texts")).otherwise(0)).alias("texts"))


def match_score(length, distance, certain):
    """0..100 from the match's length, its distance and whether its reading is certain."""
    base = F.least(F.lit(60), 15 * length) - 20 * distance
    return F.greatest(F.lit(0), F.least(F.lit(100), base + F.when(certain, 20).otherwise(0)))


def confidence_band(distance, length):
    return F.when((distance == 0) & (length >= 3), "HIGH").when((distance == 0) | ((distance == 1) & (length >= 4)), "MEDIUM").otherwise("LOW")


_PATTERNS = ["ne-ri", "ri-ko", "pa-ro", "ku-ro", "ki-ro", "da-da-ta", "sa-ra-me", "mu-re-zo-ri"]


def _pat(s):
    return s.createDataFrame([(p,) for p in _PATTERNS], "pattern string")


def _subs(s, d):
    p = hamming_one(grams(syllables(s, d), 3), 3)
    v = table(s, d, "sign_list").select(F.col("bennett_id").alias("symbol"), F.col("transliteration").alias("value"))
    return substitution_kinds(p.select("place", F.regexp_replace("gram_a", " (?=[A-Z])", "|").alias("ga"), F.regexp_replace("gram_b", " (?=[A-Z])", "|").alias("gb"), "support"), v)


QUERIES = {
    "exact_gram_match": lambda s, d: exact_match(grams(syllables(s, d), 2, "translit").select("seq_id", "pos", F.concat_ws("-", "gram").alias("gram")), _pat(s).withColumnRenamed("pattern", "gram")),
    "edit1_gram_match": lambda s, d: one_edit_pairs(_types(s, d).filter("n_signs >= 2").select("word"), _types(s, d).filter("n_signs >= 2").select(F.col("word").alias("pattern"))),
    "window_levenshtein": lambda s, d: window_levenshtein(syllables(s, d), _pat(s)),
    "best_per_group": lambda s, d: best_per_group(window_levenshtein(syllables(s, d), _pat(s)), "seq_id"),
    "match_scores": lambda s, d: best_per_group(window_levenshtein(syllables(s, d), _pat(s)), "seq_id").select("seq_id", match_score(F.size(F.split("word", "-")), F.col("distance"), ~F.col("ambiguous")).alias("score"), confidence_band(F.col("distance"), F.size(F.split("word", "-"))).alias("band")),
    "substring_positions": lambda s, d: substring_positions(table(s, d, "documents").select("doc_id", "text").filter("text is not null"), "doc_id", "text", "inscri"),
    "hamming1_substitutions": lambda s, d: hamming_one(grams(syllables(s, d), 3), 3),
    "substitution_kinds": _subs,
    "frame_links": lambda s, d: frame_links(syllables(s, d)),
    "frame_triangles": lambda s, d: triangles(frame_links(syllables(s, d))),
    "successor_dense": lambda s, d: successors(syllables(s, d), True),
    "successor_raw": lambda s, d: successors(syllables(s, d), False),
    "suffix_coverage": lambda s, d: suffix_coverage(_types(s, d), ["re", "ja", "me", "na", "ti-re"]),
}

from .words import _WT  # noqa: E402

_VAL = ", ".join(f"('{p}')" for p in _PATTERNS)


def _lev(a: str, b: str) -> str:
    # both sides must be coded by one order of tokens
    both = f"list_sort(list_distinct(list_concat({a}, {b})))"
    code = lambda x: f"array_to_string(list_transform({x}, lambda t: chr(CAST(list_position({both}, t) + 32 AS INT))), '')"
    return f"CAST(levenshtein({code(a)}, {code(b)}) AS INT)"


def _gram(n: int, col: str, sep: str, src: str = "syl") -> str:
    parts = f" || '{sep}' || ".join([col, *(f"lead({col}, {i}) OVER w" for i in range(1, n))])
    return f"SELECT * FROM (SELECT seq_id, pos, {n} AS size, {parts} AS word FROM {src} WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE word IS NOT NULL"


_WIN = (
    TOKENS_SQL
    + f", pt(pattern) AS (VALUES {_VAL}), ws AS ({' UNION ALL '.join(_gram(n, 'translit', '-') for n in range(1, 6))}), wp AS (SELECT seq_id, pos, word, pattern, string_split(word, '-') AS x, string_split(pattern, '-') AS y FROM ws, pt WHERE abs(size - len(string_split(pattern, '-'))) <= 1),"
    + f" wl AS (SELECT seq_id, pos, word, pattern, {_lev('x', 'y')} AS distance FROM wp), hit AS (SELECT * FROM wl WHERE distance <= 1)"
)
_BEST = ", best AS (SELECT *, count(DISTINCT pattern) OVER (PARTITION BY seq_id) >= 2 AS ambiguous FROM hit QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY distance, length(word) DESC, word, pattern) = 1)"
_HAM = TOKENS_SQL + (
    ", g AS (SELECT a, b, c, count(*) AS n FROM (SELECT symbol AS a, lead(symbol) OVER w AS b, lead(symbol, 2) OVER w AS c FROM syl WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE c IS NOT NULL GROUP BY ALL),"
    " hp AS (SELECT CASE WHEN x.a <> y.a THEN 0 WHEN x.b <> y.b THEN 1 ELSE 2 END AS place, x.a AS xa, x.b AS xb, x.c AS xc, y.a AS ya, y.b AS yb, y.c AS yc, least(x.n, y.n) AS support FROM g x JOIN g y ON (x.a, x.b, x.c) < (y.a, y.b, y.c) AND CAST(x.a <> y.a AS INT) + CAST(x.b <> y.b AS INT) + CAST(x.c <> y.c AS INT) = 1)"
)
_LINKS = ", tw AS (SELECT symbol AS l, nx AS r, count(*) AS n FROM (SELECT symbol, lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM syl) WHERE nx IS NOT NULL GROUP BY ALL), lk AS (" + " UNION ALL ".join(
    f"SELECT x.{o} AS a, y.{o} AS b, '{nm}' AS side, count(*) AS shared, CAST(sum(least(x.n, y.n)) AS BIGINT) AS weight FROM tw x JOIN tw y ON x.{k} = y.{k} AND x.{o} < y.{o} GROUP BY ALL" for o, k, nm in (("l", "r", "C"), ("r", "l", "V"))
) + ")"
_SUCC = ", st AS (SELECT symbol, raw_pos, lead(symbol) OVER w AS next, lead(raw_pos) OVER w AS rp FROM syl WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) SELECT symbol, next, count(*) AS n FROM st WHERE next IS NOT NULL {} GROUP BY ALL HAVING count(*) >= 2"
_ON = "regexp_extract(lower({0}), '^([^aeiou\\d]*)', 1)"
_VO = "nullif(regexp_extract(lower({0}), '([aeiou])', 1), '')"
SQL = {
    "exact_gram_match": TOKENS_SQL + f", ws AS ({_gram(2, 'translit', '-')}) SELECT seq_id, pos, word AS gram FROM ws WHERE word IN ({', '.join(repr(p) for p in _PATTERNS)})",
    "edit1_gram_match": _WT
    + f", a AS (SELECT DISTINCT word, string_split(word, '-') AS x FROM ty WHERE n_signs >= 2), b AS (SELECT DISTINCT word AS pattern, string_split(word, '-') AS y FROM ty WHERE n_signs >= 2), ab AS (SELECT * FROM a, b WHERE abs(len(x) - len(y)) <= 1), d AS (SELECT word, pattern, {_lev('x', 'y')} AS distance FROM ab) SELECT word, pattern, distance FROM d WHERE distance <= 1",
    "window_levenshtein": _WIN + "SELECT seq_id, pos, word, pattern, distance FROM hit",
    "best_per_group": _WIN + _BEST + "SELECT seq_id, word, pattern, distance, ambiguous FROM best",
    "match_scores": _WIN
    + _BEST
    + """, z AS (SELECT *, CAST(len(string_split(word, '-')) AS INT) AS k FROM best) SELECT seq_id, greatest(0, least(100, least(60, 15 * k) - 20 * distance + CASE WHEN NOT ambiguous THEN 20 ELSE 0 END)) AS score,
CASE WHEN distance = 0 AND k >= 3 THEN 'HIGH' WHEN distance = 0 OR (distance = 1 AND k >= 4) THEN 'MEDIUM' ELSE 'LOW' END AS band FROM z""",
    "substring_positions": "SELECT doc_id, CAST(p AS INT) AS place FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM documents WHERE contains(text, 'inscri')) WHERE substr(text, p, 6) = 'inscri'",
    "hamming1_substitutions": _HAM + "SELECT place, xa || ' ' || xb || ' ' || xc AS gram_a, ya || ' ' || yb || ' ' || yc AS gram_b, support FROM hp",
    "substitution_kinds": _HAM
    + f""", p AS (SELECT CASE place WHEN 0 THEN xa WHEN 1 THEN xb ELSE xc END AS a, CASE place WHEN 0 THEN ya WHEN 1 THEN yb ELSE yc END AS b, support FROM hp),
v AS (SELECT p.*, x.transliteration AS va, y.transliteration AS vb FROM p JOIN sign_list x ON x.bennett_id = a JOIN sign_list y ON y.bennett_id = b)
SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN {_ON.format('va')} = {_ON.format('vb')} AND {_VO.format('va')} = {_VO.format('vb')} THEN 'same' WHEN {_ON.format('va')} = {_ON.format('vb')} THEN 'vowel_change' WHEN {_VO.format('va')} = {_VO.format('vb')} THEN 'consonant_change' ELSE 'other' END AS kind,
count(*) AS frames, CAST(sum(support) AS BIGINT) AS support FROM v GROUP BY ALL""",
    "frame_links": TOKENS_SQL + _LINKS + "SELECT * FROM lk WHERE shared >= 3",
    "frame_triangles": TOKENS_SQL
    + _LINKS
    + """, k AS (SELECT a, b, side FROM lk WHERE shared >= 3 UNION ALL SELECT b, a, side FROM lk WHERE shared >= 3), e AS (SELECT DISTINCT a, b FROM k)
SELECT DISTINCT array_to_string(list_sort([c.a, c.b, v.b]), ' ~ ') AS triple FROM k c JOIN k v ON c.b = v.a AND c.side = 'C' AND v.side = 'V' JOIN e ON e.a = c.a AND e.b = v.b WHERE c.a <> v.b""",
    "successor_dense": TOKENS_SQL + _SUCC.format(""),
    "successor_raw": TOKENS_SQL + _SUCC.format("AND rp = raw_pos + 1"),
    "suffix_coverage": _WT
    + "SELECT s AS suffix, count(*) FILTER (contains('-' || word || '-', '-' || s || '-')) AS hits, count(*) FILTER (ends_with('-' || word, '-' || s)) AS final, CAST(coalesce(sum(texts) FILTER (ends_with('-' || word, '-' || s)), 0) AS BIGINT) AS texts FROM ty, (VALUES ('re'), ('ja'), ('me'), ('na'), ('ti-re')) v(s) GROUP BY s",
}
