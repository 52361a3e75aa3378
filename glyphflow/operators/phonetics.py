"""Sound: distance of syllables, likeness of spellings, shape of words, patterns of syllable shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sequences import TOKENS_SQL, grams, r6, syllables
from ..tables import table
from .words import _DW, _doc_words

# Place, manner and voice of consonants; height, backness and rounding of vowels.
CONSONANTS = {
    "p": (0, 0, -1), "b": (0, 0, 1), "t": (1, 0, -1), "d": (1, 0, 1), "k": (2, 0, -1), "g": (2, 0, 1), "q": (3, 0, -1), "m": (0, 1, 1), "n": (1, 1, 1), "r": (1, 2, 1), "l": (1, 3, 1),
    "s": (1, 4, -1), "z": (1, 4, 1), "j": (1.5, 5, 1), "w": (0.5, 5, 1), "h": (4, 4, -1),
}
VOWELS = {"a": (0, 0, 0), "e": (0.5, -1, 0), "i": (1, -1, 0), "o": (0.5, 1, 1), "u": (1, 1, 1)}
# How natural a step from one syllable to another is, where it is not even.
DIRECTIONS = {
    ("qa", "ka"): 0.85, ("ka", "qa"): 0.30, ("jo", "za"): 0.75, ("za", "jo"): 0.40, ("e", "pa"): 0.15, ("pa", "e"): 0.10, ("ra", "ma"): 0.45, ("ma", "ra"): 0.35, ("mu", "ma"): 0.70, ("ma", "mu"): 0.65,
    ("da", "ta"): 0.65, ("ta", "da"): 0.55, ("di", "ti"): 0.65, ("ti", "di"): 0.55, ("ju", "jo"): 0.70, ("jo", "ju"): 0.65, ("ma", "pa"): 0.50, ("pa", "ma"): 0.45,
}


def _lookup(key: Column, values: dict[str, float]) -> Column:
    """A fixed table as one map: chains of conditions would outgrow generated code."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v)))), key)


def _feature(letter: Column, features: dict, i: int) -> Column:
    return _lookup(letter, {k: v[i] for k, v in features.items()})


def articulatory_distance(a: Column, b: Column) -> Column:
    """0 for equal syllables up to 1: 0.6 of the distance of their consonants and 0.4 of that of their vowels.

    A null or ``?`` is half a distance; index digits and query marks do not count.
    """
    bare = lambda c: F.lower(F.regexp_replace(F.trim(c), r"[?₂]+$", ""))
    x, y = bare(a), bare(b)
    lone = lambda c: c.isin(*VOWELS)
    cons = lambda c: F.when(lone(c), "").otherwise(F.substring(c, 1, 1))
    vow = lambda c: F.when(lone(c), c).when(F.length(c) >= 2, F.substr(c, F.lit(2))).otherwise("?")
    gap = lambda p, q, t, i: F.abs(_feature(p, t, i) - _feature(q, t, i))
    c1, c2, v1, v2 = cons(x), cons(y), vow(x), vow(y)
    both = gap(c1, c2, CONSONANTS, 0) / 4 * 0.5 + gap(c1, c2, CONSONANTS, 1) / 5 * 0.3 + gap(c1, c2, CONSONANTS, 2) / 2 * 0.2
    consonant = F.when((c1 != "") & (c2 != ""), F.coalesce(both, F.lit(0.5))).when((c1 != "") | (c2 != ""), 0.4).otherwise(0.0)
    level = gap(v1, v2, VOWELS, 0) * 0.5 + gap(v1, v2, VOWELS, 1) / 2 * 0.3 + gap(v1, v2, VOWELS, 2) * 0.2
    vowel = F.coalesce(level, F.when(v1 != v2, 0.5).otherwise(0.0))
    unknown = x.isNull() | y.isNull() | (x == "") | (y == "")
    return F.when(unknown & ~F.coalesce(x == y, F.lit(False)), 0.5).when(x == y, 0.0).otherwise(0.6 * consonant + 0.4 * vowel)


def step_plausibility(a: Column, b: Column) -> Column:
    """0.7 of the likeness of two syllables and 0.3 of how natural the step in this direction is (half by default, 1 for none)."""
    bias = F.coalesce(_lookup(F.concat_ws(">", a, b), {f"{x}>{y}": v for (x, y), v in DIRECTIONS.items()}), F.when(a == b, 1.0), F.lit(0.5))
    return 0.7 * (1 - articulatory_distance(a, b)) + 0.3 * bias


def spelling_likeness(a: Column, b: Column) -> Column:
    """Half the Jaccard similarity of the letters, half the Ratcliff-Obershelp ratio; 0 where either is empty or null."""
    some = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(F.coalesce(some, F.lit(False)), 0.5 * T.letter_jaccard(F.lower(a), F.lower(b)) + 0.5 * T.matching_ratio(F.lower(a), F.lower(b))).otherwise(0.0)


def word_profile(word: Column) -> dict[str, Column]:
    """Shape of a word: C and V sequence, counts, shares, first and last letter, open ending, mostly CV pairs."""
    shape = T.cv_raw(word)
    n, letters = F.length(shape), F.regexp_replace(F.lower(word), r"[^\p{L}]", "")
    v = n - F.length(F.replace(shape, F.lit("V"), F.lit("")))
    pairs = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2)), lambda i: F.substr(shape, i, F.lit(2)) == "CV"))
    return {
        "shape": shape, "letters": n, "consonants": n - v, "vowels": v, "consonant_share": F.round(F.coalesce(F.try_divide(n - v, n), F.lit(0.0)), 3),
        "initial": F.substring(letters, 1, 1), "final": F.substr(letters, F.greatest(n, F.lit(1)), F.lit(1)), "open": F.endswith(shape, F.lit("V")), "mostly_cv": (n > 0) & (pairs >= F.floor(n / 2) * 0.7),
    }


def shape_patterns(tokens: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), top: int = 200) -> DataFrame:
    """``n, pattern, count``: the ``top`` most frequent sequences of syllable shapes; a syllable without letters is ``?``."""
    shaped = tokens.withColumn("shape", F.coalesce(T.cv_label(F.col("translit")), F.lit("?")))
    sets = [grams(shaped, n, "shape").select(F.lit(n).alias("n"), F.concat_ws(" ", "gram").alias("pattern")) for n in sizes]
    rows = sets[0]
    for more in sets[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("n", "pattern").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "n", "pattern").limit(top)


def _pairs(s, d):
    v = table(s, d, "sign_list").filter("sign_type = 'syllabogram' and transliteration is not null")
    side = lambda x: v.select(F.col("bennett_id").alias(f"id_{x}"), F.col("transliteration").alias(x), F.lit(1).alias("any"))
    return side("a").join(F.broadcast(side("b")), "any").drop("any")  # the fixed sign list with itself


QUERIES = {
    "articulatory_distance": lambda s, d: _pairs(s, d).select("id_a", "id_b", r6(articulatory_distance(F.col("a"), F.col("b"))).alias("distance"), r6(step_plausibility(F.col("a"), F.col("b"))).alias("plausibility")),
    "spelling_likeness": lambda s, d: _pairs(s, d).select("id_a", "id_b", r6(spelling_likeness(F.col("a"), F.col("b"))).alias("likeness")),
    "word_profile": lambda s, d: _doc_words(s, d).select("w", *(c.alias(k) for k, c in word_profile(F.col("w")).items())),
    "shape_patterns": lambda s, d: shape_patterns(syllables(s, d)),
}

_SL = "WITH s AS (SELECT bennett_id AS id, lower(regexp_replace(trim(transliteration, ' '), '[?₂]+$', '')) AS x, transliteration AS t FROM sign_list WHERE sign_type = 'syllabogram' AND transliteration IS NOT NULL), p AS (SELECT *, CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') THEN '' ELSE substr(x, 1, 1) END AS c, CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') THEN x WHEN length(x) >= 2 THEN substr(x, 2) ELSE '?' END AS v FROM s)"
_CF = ", cf(l, p, m, o) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in CONSONANTS.items()) + "), vf(l, h, b, r) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in VOWELS.items()) + "), dr(a, b, w) AS (VALUES " + ", ".join(f"('{a}', '{b}', {w}::DOUBLE)" for (a, b), w in DIRECTIONS.items()) + ")"
_RAW = "regexp_replace(translate(w, 'aeiou', 'VVVVV'), '[^V]', 'C', 'g')"
_LBL = f"(SELECT CASE WHEN q = '' THEN '?' WHEN q IN ({', '.join(repr(x) for x in T.SHAPES)}) THEN q WHEN length(q) >= 6 THEN 'complex' ELSE 'other:' || q END FROM (SELECT regexp_replace(translate(regexp_replace(lower(translit), '[^\\p{{L}}]', '', 'g'), 'aeiou', 'VVVVV'), '[^V]', 'C', 'g') AS q))"
SQL = {
    "articulatory_distance": _SL
    + _CF
    + """, z AS (SELECT a.id AS id_a, b.id AS id_b, a.t AS ta, b.t AS tb, a.x = b.x AS same, a.x = '' OR b.x = '' AS unknown,
CASE WHEN a.c <> '' AND b.c <> '' THEN coalesce(abs(f.p - g.p) / 4 * 0.5 + abs(f.m - g.m) / 5 * 0.3 + abs(f.o - g.o) / 2 * 0.2, 0.5) WHEN a.c <> '' OR b.c <> '' THEN 0.4 ELSE 0 END AS cd,
coalesce(abs(h.h - k.h) * 0.5 + abs(h.b - k.b) / 2 * 0.3 + abs(h.r - k.r) * 0.2, CASE WHEN a.v <> b.v THEN 0.5 ELSE 0 END) AS vd
FROM p a, p b LEFT JOIN cf f ON f.l = a.c LEFT JOIN cf g ON g.l = b.c LEFT JOIN vf h ON h.l = a.v LEFT JOIN vf k ON k.l = b.v),
y AS (SELECT *, CASE WHEN same THEN 0 WHEN unknown THEN 0.5 ELSE 0.6 * cd + 0.4 * vd END AS d FROM z)
SELECT id_a, id_b, round(d, 6) AS distance, round(0.7 * (1 - d) + 0.3 * coalesce(w, CASE WHEN ta = tb THEN 1 ELSE 0.5 END), 6) AS plausibility FROM y LEFT JOIN dr ON dr.a = ta AND dr.b = tb""",
    "word_profile": _DW
    + f""", q AS (SELECT w, {_RAW} AS shape, length(w) AS n FROM dw) SELECT w, shape, CAST(n AS INT) AS letters, CAST(length(replace(shape, 'V', '')) AS INT) AS consonants, CAST(n - length(replace(shape, 'V', '')) AS INT) AS vowels,
round(length(replace(shape, 'V', '')) / n, 3) AS consonant_share, w[1] AS initial, w[-1] AS final, ends_with(shape, 'V') AS open, len(list_filter(range(1, n + 1, 2), lambda i: substr(shape, i, 2) = 'CV')) >= floor(n / 2) * 0.7 AS mostly_cv FROM q""",
    "shape_patterns": TOKENS_SQL
    + f", sh AS (SELECT seq_id, pos, {_LBL} AS l FROM syl), g AS ("
    + " UNION ALL ".join(f"SELECT {n} AS n, " + " || ' ' || ".join(["l", *(f"lead(l, {i}) OVER w" for i in range(1, n))]) + " AS pattern FROM sh WINDOW w AS (PARTITION BY seq_id ORDER BY pos)" for n in (2, 3, 4))
    + ") SELECT CAST(n AS INT) AS n, pattern, count(*) AS count FROM g WHERE pattern IS NOT NULL GROUP BY ALL ORDER BY count DESC, n, pattern LIMIT 200",
}
