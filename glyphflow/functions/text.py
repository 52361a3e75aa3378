"""Scalar functions on identifiers, transliterations and words."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

VOWELS = "aeiou"
_KIND = np.full(128, -1)
for _i, _letters in enumerate(("aeiou", "pbmfvw", "tdnszrl", "kgqh", "jy")):  # fixed values: classes of letters
    _KIND[[ord(c) for c in _letters]] = _i
# Codes of numerals and fractions.
FRACTIONS = {"½": 0.5, "⅓": 1 / 3, "¼": 0.25, "⅕": 0.2, "⅙": 1 / 6, "⅛": 0.125, "¾": 0.75}
# The named consonant-vowel shapes.
SHAPES = ["V", "CV", "VC", "CVC", "CCV", "CVV", "VV", "VCV", "CVCV", "CCVC", "CCVV", "VCC", "CVCC", "CCCV"]


def subscripts_to_digits(c: Column) -> Column:
    return F.translate(c, "₀₁₂₃₄₅₆₇₈₉", "0123456789")


def plain_translit(c: Column) -> Column:
    """Lower case, digits for subscripts, no brackets or query marks."""
    return F.lower(F.regexp_replace(subscripts_to_digits(c), r"[\[\]?'+]", ""))


def valid_code(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(AB|A|NUM|DIV|ADJ|MET|VASE) [0-9A-F]+[A-Z]?$"), F.lit(False))


def canonical_code(c: Column) -> Column:
    """Number without leading zeros and variant letter."""
    return F.regexp_replace(F.regexp_replace(c, r"^([A-Z]+) 0+(\d)", "$1 $2"), r"(\d)[A-Z]$", "$1")


def code_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def cv_raw(c: Column) -> Column:
    """Letters as C and V; digits and other marks vanish."""
    s = F.regexp_replace(F.lower(F.translate(c, "áéíóúàèìòùâêîôûäëïöü", "aeiouaeiouaeiouaeiou")), r"[^\p{L}]", "")
    return F.regexp_replace(F.translate(s, VOWELS, "V" * 5), r"[^V]", "C")


def cv_label(c: Column) -> Column:
    """The named shape of a syllable, ``complex`` from 6 letters on, else ``other:RAW``; null for no letters."""
    raw = cv_raw(c)
    return F.when(F.length(raw) == 0, F.lit(None)).when(raw.isin(SHAPES), raw).when(F.length(raw) >= 6, "complex").otherwise(F.concat(F.lit("other:"), raw))


def onset(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^([^aeiou\d]*)", 1)


def vowel(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(c), r"([aeiou])", 1), F.lit(""))


def articulation(c: Column) -> Column:
    """Class of a syllable's first letter; a bare vowel is its own class."""
    first = F.substring(F.lower(c), 1, 1)
    return (
        F.when(first.isin(*VOWELS), "vowel").when(first.isin("p", "b", "m", "f", "v", "w"), "labial").when(first.isin("t", "d", "n", "s", "z", "r", "l", "š", "ś", "ñ", "ť"), "dental")
        .when(first.isin("k", "g", "q", "h"), "velar").when(first.isin("j", "y"), "palatal")
    )


def tokenise(c: Column, units: list[str]) -> Column:
    """Greedy longest match of the units, else single letters."""
    order = sorted(units, key=lambda u: (-len(u), u))
    return F.regexp_extract_all(F.lower(c), F.lit("(" + "|".join([*order, r"\p{L}"]) + ")"), F.lit(1))


def syllabify(c: Column, filler: str = "a") -> Column:
    """A word as open syllables: each consonant with the vowel after it, or ``filler``."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([^aeiou\W\d_]?[aeiou]|[^aeiou\W\d_])"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike("[aeiou]$"), p).otherwise(F.concat(p, F.lit(filler))))


def replace_in_order(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), steps, c)


def numeral(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:NUM )?(\d+)$", 1).try_cast("long")


def fraction_value(c: Column) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in FRACTIONS.items()))


def fraction_text(value: Column, within: float = 1e-3) -> Column:
    return F.coalesce(*(F.when(F.abs(value - v) < within, F.lit(k)) for k, v in FRACTIONS.items()))


def slash_hint(c: Column) -> Column:
    """The first (n/m) or (n/m?) of a text."""
    return F.nullif(F.regexp_extract(c, r"\((\d+/\d+)\??\)", 1), F.lit(""))


def reduplication(syllables: Column) -> Column:
    """Names of all patterns that an array of syllables shows, in order; empty for none or null.

    ``initial_disyllabic``: the first two again right after; ``initial_sign``: the
    first again right after, of three or more; ``adjacent_pair``: three equal ones in
    a row, not before the second; ``internal_disyllabic``: a pair again two or more
    later, of five or more; ``initial_repeated``: the first again from the third on;
    ``chiastic``: the first two mirrored at the end, of four or more.
    """
    s, n = syllables, F.size(syllables)
    at = lambda i: F.get(s, i if isinstance(i, Column) else F.lit(i))
    some = lambda lo, hi, test: F.exists(F.when(hi >= lo, F.sequence(F.lit(lo), hi)).otherwise(F.array().cast("array<int>")), test)
    pair = lambda i, j: (at(i) == at(j)) & (at(i + 1) == at(j + 1))
    later = lambda i: F.exists(F.when(n - 2 >= i + 2, F.sequence(i + 2, n - 2)).otherwise(F.array().cast("array<int>")), lambda j: pair(i, j))
    rules = {
        "initial_disyllabic": (n >= 4) & (at(0) == at(2)) & (at(1) == at(3)),
        "initial_sign": (n >= 3) & (at(0) == at(1)),
        "adjacent_pair": (n >= 4) & some(0, n - 4, lambda i: pair(i + 1, i + 2)),
        "internal_disyllabic": (n >= 5) & some(0, n - 4, later),
        "initial_repeated": (n >= 4) & F.array_contains(F.slice(s, 3, F.greatest(n, F.lit(1))), at(0)),
        "chiastic": (n >= 4) & (at(0) == at(n - 1)) & (at(1) == at(n - 2)),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items())))


def xml_escape(c: Column) -> Column:
    return replace_in_order(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w.-]+", "_")


@F.pandas_udf(DoubleType())
def weighted_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in which letters of one class (labial, dental, velar, vowel) replace each other at half cost.

    Pairs of one size are measured together, cell by cell of their tables; null where either is null.
    """
    out = np.full(len(a), np.nan)
    ok = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    x, y = a.to_numpy(object)[ok], b.to_numpy(object)[ok]
    sizes = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)], int).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == (m, n)).all(1))
        letters = lambda t, k: np.array([[ord(c) for c in t[r]] for r in rows], np.int64).reshape(len(rows), k)  # noqa: B023, E731
        p, q = letters(x, m), letters(y, n)
        kinds = [np.where(v < len(_KIND), _KIND[np.minimum(v, len(_KIND) - 1)], -1) for v in (p, q)]
        row = np.tile(np.arange(n + 1, dtype=float), (len(rows), 1))
        for i in range(m):
            swap = np.where(p[:, i : i + 1] == q, 0.0, np.where((kinds[0][:, i : i + 1] == kinds[1]) & (kinds[1] >= 0), 0.5, 1.0))
            now = np.empty_like(row)
            now[:, 0] = i + 1
            for j in range(n):
                now[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], now[:, j]) + 1, row[:, j] + swap[:, j])
            row = now
        out[ok[rows]] = row[:, n]
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def letter_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.split(c, "")) for c in (a, b))
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))
