"""Words and identifiers: labels, shapes, paradigms and reduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sequences import TOKENS_SQL, r6, sign_tokens
from ..tables import table


def word_types(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``word, n_signs, n, texts``: spelling, length and frequency of each word of ``words(seq_id, word, raw_pos)``."""
    rows = tokens.join(words, ["seq_id", "raw_pos"])
    spelt = rows.groupBy("seq_id", "word").agg(F.array_sort(F.collect_list(F.struct("raw_pos", "translit"))).alias("s"))
    forms = spelt.select("seq_id", F.array_join(F.transform("s", lambda x: x["translit"]), "-").alias("word"), F.size("s").alias("n_signs"))
    return forms.groupBy("word", "n_signs").agg(F.count("*").alias("n"), F.count_distinct("seq_id").alias("texts"))


def length_distribution(types: DataFrame) -> DataFrame:
    return types.groupBy("n_signs").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


def paradigms(types: DataFrame, least: int = 2) -> DataFrame:
    """Roots with several endings or beginnings of one or two signs."""
    parts = F.split("word", "-")
    n = F.size("p")
    rows = types.filter("n_signs >= 2").select("word", parts.alias("p"))
    cut = lambda side, k: F.struct(
        F.lit(side).alias("side"), F.lit(k).alias("size"),
        F.array_join(F.slice("p", 1 if side == "suffix" else k + 1, F.greatest(n - k, F.lit(0))), "-").alias("root"),
        F.array_join(F.slice("p", F.when(n > k, n - k + 1).otherwise(1) if side == "suffix" else F.lit(1), F.lit(k)), "-").alias("affix"),
    )
    each = rows.select("word", F.explode(F.array(*(cut(s, k) for s in ("suffix", "prefix") for k in (1, 2)))).alias("c"), n.alias("n")).filter("n > c.size")
    return each.groupBy("c.side", "c.size", "c.root").agg(F.count_distinct("c.affix").alias("affixes")).filter(F.col("affixes") >= least)


def _words(s, d):
    return table(s, d, "words").filter("inscription_id is not null").select(F.col("inscription_id").alias("seq_id"), F.col("word_index").alias("word"), F.explode("sign_sequences").alias("raw_pos")).distinct()


def _types(s, d):
    return word_types(sign_tokens(s, d).filter("kind = 'syllabogram'"), _words(s, d))


def _doc_words(s, d):
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]+)"), F.lit(1))).alias("w")
    return table(s, d, "documents").select(w).groupBy("w").agg(F.count("*").alias("n"))


QUERIES = {
    "code_functions": lambda s, d: table(s, d, "sign_list").select("bennett_id", T.valid_code(F.col("bennett_id")).alias("valid"), T.canonical_code(F.col("bennett_id")).alias("canonical"), T.plain_translit(F.col("transliteration")).alias("plain"), T.xml_escape(F.col("transliteration")).alias("xml"), T.file_name(F.col("bennett_id")).alias("file")),
    "cv_labels": lambda s, d: _doc_words(s, d).select(F.col("w"), T.cv_label(F.col("w")).alias("label")),
    "cv_split": lambda s, d: table(s, d, "sign_list").filter("sign_type = 'syllabogram'").select("bennett_id", T.onset(F.col("transliteration")).alias("onset"), F.coalesce(T.vowel(F.col("transliteration")), F.lit("-")).alias("vowel"), F.coalesce(T.articulation(F.col("transliteration")), F.lit("-")).alias("place")),
    "numeral_values": lambda s, d: table(s, d, "sign_list").select("bennett_id", F.coalesce(T.numeral(F.col("bennett_id")), F.lit(-1)).alias("value"), r6(F.coalesce(T.fraction_value(F.col("transliteration")), F.lit(-1.0))).alias("fraction")),
    "tokenise_phonemes": lambda s, d: _doc_words(s, d).select("w", F.concat_ws(".", T.tokenise(F.col("w"), ["sch", "str", "th", "ch", "sh", "kr"])).alias("units"), F.size(T.syllabify(F.col("w"))).alias("syllables")),
    "word_frequency": lambda s, d: _types(s, d),
    "word_length_distribution": lambda s, d: length_distribution(_types(s, d)),
    "paradigms": lambda s, d: paradigms(_types(s, d)),
    "reduplication": lambda s, d: _types(s, d).select("word", F.concat_ws(",", T.reduplication(F.split("word", "-"))).alias("patterns")),
    "weighted_levenshtein": lambda s, d: _doc_words(s, d).select("w", T.weighted_levenshtein(F.col("w"), F.lit("stone")).alias("cost"), r6(T.letter_jaccard(F.col("w"), F.lit("stone"))).alias("letters")),
}

_DW = "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), dw AS (SELECT w, count(*) AS n FROM w GROUP BY w) "
_RAW = "regexp_replace(translate(w, 'aeiou', 'VVVVV'), '[^V]', 'C', 'g')"
_WT = (
    TOKENS_SQL
    + """, wd AS (SELECT DISTINCT inscription_id AS seq_id, word_index AS word, unnest(sign_sequences) AS raw_pos FROM words WHERE inscription_id IS NOT NULL),
sp AS (SELECT seq_id, wd.word, string_agg(translit, '-' ORDER BY raw_pos) AS w, count(*) AS n_signs FROM syl JOIN wd USING (seq_id, raw_pos) GROUP BY ALL),
ty AS (SELECT w AS word, CAST(n_signs AS INT) AS n_signs, count(*) AS n, count(DISTINCT seq_id) AS texts FROM sp GROUP BY ALL)
"""
)
SQL = {
    "code_functions": """SELECT bennett_id, regexp_full_match(bennett_id, '(AB|A|NUM|DIV|ADJ|MET|VASE) [0-9A-F]+[A-Z]?') AS valid, regexp_replace(regexp_replace(bennett_id, '^([A-Z]+) 0+(\\d)', '\\1 \\2'), '(\\d)[A-Z]$', '\\1') AS canonical,
lower(regexp_replace(translate(transliteration, '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '[\\[\\]?''+]', '', 'g')) AS plain, replace(replace(replace(replace(transliteration, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml, regexp_replace(bennett_id, '[^\\w.-]+', '_', 'g') AS file FROM sign_list""",
    "cv_labels": _DW + f"SELECT w, CASE WHEN {_RAW} IN ({', '.join(repr(x) for x in T.SHAPES)}) THEN {_RAW} WHEN length(w) >= 6 THEN 'complex' ELSE 'other:' || {_RAW} END AS label FROM dw",
    "cv_split": """SELECT bennett_id, regexp_extract(lower(transliteration), '^([^aeiou\\d]*)', 1) AS onset, coalesce(nullif(regexp_extract(lower(transliteration), '([aeiou])', 1), ''), '-') AS vowel,
CASE WHEN f IN ('a', 'e', 'i', 'o', 'u') THEN 'vowel' WHEN f IN ('p', 'b', 'm', 'f', 'v', 'w') THEN 'labial' WHEN f IN ('t', 'd', 'n', 's', 'z', 'r', 'l', 'š', 'ś', 'ñ', 'ť') THEN 'dental' WHEN f IN ('k', 'g', 'q', 'h') THEN 'velar' WHEN f IN ('j', 'y') THEN 'palatal' ELSE '-' END AS place
FROM (SELECT *, substr(lower(transliteration), 1, 1) AS f FROM sign_list WHERE sign_type = 'syllabogram')""",
    "numeral_values": "SELECT bennett_id, coalesce(try_cast(regexp_extract(bennett_id, '^(?:NUM )?(\\d+)$', 1) AS BIGINT), -1) AS value, round(CASE transliteration WHEN '½' THEN 0.5::DOUBLE WHEN '⅓' THEN 1/3 WHEN '¼' THEN 0.25 WHEN '⅕' THEN 0.2 WHEN '⅙' THEN 1/6 WHEN '⅛' THEN 0.125 WHEN '¾' THEN 0.75 ELSE -1 END, 6) AS fraction FROM sign_list",
    "tokenise_phonemes": _DW + "SELECT w, array_to_string(regexp_extract_all(w, '(sch|str|ch|kr|sh|th|[a-z])', 1), '.') AS units, CAST(len(regexp_extract_all(w, '([b-df-hj-np-tv-z]?[aeiou]|[b-df-hj-np-tv-z])', 1)) AS INT) AS syllables FROM dw",
    "word_frequency": _WT + "SELECT word, n_signs, n, texts FROM ty",
    "word_length_distribution": _WT + "SELECT n_signs, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens FROM ty GROUP BY n_signs",
    "paradigms": _WT
    + """, p AS (SELECT word, string_split(word, '-') AS p, n_signs FROM ty WHERE n_signs >= 2), e AS (
SELECT 'suffix' AS side, k AS size, array_to_string(p[1:n_signs - k], '-') AS root, array_to_string(p[n_signs - k + 1:n_signs], '-') AS affix FROM p, (VALUES (1), (2)) v(k) WHERE n_signs > k
UNION ALL SELECT 'prefix', k, array_to_string(p[k + 1:n_signs], '-'), array_to_string(p[1:k], '-') FROM p, (VALUES (1), (2)) v(k) WHERE n_signs > k)
SELECT side, size, root, count(DISTINCT affix) AS affixes FROM e GROUP BY ALL HAVING count(DISTINCT affix) >= 2""",
    "reduplication": _WT
    + """, p AS (SELECT word, string_split(word, '-') AS p FROM ty), q AS (SELECT *, len(p) AS n FROM p)
SELECT word, concat_ws(',', CASE WHEN n >= 4 AND p[1:2] = p[3:4] THEN 'initial_disyllabic' END, CASE WHEN n >= 3 AND p[1] = p[2] THEN 'initial_sign' END,
CASE WHEN n >= 4 AND len(list_filter(range(1, n - 2), lambda i: p[i + 1:i + 2] = p[i + 2:i + 3])) > 0 THEN 'adjacent_pair' END,
CASE WHEN n >= 5 AND len(list_filter(range(1, n - 2), lambda i: len(list_filter(range(i + 2, n), lambda j: p[i:i + 1] = p[j:j + 1])) > 0)) > 0 THEN 'internal_disyllabic' END,
CASE WHEN n >= 4 AND list_contains(p[3:n], p[1]) THEN 'initial_repeated' END, CASE WHEN n >= 4 AND p[1] = p[n] AND p[2] = p[n - 1] THEN 'chiastic' END) AS patterns FROM q""",
    "weighted_levenshtein": _DW.replace("WITH w", "WITH RECURSIVE w")
    + """, dp(x, i, j, prev, cur) AS (SELECT w, 1, 1, [0.0::DOUBLE, 1, 2, 3, 4, 5], [1.0::DOUBLE] FROM dw UNION ALL
SELECT x, CASE WHEN j < 5 THEN i ELSE i + 1 END, CASE WHEN j < 5 THEN j + 1 ELSE 1 END, CASE WHEN j < 5 THEN prev ELSE list_append(cur, cell) END, CASE WHEN j < 5 THEN list_append(cur, cell) ELSE [(i + 1)::DOUBLE] END
FROM (SELECT *, least(prev[j + 1] + 1, cur[j] + 1, prev[j] + CASE WHEN a = b THEN 0 WHEN k(a) = k(b) THEN 0.5::DOUBLE ELSE 1 END) AS cell FROM (SELECT *, substr(x, i, 1) AS a, substr('stone', j, 1) AS b FROM dp WHERE i <= length(x))))
SELECT dp.x AS w, prev[6] AS cost, round(len(list_intersect(list_distinct(string_split(dp.x, '')), ['s', 't', 'o', 'n', 'e'])) / len(list_distinct(list_concat(string_split(dp.x, ''), ['s', 't', 'o', 'n', 'e']))), 6) AS letters FROM dp WHERE i = length(x) + 1""".replace(
        "k(a) = k(b)", "(SELECT min(g) FROM (VALUES (1, 'aeiou'), (2, 'pbmfvw'), (3, 'tdnszrl'), (4, 'kgqh'), (5, 'jy')) v(g, s) WHERE contains(s, a)) = (SELECT min(g) FROM (VALUES (1, 'aeiou'), (2, 'pbmfvw'), (3, 'tdnszrl'), (4, 'kgqh'), (5, 'jy')) v(g, s) WHERE contains(s, b))"
    ),
}
