"""Visually identical text with different characters (problem 6).

Method: the reference spellings form a trie; a token runs through it as a
weighted edit automaton in which look-alikes and ignorable characters cost
nothing, a change that a reader sees but may overlook (case, an accent, the level
of a digit) costs 1 and every other edit 2. A token that ends at cost 0 takes the
spelling of that node; tokens that match none are normalised by the table alone.
Tokens are handled once per distinct value of a batch, and nothing is shuffled.

What looks alike comes from two sources: compatibility forms by rule from the
Unicode database (full width, mathematical and other styled letters, ligatures and
numerals made of letters; not what is set higher, lower, in a circle or as a
fraction, which a reader sees), and letters of other scripts from a fixed table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table

# Letters of other scripts that are drawn like a Latin letter.
LATIN_LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
# More of them, of Cherokee and Lisu, and small capitals whose shape is that of the small letter.
MORE_LOOKALIKES = {
    "A": "Ꭺꓮ", "B": "Ᏼꓐ", "C": "Ꮯꓚ", "D": "Ꭰꓓ", "E": "Ꭼꓰ", "F": "ꓝ", "G": "Ꮐꓖ", "H": "Ꮋꓧ", "I": "ꓲ", "J": "Ꭻꓙ", "K": "Ꮶꓗ", "L": "Ꮮꓡ", "M": "Ꮇꓟ", "N": "ꓠ", "O": "ꓳ", "P": "Ꮲꓑ",
    "R": "Ꭱꓣ", "S": "Ꮪꓢ", "T": "Ꭲꓔ", "U": "ꓴ", "V": "Ꮩꓦ", "W": "Ꮃꓪ", "X": "ꓫ", "Y": "ꓬ", "Z": "Ꮓꓜ", "c": "ᴄ", "o": "ᴏ", "s": "ꜱ", "u": "ᴜ", "v": "ᴠ", "w": "ᴡ", "z": "ᴢ",
}
# Letters that read as a digit beside real digits.
DIGIT_LOOKALIKES = {"0": "O", "1": "lI|"}
# Marks drawn like an ASCII sign.
SIGN_LOOKALIKES = {"|": "ǀ∣│❘", "+": "➕", "-": "‐‑‒–−⁃", "'": "’ʼ", "*": "∗⁎", ":": "ː∶"}
IGNORED_EXTRA = set("͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ")
#: Compatibility forms that differ from their letters only in style or width.
STYLES = {"<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
_TABLE = {ord(x): c for table_ in (LATIN_LOOKALIKES, MORE_LOOKALIKES, SIGN_LOOKALIKES) for c, xs in table_.items() for x in xs}
_DIGITS = {x: d for d, xs in DIGIT_LOOKALIKES.items() for x in xs}


#: Letters and marks stand below this code point (above: ideographs, tags and private use).
ASSIGNED = 0x20000


@cache
def styled() -> dict[int, str]:
    """Characters that the Unicode database gives as letters, digits or marks in another style, and those."""
    out = {}
    for point in range(0xA0, ASSIGNED):
        kind = unicodedata.decomposition(chr(point)).split(" ")
        if kind[0] in STYLES:
            shown = unicodedata.normalize("NFKD", chr(point))
            if " " not in shown and not any(unicodedata.combining(c) for c in shown):  # a blank there carries a mark
                out[point] = "".join(_TABLE.get(ord(c), c) for c in shown)
    return out

#: Cost of a change that is easily overlooked, and of any other.
ACCENT, EDIT = 1, 2
#: Values a worker remembers before it forgets them all.
MEMO = 200_000


def ignorable(c: str) -> bool:
    """Does not show on the page: format characters, variation selectors, fillers."""
    return unicodedata.category(c) == "Cf" or c in IGNORED_EXTRA or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"


def plain(c: str) -> str:
    """A character's look: half width, one style, Latin, one kind of blank; a ligature is several letters."""
    if c.isascii():
        return " " if c.isspace() else c
    if c.isspace() or unicodedata.category(c) == "Zs":
        return " "
    return _TABLE.get(ord(c)) or styled().get(ord(c), c)


def shown(token: str) -> list[str]:
    """The characters that show on the page, accents apart and ligatures as their letters."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        if not ignorable(c):
            look = plain(c)
            out += look if len(look) > 1 else [c]
    return out


def by_table(token: str) -> str:
    """The form of a token that no reference spelling explains."""
    return unicodedata.normalize("NFC", "".join(map(plain, shown(token))).strip())


def overlooked(c: str) -> str:
    """What is left of a character for a careless reader: small, without its level."""
    return unicodedata.normalize("NFKD", plain(c)).lower()


class Automaton:
    """Trie of the reference spellings and the weighted edit automaton over it."""

    def __init__(self, spellings: list[str], aliases: dict[str, str] | None = None):
        self.words = set(spellings)
        self.aliases = aliases or {}
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for w in sorted(self.words):
            at = 0
            for c in unicodedata.normalize("NFD", w):
                if c not in self.next[at]:
                    self.next.append({})
                    self.word.append(None)
                    self.next[at][c] = len(self.next) - 1
                at = self.next[at][c]
            self.word[at] = self.word[at] or w

    def _looks(self, c: str, digits: bool) -> list[str]:
        p = plain(c)
        out = [c, p, self.aliases.get(c, c)]
        return out + [_DIGITS[p]] if digits and p in _DIGITS else out

    def match(self, token: str, most: int = 0) -> tuple[str | None, int]:
        """The spelling of least cost (first in order among equals) and its cost, or (None, most + 1)."""
        if token in self.words:
            return token, 0
        chars = shown(token)
        while chars and plain(chars[0]) == " ":
            chars.pop(0)
        while chars and plain(chars[-1]) == " ":
            chars.pop()
        digits = any(plain(c).isascii() and plain(c).isdigit() for c in chars)
        states = self._fill({0: 0}, most)
        for c in chars:
            looks, out = self._looks(c, digits), {}
            extra, like = (ACCENT if unicodedata.combining(c) else EDIT), overlooked(c) if most else ""
            for at, cost in states.items():
                if cost + extra <= most:
                    _lower(out, at, cost + extra)  # a character too many
                for edge, to in self.next[at].items():
                    step = cost + (0 if edge in looks else ACCENT if like and overlooked(edge) == like else EDIT)
                    if step <= most:
                        _lower(out, to, step)
            states = self._fill(out, most)
            if not states:
                return None, most + 1
        ends = [(cost, self.word[at]) for at, cost in states.items() if self.word[at] is not None]
        if not ends:
            return None, most + 1
        cost, word = min(ends)
        return word, cost

    def _fill(self, states: dict[int, int], most: int) -> dict[int, int]:
        """Adds the states that a missing character leads to."""
        todo = list(states)
        while todo:
            at = todo.pop()
            for edge, to in self.next[at].items() if most else ():
                cost = states[at] + (ACCENT if unicodedata.combining(edge) else EDIT)
                if cost <= most and _lower(states, to, cost):
                    todo.append(to)
        return states


def _lower(states: dict[int, int], at: int, cost: int) -> bool:
    if states.get(at, cost + 1) <= cost:
        return False
    states[at] = cost
    return True


def canonical_forms(df: DataFrame, fields: dict[str, tuple[list[str], dict[str, str]]], keep: list[str], most: int = 0) -> DataFrame:
    """``keep`` and, per field, ``<field>_form string, <field>_cost int``.

    ``fields`` maps a column to its reference spellings (a vocabulary of at most
    some thousands) and further look-alikes. ``cost`` is 0 where the value is or
    looks like the spelling in ``form``; with ``most`` above 0 also the nearest
    spelling within that cost; -1 where the table alone gave the form. Null
    and empty values keep themselves and have a null cost. Rows stay one to one;
    texts of any length are read whole.
    """
    automata = {f: Automaton(*v) for f, v in fields.items()}
    shared = df.sparkSession.sparkContext.broadcast(automata)
    types = dict(df.dtypes)
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, dict] = {f: {} for f in names}
        for batch in batches:
            cols = [batch.column(i) for i in range(len(keep))]
            for i, f in enumerate(names):
                auto, known = shared.value[f], memo[f]
                if len(known) > MEMO:
                    known.clear()
                coded = pc.dictionary_encode(batch.column(len(keep) + i))
                forms, costs = [], []
                for v in coded.dictionary.to_pylist():
                    if v not in known:
                        word, cost = auto.match(v, most) if v else (v, None)
                        known[v] = (by_table(v), -1) if word is None else (word, cost)
                    forms.append(known[v][0])
                    costs.append(known[v][1])
                cols += [pc.take(pa.array(forms, pa.string()), coded.indices), pc.take(pa.array(costs, pa.int32()), coded.indices)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(x for f in names for x in (f"{f}_form", f"{f}_cost"))])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"{f}_form string, {f}_cost int" for f in names)])
    return df.select(*keep, *(F.col(f).cast("string") for f in names)).mapInArrow(run, schema)


FIELDS = ["unicode", "character", "transliteration"]


def _spellings(spark: SparkSession, sf_dir: str) -> dict[str, tuple[list[str], dict[str, str]]]:
    rows = table(spark, sf_dir, "sign_list").select(*FIELDS, "linear_b_character").collect()  # the fixed sign list
    out = {f: (sorted({r[f] for r in rows if r[f]}), {}) for f in FIELDS}
    out["character"] = (out["character"][0], {r.linear_b_character: r.character for r in rows if r.linear_b_character and r.character})
    return out


def p6_deviating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign, field, value and the spelling it looks like, for values that are not that spelling."""
    spellings = _spellings(spark, sf_dir)
    signs = table(spark, sf_dir, "signs").select("id", *FIELDS)
    # values of the list itself and missing ones need no automaton
    odd = {f: F.when(~F.col(f).isin(spellings[f][0]) & (F.col(f) != ""), F.col(f)) for f in FIELDS}
    rows = signs.select("id", *(odd[f].alias(f) for f in FIELDS), *(odd[f].alias(f"raw_{f}") for f in FIELDS)).filter(F.coalesce(*FIELDS).isNotNull())
    forms = canonical_forms(rows, spellings, ["id", *(f"raw_{f}" for f in FIELDS)])
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"raw_{f}").alias("value"), F.col(f"{f}_form").alias("form"), F.col(f"{f}_cost").alias("cost")) for f in FIELDS)))
    hits = forms.select(F.col("id").alias("sign_id"), each.alias("e")).select("sign_id", "e.*").filter("cost = 0")
    return hits.select("sign_id", "field_name", "value", "form").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_deviating(spark, sf_dir).select("sign_id", "field_name").distinct()


def p6_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sign record with one form per field; of a record delivered with several, the least form."""
    forms = canonical_forms(table(spark, sf_dir, "signs"), _spellings(spark, sf_dir), ["id"])
    return forms.groupBy(F.col("id").alias("sign_id")).agg(*(F.min(f"{f}_form").alias(f"{f}_form") for f in FIELDS))


def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values that look like no spelling, each with the spelling of least cost within one edit, and that cost."""
    spellings = _spellings(spark, sf_dir)
    signs = table(spark, sf_dir, "signs").select(*FIELDS)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS)))
    values = signs.select(each.alias("e")).select("e.*").filter("value <> ''").distinct()
    cols = {f: F.when(F.col("field_name") == f, F.col("value")) for f in FIELDS}
    forms = canonical_forms(values.select("field_name", "value", *(c.alias(f) for f, c in cols.items())), spellings, ["field_name", "value"], EDIT)
    form, cost = (F.coalesce(*(F.when(F.col("field_name") == f, F.col(f"{f}_{k}")) for f in FIELDS)) for k in ("form", "cost"))
    return forms.select("field_name", "value", form.alias("form"), cost.alias("cost")).filter("cost > 0")


QUERIES = {"p6_found": p6_found, "p6_deviating": p6_deviating, "p6_normalized": p6_normalized, "p6_nearest": p6_nearest}


def _sql() -> dict[str, str]:
    """The same forms by replacing characters: every spelling of sign_list is its own plain form."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    single = {chr(p): c for p, c in {**styled(), **_TABLE}.items() if len(c) == 1} | {c: " " for c in map(chr, range(0x80, ASSIGNED)) if (c.isspace() or unicodedata.category(c) == "Zs")}
    single |= {c: " " for c in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"}
    unseen = "".join(c for c in map(chr, [*range(1, ASSIGNED), *range(0xE0000, 0xE0200)]) if not 0xD800 <= ord(c) <= 0xDFFF and ignorable(c))
    mapped = f"trim(nfc_normalize(translate(translate(value, {quote(unseen)}, ''), {quote(''.join(single))}, {quote(''.join(single.values()))})), ' ')"
    aliased = "CASE WHEN field_name = 'character' THEN coalesce((SELECT min(character) FROM sign_list l WHERE l.linear_b_character = m), m) ELSE m END"
    base = f"""
WITH sp AS (SELECT DISTINCT * FROM (SELECT 'unicode' AS field_name, unicode AS form FROM sign_list UNION ALL SELECT 'character', character FROM sign_list UNION ALL SELECT 'transliteration', transliteration FROM sign_list) WHERE form <> ''),
v0 AS (SELECT DISTINCT * FROM (SELECT id, 'unicode' AS field_name, unicode AS value FROM signs UNION ALL SELECT id, 'character', character FROM signs UNION ALL SELECT id, 'transliteration', transliteration FROM signs)),
v1 AS (SELECT DISTINCT field_name, value, {mapped} AS m FROM v0 WHERE value <> ''),
v2 AS (SELECT *, {aliased} AS ma, CASE WHEN regexp_matches(m, '[0-9]') THEN translate(m, 'OlI|', '0111') ELSE m END AS md FROM v1),
v3 AS (SELECT v2.field_name, value, m, min(sp.form) AS form FROM v2 LEFT JOIN sp ON sp.field_name = v2.field_name AND (sp.form = value OR sp.form = m OR sp.form = ma OR sp.form = md) GROUP BY ALL),
dev AS (SELECT id AS sign_id, field_name, value, form FROM v0 JOIN v3 USING (field_name, value) WHERE form IS NOT NULL AND (field_name, value) NOT IN (SELECT field_name, form FROM sp))
"""
    cell = lambda f: f"min(CASE WHEN field_name = '{f}' THEN CASE WHEN value = '' THEN '' WHEN (field_name, value) IN (SELECT field_name, form FROM sp) THEN value ELSE coalesce(form, m) END END) AS {f}_form"
    return {
        "p6_found": base + "SELECT DISTINCT sign_id, field_name FROM dev",
        "p6_deviating": base + "SELECT * FROM dev",
        "p6_normalized": base + f"SELECT id AS sign_id, {', '.join(map(cell, FIELDS))} FROM v0 LEFT JOIN v3 USING (field_name, value) GROUP BY id",
    }


def __getattr__(name: str):
    """``SQL`` is made when asked for: workers that import this module never need it."""
    if name == "SQL":
        return _sql()
    raise AttributeError(name)
