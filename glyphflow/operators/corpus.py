"""The relational corpus: search, listings, set algebra, upserts and dictionary checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sequences import CLEAN_SQL, TOKENS_SQL, all_tokens, grams, r6
from ..tables import clean_code, table

NAMES = ["findspots", "inscriptions", "signs", "sign_semantics", "words", "reduplication_patterns", "sign_list"]


def open_store(spark: SparkSession, sf_dir: str, names: list[str] = NAMES) -> dict[str, DataFrame]:
    """The tables of a store, each also a temporary view."""
    out = {n: table(spark, sf_dir, n) for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Last version wins: one row per key, of the greatest ``version``, ties by all other columns.

    The greatest struct is an aggregate combined map-side, so a key delivered
    millions of times costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [*version, *(c for c in rest if c not in version)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__v"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__v.{c}").alias(c) for c in df.columns))


def upsert(store: DataFrame, delta: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Insert or replace: the store with the delta's rows in place of those with the same keys, if not older."""
    return latest(store.unionByName(delta), keys, version)


def insert_ignore(dimension: DataFrame, new: DataFrame, key: str, id_column: str) -> DataFrame:
    """The dimension plus new keys, numbered on from its greatest id in order of the key."""
    known = dimension.select(key).filter(F.col(key).isNotNull())
    fresh = new.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")
    top = dimension.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("__top"))
    bins = fresh.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(64)))
    sizes = bins.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).alias("__before"))  # 64 rows
    numbered = bins.withColumn("__r", F.row_number().over(W.partitionBy("__b").orderBy(key))).join(F.broadcast(before), "__b").crossJoin(F.broadcast(top))
    rows = numbered.select((F.col("__top") + F.col("__before") + F.col("__r")).cast("long").alias(id_column), key)
    return dimension.select(id_column, key).unionByName(rows)


def delete_related(child: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return child.join(ids.select(key), key, "left_anti")


def search(inscriptions: DataFrame, findspots: DataFrame, site=None, period=None, material=None, object_type=None, limit: int | None = None) -> DataFrame:
    """Rows that meet every stated condition: contains for text fields (any case), equality for the period."""
    rows = inscriptions.join(findspots.select(F.col("id").alias("findspot_id"), "site"), "findspot_id", "left")
    like = {"site": site, "material": material, "object_type": object_type}
    wanted: list[Column] = [F.lower(F.col(c)).contains(v.lower()) for c, v in like.items() if v]
    if period:
        wanted.append(F.col("minoan_period") == period)
    kept = rows.filter(reduce(lambda a, b: a & b, wanted)) if wanted else rows
    kept = kept.dropDuplicates(["id"])
    return kept.orderBy("id").limit(limit) if limit else kept


def having_all(tokens: DataFrame, symbols: list[str]) -> DataFrame:
    """Relational division: sequences that hold every one of the symbols, in any order."""
    hit = tokens.filter(F.col("symbol").isin(symbols)).groupBy("seq_id").agg(F.count_distinct("symbol").alias("n"))
    return hit.filter(F.col("n") == len(set(symbols))).select("seq_id")


def having_run(tokens: DataFrame, symbols: list[str]) -> DataFrame:
    """Sequences that hold the symbols one behind the other, with the first place."""
    hit = grams(tokens, len(symbols)).filter(F.col("gram") == F.array(*map(F.lit, symbols)))
    return hit.groupBy("seq_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("hits"))


def listing(inscriptions: DataFrame, signs: DataFrame) -> DataFrame:
    """Every inscription with its number of sign records."""
    n = signs.groupBy(F.col("inscription_id").alias("id")).agg(F.count_distinct("id").alias("n_signs"))
    return inscriptions.select("id", "gorila_id").distinct().join(n, "id", "left").withColumn("n_signs", F.coalesce("n_signs", F.lit(0)))


def hydrate(inscriptions: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], key: str = "inscription_id") -> DataFrame:
    """Documents: each inscription with one sorted array of structs per child table."""
    out = inscriptions
    for name, (child, cols) in children.items():
        grouped = child.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(F.struct(*cols))).alias(name))
        out = out.join(grouped, "id", "left")
    return out


def corpus_stats(inscriptions: DataFrame, signs: DataFrame) -> DataFrame:
    named = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    a = inscriptions.agg(F.count_distinct("id").alias("inscriptions"), named("minoan_period").alias("periods"), named("material").alias("materials"), F.min("bce_from").alias("min_from"), F.max("bce_to").alias("max_to"))
    b = signs.agg(F.count_distinct("id").alias("signs"), F.count_distinct(clean_code(F.col("bennett_id"))).alias("codes"))
    return a.crossJoin(b)  # one row each


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def dictionary_violations(sign_list: DataFrame) -> DataFrame:
    """Repeated ids or code points, malformed code points, and characters that are not their code point."""
    many = lambda c, why: sign_list.groupBy(c).count().filter("count > 1").select(F.col(c).cast("string").alias("value"), F.lit(why).alias("violation"))
    shape = sign_list.filter("unicode is not null and not unicode rlike '^U\\\\+[0-9A-F]{4,6}$'").select(F.col("unicode").alias("value"), F.lit("malformed").alias("violation"))
    point = F.conv(F.substring("unicode", 3, 6), 16, 10).cast("long")
    differ = sign_list.filter(F.col("unicode").rlike("^U\\+[0-9A-F]{4,6}$") & (point != F.ascii("character"))).select(F.col("bennett_id").alias("value"), F.lit("differs").alias("violation"))
    return reduce(DataFrame.unionByName, [many("bennett_id", "repeated id"), many("unicode", "repeated code point"), shape, differ]).filter("value is not null")


# Words of object types and materials that tell a text's class.
SACRED_MATERIALS = ["stone", "metal", "gold", "silver", "bronze", "marble"]
SACRED_OBJECTS = ["votive", "altar", "dedication", "libation", "table", "offering", "vessel", "cup", "bowl", "ring", "seal", "pendant", "statuette", "figurine", "double axe", "sacred", "temple"]
OFFICE_OBJECTS = ["tablet", "page-shaped", "palm-leaf", "roundel", "sealing", "label", "nodule", "bar", "account", "ledger"]
# Whole object types of the other classification.
OFFICE_TYPES = ["tablet (page-shaped)", "roundel", "Nodule", "Lames (short thin tablet)", "Label", "4-sided bar", "Clay vessel", "metal object", "ivory object"]
SACRED_TYPES = ["stone vessel", "Stone object", "Graffito"]
# What an object type says about its material, the first hit counts.
MATERIALS = [(("tablet", "roundel", "sealing"), "clay"), (("stone", "libation"), "stone"), (("metal",), "metal"), (("bone",), "bone"), (("ivory",), "ivory"), (("fresco",), "fresco/plaster"), (("pottery", "vase", "vessel"), "pottery/ceramic")]
# Hints in a transliteration, and sign numbers of known commodities.
COMMODITY_HINTS = [("VIN", "WINE"), ("OLE", "OLIVE_OIL"), ("OLIV", "OLIVES"), ("GRA", "GRAIN"), ("TELA", "CLOTH"), ("VIR", "MANPOWER"), ("CAP", "LIVESTOCK"), ("HIDE", "HIDES"), ("AROM", "AROMATICS")]
COMMODITY_SIGNS = {
    "PERSONNEL": [301], "LIVESTOCK": [302, 303, 304, 305, 306, 307], "HIDES": [308], "GRAIN": [309, 364, 386, 399, 400, 402], "WINE": [310], "OLIVE_OIL": [311, 381], "VESSELS": [327, 333, 335, 338, 339], "MANPOWER": [394, 395],
}


def text_class(object_type: Column, material: Column) -> Column:
    """religious, administrative or unknown: by material, then by the words of the object type; clay is administrative."""
    m = F.lower(F.coalesce(material, F.lit("")))
    words = F.split(F.lower(F.coalesce(object_type, F.lit(""))), r"[\s()-]+")
    some = lambda w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    return F.when(m.isin(SACRED_MATERIALS) | some(SACRED_OBJECTS), "religious").when(some(OFFICE_OBJECTS) | (m == "clay"), "administrative").otherwise("unknown")


def object_class(object_type: Column) -> Column:
    """The other classification, by whole object types."""
    return F.when(object_type.isin(OFFICE_TYPES), "administrative").when(object_type.isin(SACRED_TYPES), "religious/dedicatory").otherwise("other")


def guess_material(object_type: Column) -> Column:
    """The material that an object type suggests; null for none."""
    t = F.lower(object_type)
    out = F.lit(None).cast("string")
    for hints, name in reversed(MATERIALS):
        out = F.when(reduce(lambda a, b: a | b, [t.contains(x) for x in hints]), name).otherwise(out)
    return out


def commodity_class(code: Column, text: Column) -> Column:
    """Class of a commodity: hints in the transliteration, vessels by their code, then known sign numbers."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    out = F.when(code.startswith("A 3"), "UNKNOWN_COMMODITY").otherwise("UNCLASSIFIED")
    for name, numbers in COMMODITY_SIGNS.items():
        out = F.when(code.isin([f"A {n}" for n in numbers]), name).otherwise(out)
    out = F.when(code.startswith("VASE"), "VESSELS").otherwise(out)
    for hint, name in reversed(COMMODITY_HINTS):
        out = F.when(t.contains(hint), name).otherwise(out)
    return out


def uncertain(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "") | value.contains("?")


def strip_uncertain(value: Column) -> Column:
    return F.nullif(F.trim(F.rtrim(F.regexp_replace(value, r"\?+\s*$", ""))), F.lit(""))


def sites_like(findspots: DataFrame, parts: list[str]) -> DataFrame:
    any_of = reduce(lambda a, b: a | b, [F.lower("site").contains(p.lower()) for p in parts])
    return findspots.filter(any_of)


def _ins(s, d):
    return latest(table(s, d, "inscriptions").select("id", "gorila_id", "findspot_id", "minoan_period", "material", "object_type", "bce_from", "bce_to", "updated_at"), ["id"], ["updated_at"])


def _spots(s, d):
    return table(s, d, "findspots").groupBy("id").agg(F.min("site").alias("site"))


def _by_year(s, d, y):
    return table(s, d, "lineitem").filter(F.year("l_shipdate") == y).select("l_partkey").distinct()


QUERIES = {
    "point_lookup": lambda s, d: search(_ins(s, d).filter("id = 1010"), _spots(s, d)).select("id", "gorila_id", "site"),
    "search_conjunctive": lambda s, d: search(_ins(s, d), _spots(s, d), site="ar", period="LM IB", material="clay").select("id", "site", "material"),
    "search_all_of": lambda s, d: having_all(all_tokens(s, d), ["AB 73", "AB 14", "NUM 1"]),
    "search_contiguous": lambda s, d: having_run(all_tokens(s, d), ["AB 73", "AB 14"]),
    "listing_with_counts": lambda s, d: listing(table(s, d, "inscriptions"), table(s, d, "signs")),
    "corpus_stats": lambda s, d: corpus_stats(table(s, d, "inscriptions"), table(s, d, "signs")),
    "child_scan": lambda s, d: table(s, d, "signs").select("id", "inscription_id", "sequence").distinct().join(table(s, d, "sign_semantics").groupBy(F.col("sign_id").alias("id")).agg(F.max("numeric_value").alias("v")), "id", "left").select("id", "inscription_id", "sequence", F.coalesce("v", F.lit(-1)).alias("numeric_value")),
    "hydrate_documents": lambda s, d: hydrate(table(s, d, "inscriptions").select("id").distinct(), {"signs": (table(s, d, "signs").withColumn("code", clean_code(F.col("bennett_id"))), ["sequence", "code"])}).select("id", F.array_join(F.transform("signs", lambda x: F.coalesce(x["code"], F.lit("?"))), " ").alias("text")),
    "code_frequency": lambda s, d: frequency(all_tokens(s, d), "symbol"),
    "dedup_last_wins": lambda s, d: latest(table(s, d, "documents").select("text", "doc_id", "n_chars").filter("text is not null"), ["text"], ["doc_id"]).select("doc_id", F.coalesce("n_chars", F.lit(-1)).alias("n_chars")),
    "upsert_inscriptions": lambda s, d: upsert(*(table(s, d, "inscriptions").filter(f"id % 2 = {k} or updated_at > created_at").select("id", "updated_at", "findspot_id") for k in (0, 1)), ["id"], ["updated_at"]).select("id", F.coalesce("findspot_id", F.lit(-1)).alias("findspot_id")),
    "insert_ignore_sites": lambda s, d: insert_ignore(_spots(s, d).filter("site is not null"), table(s, d, "documents").select("site"), "site", "id").agg(F.count("*").alias("sites"), F.count_distinct("id").alias("ids"), F.max("id").alias("max_id")),
    "set_intersect": lambda s, d: _by_year(s, d, 1996).intersect(_by_year(s, d, 1997)),
    "set_difference": lambda s, d: _by_year(s, d, 1996).subtract(_by_year(s, d, 1997)),
    "dictionary_check": lambda s, d: dictionary_violations(table(s, d, "sign_list")),
    "text_class": lambda s, d: _ins(s, d).select("id", text_class(F.col("object_type"), F.col("material")).alias("cls"), object_class(F.col("object_type")).alias("object_cls"), guess_material(F.col("object_type")).alias("guess")),
    "commodity_class": lambda s, d: table(s, d, "sign_list").select("bennett_id", commodity_class(F.col("bennett_id"), F.col("transliteration")).alias("cls")),
    "sites_like": lambda s, d: sites_like(_spots(s, d), ["ar", "ko"]),
    "uncertain_values": lambda s, d: table(s, d, "signs").select("id", uncertain(F.col("transliteration")).alias("unsure"), strip_uncertain(F.col("transliteration")).alias("bare")).distinct(),
    "price_segments": lambda s, d: table(s, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 100000").groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.avg("o_totalprice")).alias("mean_price")),
}

_INS_SQL = """WITH i0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, gorila_id DESC NULLS LAST, findspot_id DESC NULLS LAST, minoan_period DESC NULLS LAST, material DESC NULLS LAST, object_type DESC NULLS LAST) AS r FROM inscriptions),
ins AS (SELECT * FROM i0 WHERE r = 1), sp AS (SELECT id AS sid, min(site) AS site FROM findspots GROUP BY id)
"""
_WORDS = "regexp_split_to_array(lower(coalesce(object_type, '')), '[\\s()-]+')"
_Q = lambda xs: ", ".join(f"'{x}'" for x in xs)
SQL = {
    "point_lookup": _INS_SQL + "SELECT id, gorila_id, site FROM ins LEFT JOIN sp ON sid = findspot_id WHERE id = 1010",
    "search_conjunctive": _INS_SQL + "SELECT id, site, material FROM ins LEFT JOIN sp ON sid = findspot_id WHERE lower(site) LIKE '%ar%' AND minoan_period = 'LM IB' AND lower(material) LIKE '%clay%'",
    "search_all_of": TOKENS_SQL + "SELECT seq_id FROM tok WHERE symbol IN ('AB 73', 'AB 14', 'NUM 1') GROUP BY seq_id HAVING count(DISTINCT symbol) = 3",
    "search_contiguous": TOKENS_SQL + "SELECT seq_id, min(pos) AS first_pos, count(*) AS hits FROM (SELECT *, lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM tok) WHERE symbol = 'AB 73' AND nx = 'AB 14' GROUP BY seq_id",
    "listing_with_counts": "SELECT i.id, gorila_id, coalesce(n, 0) AS n_signs FROM (SELECT DISTINCT id, gorila_id FROM inscriptions) i LEFT JOIN (SELECT inscription_id, count(DISTINCT id) AS n FROM signs GROUP BY 1) s ON s.inscription_id = i.id",
    "corpus_stats": f"""SELECT * FROM (SELECT count(DISTINCT id) AS inscriptions, count(DISTINCT nullif(minoan_period, '')) AS periods, count(DISTINCT nullif(material, '')) AS materials, min(bce_from) AS min_from, max(bce_to) AS max_to FROM inscriptions),
(SELECT count(DISTINCT id) AS signs, count(DISTINCT {CLEAN_SQL}) AS codes FROM signs)""",
    "child_scan": "SELECT s.id, inscription_id, sequence, coalesce(numeric_value, -1) AS numeric_value FROM (SELECT DISTINCT id, inscription_id, sequence FROM signs) s LEFT JOIN (SELECT sign_id, max(numeric_value) AS numeric_value FROM sign_semantics GROUP BY 1) m ON m.sign_id = s.id",
    "hydrate_documents": f"SELECT i.id, text FROM (SELECT DISTINCT id FROM inscriptions) i LEFT JOIN (SELECT inscription_id, string_agg(coalesce(c, '?'), ' ' ORDER BY sequence) AS text FROM (SELECT DISTINCT inscription_id, sequence, {CLEAN_SQL} AS c FROM signs) GROUP BY 1) s ON s.inscription_id = i.id",
    "code_frequency": TOKENS_SQL + "SELECT symbol, count(*) AS n FROM tok GROUP BY symbol",
    "dedup_last_wins": "SELECT doc_id, coalesce(n_chars, -1) AS n_chars FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1",
    "upsert_inscriptions": "SELECT id, coalesce(max(findspot_id), -1) AS findspot_id FROM inscriptions WHERE (id % 2 IN (0, 1)) GROUP BY id",
    "insert_ignore_sites": "WITH sp AS (SELECT id, min(site) AS site FROM findspots GROUP BY id), k AS (SELECT DISTINCT site FROM documents WHERE site IS NOT NULL EXCEPT SELECT site FROM sp) SELECT (SELECT count(*) FROM sp WHERE site IS NOT NULL) + count(*) AS sites, (SELECT count(*) FROM sp WHERE site IS NOT NULL) + count(*) AS ids, (SELECT max(id) FROM sp WHERE site IS NOT NULL) + count(*) AS max_id FROM k",
    "set_intersect": "SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1996 INTERSECT SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1997",
    "set_difference": "SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1996 EXCEPT SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1997",
    "dictionary_check": """SELECT * FROM (SELECT bennett_id AS value, 'repeated id' AS violation FROM sign_list GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT unicode, 'repeated code point' FROM sign_list GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT unicode, 'malformed' FROM sign_list WHERE NOT regexp_full_match(unicode, 'U\\+[0-9A-F]{4,6}')
UNION ALL SELECT bennett_id, 'differs' FROM sign_list WHERE regexp_full_match(unicode, 'U\\+[0-9A-F]{4,6}') AND CAST('0x' || substr(unicode, 3) AS BIGINT) <> unicode(character)) WHERE value IS NOT NULL""",
    "text_class": _INS_SQL
    + f"""SELECT id, CASE WHEN lower(coalesce(material, '')) IN ({_Q(SACRED_MATERIALS)}) OR list_has_any({_WORDS}, [{_Q(SACRED_OBJECTS)}]) THEN 'religious' WHEN list_has_any({_WORDS}, [{_Q(OFFICE_OBJECTS)}]) OR lower(material) = 'clay' THEN 'administrative' ELSE 'unknown' END AS cls,
CASE WHEN object_type IN ({_Q(OFFICE_TYPES)}) THEN 'administrative' WHEN object_type IN ({_Q(SACRED_TYPES)}) THEN 'religious/dedicatory' ELSE 'other' END AS object_cls,
CASE {' '.join(f"WHEN regexp_matches(lower(object_type), '{'|'.join(h)}') THEN '{n}'" for h, n in MATERIALS)} END AS guess FROM ins""",
    "commodity_class": f"""SELECT bennett_id, CASE {' '.join(f"WHEN contains(t, '{h}') THEN '{n}'" for h, n in COMMODITY_HINTS)} WHEN bennett_id LIKE 'VASE%' THEN 'VESSELS'
{' '.join(f"WHEN bennett_id IN ({_Q([f'A {x}' for x in v])}) THEN '{n}'" for n, v in COMMODITY_SIGNS.items())} WHEN bennett_id LIKE 'A 3%' THEN 'UNKNOWN_COMMODITY' ELSE 'UNCLASSIFIED' END AS cls FROM (SELECT bennett_id, upper(trim(coalesce(transliteration, ''), ' ')) AS t FROM sign_list)""",
    "sites_like": "SELECT * FROM (SELECT id, min(site) AS site FROM findspots GROUP BY id) WHERE lower(site) LIKE '%ar%' OR lower(site) LIKE '%ko%'",
    "uncertain_values": "SELECT DISTINCT id, transliteration IS NULL OR trim(transliteration, ' ') = '' OR contains(transliteration, '?') AS unsure, nullif(trim(regexp_replace(transliteration, '\\?+\\s*$', ''), ' '), '') AS bare FROM signs",
    "price_segments": "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY 1",
}
