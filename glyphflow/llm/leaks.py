"""Evaluation texts leaking into training text (problem 7).

Method: SimHash of item-sized windows. Every window of ``size`` words of a
document gets a 64-bit SimHash of its weighted word shingles. The items' windows
stand in a multi-index: the fingerprint is cut into radius + 1 blocks, and two
fingerprints within the radius agree in one block at least, so looking up every
block finds them all. Fingerprints of similar windows may lie further apart, so a
prefix filter on the shingles finds the rest: of an item's window, in order of
hash, only the first shingles are indexed, until what is left weighs too little
for the similarity; a similar window holds one of them. Candidates are verified
by the exact similarity of their weighted shingles.

Without a stated ``size`` windows are as long as the item: lengths form classes a
quarter apart, an item is cut into windows of the class just below its own length,
and one pass over a document serves all classes. TESTDATA.md defines a leak by 12
equal words: :func:`p7_found` takes windows of 12 and asks for equal words, which
have equal fingerprints, so it leaves the prefix filter out.

The items are a stated query set: their windows are counted, cut into slices of
at most ``SLICE`` and broadcast slice by slice, each slice another pass over the
documents. These are shuffled only where they come in fewer splits than twice
the cores.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import spread
from ..tables import table

#: Words of a window and of a shingle, radius of the search, windows of items in one broadcast.
SIZE, SHINGLE, RADIUS, SLICE = 12, 5, 3, 500_000
#: Words that are fingerprinted at once; characters from which on a text is read in pieces.
BLOCK, LONG = 1 << 15, 1 << 22
#: Step from one class of window lengths to the next.
CLASS_STEP = 1.25
WORD = re.compile(r"[^\W_]+")
_U = np.uint64


class _Words(dict):
    """Word as written to (hash of its lower case, letters)."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return h


def _mix(h):
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def _shingles(words, letters, shingle):
    """Hash and weight (its letters) of the shingle that starts at each word; len(words) - shingle + 1 of them."""
    m = len(words) - shingle + 1
    h, w = np.zeros(m, _U), np.zeros(m, np.int32)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            h = h * _U(0x9E3779B97F4A7C15) + words[k : k + m]
            w = w + letters[k : k + m]
    return _mix(h), w


def _votes(hashes, weights):
    """Running sums of the weighted bits of shingles, and of their weights."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits * weights[:, None], axis=0, out=votes[1:])
    return votes, np.r_[0, np.cumsum(weights)]


def _fingerprints(hashes, weights, per, votes=None):
    """SimHash of every ``per`` consecutive shingles."""
    votes, total = votes or _votes(hashes, weights)
    m = len(total) - per
    on = 2 * (votes[per:] - votes[:m]) > (total[per:] - total[:m])[:, None]
    return np.packbits(on, axis=1).view(">u8").ravel().astype(_U)


def window_size(words: int, shingle: int = SHINGLE) -> int:
    """The class of an item's length: the longest class that is no longer than the item."""
    size = float(shingle)
    while max(int(size * CLASS_STEP), int(size) + 1) <= words:
        size = max(int(size * CLASS_STEP), int(size) + 1)
    return int(size)


class Index:
    """Windows of the items in a multi-index over blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], size: int, shingle: int, radius: int, least: float | None = None):
        self.size, self.shingle, self.radius, self.per = size, shingle, radius, size - shingle + 1
        known = _Words()
        rows = []
        for item, text in items:
            found = WORD.findall(text or "")
            if len(found) < size:
                continue
            words = np.fromiter(map(known.__getitem__, found), _U, len(found))
            letters = np.fromiter(map(len, found), np.int32, len(found))
            h, w = _shingles(words, letters, shingle)
            f = _fingerprints(h, w, self.per)
            at = np.arange(len(f))
            rows.append((np.full(len(f), item, np.int64), at, f, h[at[:, None] + np.arange(self.per)], w[at[:, None] + np.arange(self.per)], words[at[:, None] + np.arange(size)]))
        self.n = sum(len(r[0]) for r in rows)
        if not self.n:
            return
        self.item, self.at, self.f, self.h, self.w, self.words = (np.concatenate(x) for x in zip(*rows, strict=True))
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            value = self._block(self.f, lo, hi)
            order = np.argsort(value, kind="stable")
            self.blocks.append((lo, hi, value[order], order))
        if least is not None:
            self._prefixes(least)

    def _prefixes(self, least: float):
        """Shingles of which a window with similarity ``least`` to one of the items holds at least one."""
        order = np.argsort(self.h, axis=1, kind="stable")
        h, w = np.take_along_axis(self.h, order, 1), np.take_along_axis(self.w, order, 1).astype(np.int64)
        w[:, 1:] *= h[:, 1:] != h[:, :-1]  # sets of shingles
        before = np.cumsum(w, 1) - w
        window, place = np.nonzero((w > 0) & (w.sum(1)[:, None] - before >= least * w.sum(1)[:, None] * (1 - 1e-9)))
        value = h[window, place]
        by = np.argsort(value, kind="stable")
        self.prefix = value[by], window[by]

    def sharing(self, h, inside) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window that starts at a place in ``inside``, window of an item) that share a shingle of the item's prefix."""
        values, windows = self.prefix
        ok = np.zeros(len(h) + 1, bool)
        ok[inside] = True
        first, last = np.searchsorted(values, h, "left"), np.searchsorted(values, h, "right")
        hit, out = np.flatnonzero(last > first), []
        ends, lo = np.cumsum((last - first)[hit]), 0
        while lo < len(hit):  # in slices of about a million candidates
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000 // self.per, "right")))
            part = hit[lo:hi]
            n = (last - first)[part]
            s = np.repeat(part, n)
            j = windows[np.repeat(first[part], n) + np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)]
            i = (s[:, None] - np.arange(self.per)).ravel()
            j = np.repeat(j, self.per)
            good = i >= 0
            good[good] = ok[i[good]]
            out.append(np.unique((i[good] << 32) | j[good]))
            lo = hi
        pairs = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
        return pairs >> 32, pairs & 0xFFFFFFFF

    @staticmethod
    def _block(f, lo, hi):
        return (f >> _U(lo)) & _U((1 << (hi - lo)) - 1)

    def near(self, f) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in f, window of an item) whose fingerprints differ in at most ``radius`` bits."""
        out = []
        for lo, hi, values, order in self.blocks:
            v = self._block(f, lo, hi)
            first, last = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            n = last - first
            hit = np.flatnonzero(n)
            step = 1_000_000
            ends = np.cumsum(n[hit])
            lo_i = 0
            while lo_i < len(hit):  # in slices of about a million candidates
                base = ends[lo_i - 1] if lo_i else 0
                hi_i = max(lo_i + 1, int(np.searchsorted(ends, base + step, "right")))
                part = hit[lo_i:hi_i]
                i = np.repeat(part, n[part])
                within = np.arange(len(i)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                j = order[np.repeat(first[part], n[part]) + within]
                close = np.bitwise_count(f[i] ^ self.f[j]) <= self.radius
                out.append((i[close] << 32) | j[close])
                lo_i = hi_i
        pairs = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
        return pairs >> 32, pairs & 0xFFFFFFFF

    def similarity(self, h, w, j) -> np.ndarray:
        """Weighted Jaccard similarity of the sets of shingles."""
        out = np.empty(len(j))
        step = max(1, 3_200_000 // self.per**2)
        for s in range(0, len(j), step):
            a, wa, b, wb = h[s : s + step], w[s : s + step], self.h[j[s : s + step]], self.w[j[s : s + step]]
            once = lambda x: ~np.tril(x[:, :, None] == x[:, None, :], -1).any(2)
            ua, ub = once(a), once(b)
            both = (wa * (ua & (a[:, :, None] == b[:, None, :]).any(2))).sum(1)
            out[s : s + step] = both / np.maximum(1, (wa * ua).sum(1) + (wb * ub).sum(1) - both)
        return out


def _pieces(text: str, size: int) -> Iterator[list[str]]:
    """The words of a text; of a very long one in pieces that overlap by size - 1 words."""
    if len(text) <= LONG:
        yield WORD.findall(text)
        return
    found, held = (m.group() for m in WORD.finditer(text)), []
    while piece := list(islice(found, 500_000)):
        yield held + piece
        held = (held + piece)[-(size - 1) :]


def leaked(docs: DataFrame, items: DataFrame, size: int | None = SIZE, shingle: int = SHINGLE, radius: int = RADIUS, least: float = 0.8, similar: bool = True) -> DataFrame:
    """``doc_id, item_id, n_windows, n_item_windows, best, same``: documents with a window like one of an item.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``. A pair comes out when
    a window of ``size`` words of the document (None: about as many as the item has)
    has a similarity of its weighted ``shingle``-word shingles to those of one of the
    item of at least ``least``; without ``similar`` only if their fingerprints are
    within ``radius`` too. ``n_windows`` counts the document's such windows, ``best``
    is the highest similarity, ``n_item_windows`` the item's windows with equal words
    in the document, and ``same`` whether there is one. Null or empty texts and items
    shorter than a window (a shingle) give no rows; null ids are left out; repeated
    ids are looked at one by one and their rows merge; further columns are ignored.
    """
    spark = docs.sparkSession
    wanted = items.filter("item_id is not null and text is not null").select("item_id", "text")
    slices: list[dict[int, list]] = [{}]
    n = 0
    for row in wanted.toLocalIterator():
        words = len(WORD.findall(row.text))
        length = size or window_size(words, shingle)
        if words < length:
            continue
        cost = (words - length + 1) * max(1, length // SIZE)
        if n and n + cost > SLICE:
            slices.append({})
            n = 0
        slices[-1].setdefault(length, []).append((row.item_id, row.text))
        n += cost
    texts = spread(docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text"))
    schema = "doc_id long, item_id long, at array<int>, n_windows int, best double"
    found = None
    for some in slices:
        index = spark.sparkContext.broadcast([Index(of, length, shingle, radius, least if similar else None) for length, of in sorted(some.items())])
        rows = texts.mapInArrow(_searcher(index, least), schema)
        found = rows if found is None else found.unionByName(rows)
    out = found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max(F.size("at")).alias("n_item_windows"), F.max("best").alias("best"))
    return out.withColumn("same", F.col("n_item_windows") > 0)


def _searcher(shared, least):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: list[Index] = shared.value
        if not indexes:
            return
        known = _Words()
        shortest, longest = indexes[0].size, indexes[-1].size
        for batch in batches:
            hits: dict[tuple[int, int], list] = defaultdict(lambda: [set(), 0, 0.0])
            block, docs, total = [], [], 0
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for r, doc in enumerate(ids):
                for k, words in enumerate(_pieces(texts[r].as_py(), longest)):
                    if len(words) < shortest:
                        continue
                    block += words
                    docs.append((doc, len(words), k > 0))
                    total += len(words)
                    if total >= BLOCK:
                        _search(indexes, known, block, docs, least, hits)
                        block, docs, total = [], [], 0
            if docs:
                _search(indexes, known, block, docs, least, hits)
            if hits:
                keys = list(hits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([sorted(hits[k][0]) for k in keys], pa.list_(pa.int32())),
                        pa.array([hits[k][1] for k in keys], pa.int32()), pa.array([hits[k][2] for k in keys], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "at", "n_windows", "best"],
                )

    return run


def _search(indexes: list[Index], known: _Words, block: list[str], docs: list[tuple[int, int, bool]], least: float, hits) -> None:
    sizes = np.array([n for _, n, _ in docs])
    words = np.fromiter(map(known.__getitem__, block), _U, len(block))
    letters = np.fromiter(map(len, block), np.int32, len(block))
    of = np.repeat(np.arange(len(docs)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    goes_on = np.repeat([c for _, _, c in docs], sizes)
    h, w = _shingles(words, letters, indexes[0].shingle)
    most, prints = max(x.per for x in indexes), [[] for _ in indexes]
    for s in range(0, len(h), BLOCK):  # a piece of a long text is larger than a block
        part_h, part_w = h[s : s + BLOCK + most - 1], w[s : s + BLOCK + most - 1]
        votes = _votes(part_h, part_w)
        for got, index in zip(prints, indexes, strict=True):
            if len(part_h) >= index.per:
                got.append(_fingerprints(part_h, part_w, index.per, votes)[:BLOCK])
    for index, got in zip(indexes, prints, strict=True):
        size = index.size
        if not got or len(of) < size:
            continue
        # windows that lie in one document; those of a piece's overlap were seen in the piece before
        ok = (of[: len(of) - size + 1] == of[size - 1 :]) & ~(goes_on & (place < indexes[-1].size - size))[: len(of) - size + 1]
        _verify(index, np.concatenate(got), np.flatnonzero(ok), words, h, w, of, docs, least, hits)


def _verify(index: Index, f, inside, words, h, w, of, docs, least, hits) -> None:
    """Adds the windows in ``inside`` that are similar to one of the index."""
    i, j = index.near(f[inside])
    i = inside[i]
    if hasattr(index, "prefix"):
        more_i, more_j = index.sharing(h, inside)
        pairs = np.unique(np.r_[(i << 32) | j, (more_i << 32) | more_j])
        i, j = pairs >> 32, pairs & 0xFFFFFFFF
    if not len(i):
        return
    like = np.empty(len(i))
    for s in range(0, len(i), 100_000):
        span = i[s : s + 100_000, None] + np.arange(index.per)
        like[s : s + 100_000] = index.similarity(h[span], w[span], j[s : s + 100_000])
    good = like >= least
    i, j, like = i[good], j[good], like[good]
    equal = (words[i[:, None] + np.arange(index.size)] == index.words[j]).all(1)
    last = {}
    for a, b, s, e in zip(i.tolist(), j.tolist(), like.tolist(), equal.tolist(), strict=True):
        key = (docs[of[a]][0], int(index.item[b]))
        hit = hits[key]
        if e:
            hit[0].add(int(index.at[b]))
        if last.get(key) != a:
            hit[1] += 1
            last[key] = a
        hit[2] = max(hit[2], s)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), similar=False)
    return pairs.filter("same").select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: how many documents hold 12 of its words in a row, and how many of its windows stand in one document at most."""
    items = table(spark, sf_dir, "heldout_items")
    pairs = leaked(table(spark, sf_dir, "documents"), items, similar=False).filter("same")
    per = pairs.groupBy("item_id").agg(F.count("*").alias("n_leaking"), F.max("n_item_windows").alias("most_windows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return items.filter("item_id is not null").select("item_id", "task").distinct().join(per, "item_id", "left").select("item_id", "task", *map(zero, ("n_leaking", "most_windows")))


def p7_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a near copy of an item: windows as long as the item with a similarity of 0.8 or more, how many, and the highest."""
    pairs = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), size=None)
    return pairs.select("doc_id", "item_id", "n_windows", F.round("best", 6).alias("best"), "same")


QUERIES = {"p7_found": p7_found, "p7_items": p7_items, "p7_similar": p7_similar}

SQL = {
    "p7_found": """
WITH tok AS (
  SELECT doc_id AS id, 0 AS side, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT item_id, 1, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) FROM heldout_items WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT id, side, array_to_string(w[i:i+11], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM tok WHERE len(w) >= 12)
)
SELECT DISTINCT d.id AS doc_id, q.id AS item_id FROM g d JOIN g q ON d.s = q.s WHERE d.side = 0 AND q.side = 1
""",
    "p7_items": """
WITH tok AS (
  SELECT doc_id AS id, 0 AS side, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT item_id, 1, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) FROM heldout_items WHERE text IS NOT NULL
), g AS (SELECT id, side, i, array_to_string(w[i:i+11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM tok WHERE len(w) >= 12)),
d AS (SELECT DISTINCT id, s FROM g WHERE side = 0), n AS (SELECT d.id AS doc_id, q.id AS item_id, count(DISTINCT q.i) AS n FROM d JOIN g q ON d.s = q.s AND q.side = 1 GROUP BY ALL),
p AS (SELECT item_id, count(*) AS n_leaking, max(n) AS most FROM n GROUP BY 1)
SELECT i.item_id, task, coalesce(n_leaking, 0) AS n_leaking, CAST(coalesce(most, 0) AS INT) AS most_windows FROM (SELECT DISTINCT item_id, task FROM heldout_items WHERE item_id IS NOT NULL) i LEFT JOIN p USING (item_id)
""",
}
