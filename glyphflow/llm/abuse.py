"""Abusive, hateful or sexual content (problem 9).

Method: a bidirectional gated recurrent network with attention pooling over
character and word inputs (:mod:`.gru`), trained in numpy, scores all overlapping
windows of every document; a document's score is that of its worst window.

Training is weakly supervised: labels belong to whole documents and some are
wrong. The network first learns from seed sentences set among sober text, then
repeats: in each document labelled abusive the windows that it, or the word
pairs typical of such documents, single out become positive examples, the
windows of the other documents negative ones; documents it contradicts strongly
are left out of a round. The sample of labels is bounded by ``MAX_LABELS``.

The threshold comes from cross-fitting: every label is scored by a network that
did not see it. How much sober documents weigh there, and how often a word pair
stands in unlabelled text, is counted over all documents.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import spread, written
from ..tables import table
from .gru import WINDOW, Network, features, windows
from .lookalikes import LATIN_LOOKALIKES
from .seeds import seed_sentences

#: Labelled documents that training takes at most (by hash of their id), and windows of sober text per round.
MAX_LABELS, MAX_SOBER = 4000, 10_000
#: Unlabelled documents that training reads at most (by hash of their id), as weak examples of sober text.
MAX_PLAIN = 3000
#: Labelled documents whose capitalised words serve as names in seed sentences, and how many of these names.
NAME_TEXTS, NAMES = 400, 60
#: Parts of the labels, each scored by a network trained on the others.
FOLDS = 4
#: Tokens a worker keeps projected before it starts anew; windows scored at once.
MEMO, AT_ONCE = 60_000, 4096
#: Characters of a token at most; longer ones become pieces of PIECE characters, one every PIECE_STEP.
LONG_TOKEN, PIECE, PIECE_STEP = 24, 16, 8

_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .·*_-]){2,}[^\W\d_](?!\w)")
_SYLLABLES = re.compile(r"^[^\W\d_]{1,2}\d?(?:-[^\W\d_]{1,2}\d?)+$")
_LEET = str.maketrans("013457@$!€", "oieastasie")
_OUTER = "\"'.,;:!?()[]{}<>«»“”„‘’…¿¡*_-–—/\\|#>"
_LOOKS = {ord(x): c for c, xs in LATIN_LOOKALIKES.items() for x in xs}
BOUND = "</s>"


def plain_text(text: str) -> str:
    """Full-width, look-alike, zero-width and letter-by-letter spellings undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf").translate(_LOOKS) if not text.isascii() else text
    return _SPACED.sub(lambda m: re.sub(r"[ .·*_-]", "", m.group()), text)


def token_pieces(token: str) -> list[str]:
    """A token of usual length as it is, a longer one as overlapping pieces that hold all its characters."""
    if len(token) <= LONG_TOKEN:
        return [token]
    return [token[s : s + PIECE] for s in range(0, len(token) - PIECE_STEP, PIECE_STEP)]


def chunk_tokens(chunk: str) -> list[str]:
    """Tokens of what stands between two blanks: the word in one spelling, and an end of sentence."""
    out = []
    word = chunk.strip(_OUTER).lower()
    if word:
        if word.isdigit():
            out.append("<num>")
        elif "\U00010000" <= word[0] <= "\U0001ffff":
            out.append("<sign>")
        elif _SYLLABLES.match(word):
            out.append("<syl>")
        else:
            if any(c.isalpha() for c in word):
                word = word.translate(_LEET)
                parts = [p for p in re.split(r"['’]", word) if p]
                for p in parts:
                    p = re.sub(r"[-.·_,:;/\\|]", "", p)
                    p = re.sub(r"(.)\1{2,}", r"\1", p)
                    out += token_pieces(p) if p else []
            else:
                out.append("<mark>")
    if chunk and chunk.rstrip("\"')]»”*_>")[-1:] in tuple(".!?"):
        out.append(BOUND)
    return out


def tokens(text: str) -> list[str]:
    return [t for line in plain_text(text).split("\n") for c in line.split() for t in chunk_tokens(c)]


_CUT = re.compile(r"(?<=\S\S)\s(?=\S\S)")


def _pieces(text: str, size: int = 2_000_000) -> Iterator[str]:
    """Parts of a long text, cut at a blank between words, not within letters spelled one by one; without a blank they overlap."""
    at = 0
    while len(text) - at > size:
        cuts = [m.start() for m in _CUT.finditer(text, max(at + 1, at + size - 10_000), at + size)]
        cut = cuts[-1] if cuts else max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size))
        whole = cut > at
        cut = cut if whole else at + size
        yield text[at:cut]
        at = cut if whole else cut - PIECE
    yield text[at:]


class Model:
    """A trained network and the scores that labelled documents got from networks that had not seen them."""

    def __init__(self, net: Network, held: list[tuple[float, float]]):
        self.net, self.held = net, held

    def threshold(self, rate: float) -> float:
        """The best F1 on the labels when sober documents weigh as in a corpus of which ``rate`` is abusive."""
        best, y = np.array(self.held, np.float64).reshape(-1, 2).T
        if not 0 < y.sum() < len(y):
            return 0.5  # nothing to tell apart
        rate = min(max(rate, 0.01), 0.5)
        ok_weight = (1 - rate) / rate * (y == 1).sum() / (y == 0).sum()
        grid = np.linspace(0.1, 0.92, 42)
        hits = np.array([((best >= g) & (y == 1)).sum() for g in grid])
        wrong = np.array([((best >= g) & (y == 0)).sum() for g in grid]) * max(1.0, ok_weight)
        f1 = 2 * hits / np.maximum(1, hits + wrong + (y == 1).sum())
        return float(np.median(grid[f1 >= f1.max() - 0.01]))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Writes a trained model as a table of one row, for later sessions."""
    packed = io.BytesIO()
    np.savez(packed, held=np.array(model.held, np.float64).reshape(-1, 2), **model.net.p)
    spark.createDataFrame([(bytearray(packed.getvalue()),)], "model binary").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """A model that :func:`save_model` wrote."""
    packed = np.load(io.BytesIO(bytes(spark.read.parquet(path).first().model)))
    net = Network()
    net.p = {k: packed[k] for k in packed.files if k != "held"}
    return Model(net, [tuple(x) for x in packed["held"].tolist()])


class Scorer:
    """Scores token lists; token projections are remembered per worker."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self):
        self.chunks: dict[str, list[int]] = {}
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.proj = np.zeros((0, self.net.p["bx"].size), np.float32)
        self.new: list[str] = []

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for line in plain_text(text).split("\n"):
            for c in line.split():
                known = self.chunks.get(c)
                if known is None:
                    known = [self._id(t) for t in chunk_tokens(c)]
                    if len(c) < 64:
                        self.chunks[c] = known
                out += known
        return out

    def _id(self, token: str) -> int:
        i = self.ids.get(token)
        if i is None:
            i = self.ids[token] = len(self.ids)
            self.new.append(token)
            self.names.append(token)
        return i

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Scores of windows given as lists of at most WINDOW token ids."""
        if self.new:
            more = self.net.project(self.net.embed([features(t) for t in self.new]))
            self.proj = np.concatenate([self.proj, more.astype(np.float32)])
            self.new = []
        out = np.empty(len(rows), np.float32)
        for s in range(0, len(rows), AT_ONCE):
            part = rows[s : s + AT_ONCE]
            idx = np.full((len(part), WINDOW), -1, np.int32)
            for i, r in enumerate(part):
                idx[i, : len(r)] = r
            out[s : s + AT_ONCE] = self.net.forward(self.proj, idx)
        return out


def score_texts(scorer: Scorer, texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of windows and the worst window's score of each text; the pieces of a long one overlap by half a window."""
    n, best = [], []
    rows: list[list[int]] = []
    owner: list[int] = []

    def flush():
        if rows:
            at = np.array(owner)
            worst = np.zeros(at[-1] - at[0] + 1)
            np.maximum.at(worst, at - at[0], scorer.scores(rows))
            for i, s in enumerate(worst.tolist(), int(at[0])):
                best[i] = max(best[i], s)
            rows.clear()
            owner.clear()
        if len(scorer.ids) > MEMO or len(scorer.chunks) > 4 * MEMO:
            scorer.clear()

    for r, text in enumerate(texts):
        n.append(0)
        best.append(0.0)
        rest: list[str] = []  # spelled out: a flush may clear the ids
        for piece in _pieces(text) if text else ():
            flush() if len(rows) > 4 * AT_ONCE else None
            ids = [scorer._id(t) for t in rest] + scorer.encode(piece)
            for a, b in windows(len(ids)):
                rows.append(ids[a:b])
                owner.append(r)
                n[r] += 1
            rest = [scorer.names[i] for i in ids[-WINDOW // 2 :]]
    flush()
    return np.array(n, np.int32), np.array(best, np.float64)


def _padded(rows: list[list[int]]) -> np.ndarray:
    idx = np.full((len(rows), WINDOW), -1, np.int32)
    for i, r in enumerate(rows):
        idx[i, : len(r)] = r
    return idx


def _pairs(ids: list) -> set[tuple]:
    return set(zip(ids[:-1], ids[1:], strict=True))


def typical_pairs(labelled: list[tuple[str, float]]) -> set[tuple[str, str]]:
    """Token pairs that at least three documents labelled abusive hold."""
    n = Counter(p for text, y in labelled if y == 1 for p in _pairs([t for piece in _pieces(text) for t in tokens(piece)]))
    return {p for p, k in n.items() if k >= 3}


def folds(labelled: list[tuple[str, float]], rng: np.random.Generator) -> np.ndarray:
    """A part of 0..FOLDS - 1 for each text: labels spread evenly, equal texts in one part."""
    kinds: dict[str, float] = {}
    for text, y in labelled:
        kinds.setdefault(text, y)
    part = {}
    for y in (0.0, 1.0):
        mine = [t for t, k in kinds.items() if k == y]
        part |= {mine[i]: k % FOLDS for k, i in enumerate(rng.permutation(len(mine)))}
    return np.array([part[t] for t, _ in labelled], int)


def train(labelled: list[tuple[str, float]], plain: list[str] = (), rounds: int = 3, seed: int = 11, sober: tuple[dict, int] | None = None, each: Callable = lambda f, xs: [f(x) for x in xs]) -> Model:
    """A model from labelled texts (label 1 or 0), unlabelled ones and the seed sentences; works from the seeds alone if there are no others.

    ``sober``: in how many unlabelled texts of the corpus a token pair stands, and
    their number; by default counted over ``plain``. ``each`` maps the function that
    trains one of the FOLDS + 1 networks over their numbers, perhaps elsewhere.
    """
    part = folds(labelled, np.random.default_rng(seed))
    if sober is None:
        sober = Counter(p for t in plain for p in _pairs([x for piece in _pieces(t) for x in tokens(piece)])), len(plain)
    made = each(lambda k: _fit(labelled, plain, rounds, seed, sober, part == k), [FOLDS, *sorted(set(part.tolist()))])
    return Model(made[0][0], [x for _, held in made[1:] for x in held])


def _fit(labelled: list[tuple[str, float]], plain: list[str], rounds: int, seed: int, in_sober: tuple[dict, int], held: np.ndarray) -> tuple[Network | None, list[tuple[float, float]]]:
    """A network that saw all labelled texts but the held ones, or, if any are held, their scores and labels instead."""
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    code = lambda text: [ids.setdefault(t, len(ids)) for p in _pieces(text) for t in tokens(p)]
    docs = [(code(t), y) for t, y in labelled]
    cut = [[d[a:b] for a, b in windows(len(d))] for d, _ in docs]
    sober_docs = [i for i, (_, y) in enumerate(docs) if y == 0 and not held[i] and cut[i]]
    sober = [(i, w) for i in sober_docs for w in cut[i]]
    if len(sober) > MAX_SOBER:
        sober = [sober[k] for k in rng.choice(len(sober), MAX_SOBER, replace=False)]
    plain_docs = [code(t) for t in plain]
    weak = [d[a:b] for d in plain_docs for a, b in windows(len(d))]
    if len(weak) > MAX_SOBER:
        weak = [weak[k] for k in rng.choice(len(weak), MAX_SOBER, replace=False)]
    bad_docs = [i for i, (_, y) in enumerate(docs) if y == 1 and not held[i] and cut[i]]
    names = sorted({w for (t, _), h in zip(labelled[:NAME_TEXTS], held, strict=False) if not h for w in re.findall(r"(?<=[a-z,] )[A-Z][a-z]{5,}", t)})[:NAMES]
    planted = []
    for text, y in seed_sentences(names):
        sentence = code(text)
        around = sober[rng.integers(len(sober))][1] if sober else []
        room = max(0, WINDOW - len(sentence))
        left = int(rng.integers(0, room + 1))
        row = (around[: max(0, left)] + sentence + around[left:room])[:WINDOW] if rng.random() < 0.8 else sentence[:WINDOW]
        planted.append((row, y))
    # word pairs by how much they mark documents labelled abusive
    near = lambda d: {p for w in cut[d] for p in _pairs(w)}
    bad_n, ok_n = Counter(p for d in bad_docs for p in near(d)), Counter(p for d in sober_docs for p in near(d))
    counts, n_sober = in_sober
    spelled = list(ids)
    base = np.log((len(bad_docs) + 1) / (len(sober_docs) + n_sober + 1))
    odds = {p: np.log((n + 0.2) / (ok_n[p] + counts.get((spelled[p[0]], spelled[p[1]]), 0) + 0.2 + 0.02 * n)) - base for p, n in bad_n.items() if n >= 3}
    net = Network(seed)
    feats: list = []

    def fit(rows: list[tuple[list[int], float, float]], epochs: int, k: int):
        feats.extend(features(t) for t in list(ids)[len(feats) :])
        net.train(feats, _padded([r for r, _, _ in rows]), np.array([y for _, y, _ in rows], np.float32), np.array([w for _, _, w in rows], np.float32), epochs, seed + k)

    def score(rows: list[list[int]]) -> np.ndarray:
        feats.extend(features(t) for t in list(ids)[len(feats) :])
        proj = net.project(net.embed(feats))
        idx = _padded(rows)
        return np.concatenate([net.forward(proj, idx[s : s + AT_ONCE]) for s in range(0, len(idx), AT_ONCE)]) if len(idx) else np.empty(0)

    fit([(r, y, 1.0) for r, y in planted] + [(w, 0.0, 1.0) for _, w in sober] + [(w, 0.0, 0.3) for w in weak], 3, 0)
    for k in range(1, rounds + 1):
        rows = [(r, y, 0.5) for r, y in planted]
        flat = [w for d in bad_docs for w in cut[d]]
        s_bad, at = score(flat), 0
        for d in bad_docs:
            s, mine = s_bad[at : at + len(cut[d])], cut[d]
            at += len(cut[d])
            marks = np.array([sum(sorted((odds.get(p, -1.0) for p in _pairs(w)), reverse=True)[:3]) if len(w) > 1 else -3.0 for w in mine])
            marks = sigmoid_np(marks - 4.0)
            both = np.maximum(s, marks)
            if both.max() < 0.3:
                continue  # nothing speaks for the label
            best = int(both.argmax())
            top = (both >= max(0.5, 0.7 * both.max())) & (s >= 0.5) & (np.abs(np.arange(len(both)) - best) <= 1)
            top |= s >= 0.9
            top[best] = True
            rows += [(w, 1.0, 1.0) for w, t in zip(mine, top, strict=True) if t]
            rows += [(w, 0.0, 0.3) for w, b in zip(mine, both, strict=True) if b < 0.1]
        s_ok = score([w for _, w in sober])
        rows += [(w, 0.0, 1.0) for (_, w), s in zip(sober, s_ok, strict=True) if s < 0.97]
        rows += [(w, 0.0, 0.5) for w, s in zip(weak, score(weak), strict=True) if s < 0.4]
        fit(rows, 2, k)
    if not held.any():
        return net, []
    some = [i for i in np.flatnonzero(held) if cut[i]]
    best = np.zeros(len(some))
    np.maximum.at(best, np.repeat(np.arange(len(some)), [len(cut[i]) for i in some]), score([w for i in some for w in cut[i]]))
    return None, [(b, docs[i][1]) for b, i in zip(best.tolist(), some, strict=True)]


def sigmoid_np(x):
    return 1 / (1 + np.exp(-x))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> list[tuple[str, float]]:
    """At most ``most`` labelled texts: the majority of a document's labels, ties left out, chosen by hash of the id."""
    votes = labels.filter("doc_id is not null and abusive in (0, 1)").groupBy("doc_id").agg(F.avg("abusive").alias("y")).filter("y <> 0.5")
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").filter("text is not null and text <> ''").join(F.broadcast(some), "doc_id").orderBy("doc_id", "text").collect()
    return [(r.text, 1.0 if r.y > 0.5 else 0.0) for r in rows]


def _unlabelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").filter("text is not null and text <> ''").join(labels.select("doc_id"), "doc_id", "left_anti")


def plain_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_PLAIN) -> list[str]:
    """At most ``most`` unlabelled texts, those of the least hashes of the id; a bound on the hash keeps nearly all other texts out of the search."""
    rows, by = _unlabelled(docs, labels), F.xxhash64("doc_id", F.lit(1))
    share = 2 * most / max(1, docs.count())
    least = lambda df: [r.text for r in df.orderBy(by, "doc_id").limit(most).collect()]
    some = least(rows.filter(by < -(1 << 63) + int(share * (1 << 64)))) if share < 1 else []
    return some if len(some) == most else least(rows)


def pair_counts(docs: DataFrame, wanted: set[tuple[str, str]]) -> tuple[dict[tuple[str, str], int], int]:
    """In how many texts each of the wanted token pairs stands, and the number of texts."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for p in wanted for t in p}))}
    size = max(1, len(vocabulary))
    by_code = {vocabulary[a] * size + vocabulary[b]: (a, b) for a, b in wanted}
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, np.array(sorted(by_code), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = shared.value
        chunks: dict[str, list[int]] = {}
        total, n = np.zeros(len(codes), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                rest: list[int] = []
                seen = [np.empty(0, np.int64)]
                for piece in _pieces(text):
                    ids = rest
                    for c in plain_text(piece).split():
                        if c not in chunks:
                            if len(chunks) > 4 * MEMO:
                                chunks.clear()
                            chunks[c] = [known.get(t, -1) for t in chunk_tokens(c)]
                        ids += chunks[c]
                    at = np.array(ids, np.int64)
                    seen.append(np.unique((at[:-1] * size + at[1:])[(at[:-1] >= 0) & (at[1:] >= 0)]))
                    rest = ids[-1:]
                total[np.isin(codes, np.concatenate(seen))] += 1
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[codes[hit], -1]), pa.array(np.r_[total[hit], n])], names=["code", "n"])

    rows = spread(docs.filter("text is not null and text <> ''").select(F.col("text").cast("string"))).mapInArrow(run, "code long, n long")
    got = {r.code: r.n for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    return {by_code[c]: n for c, n in got.items() if c >= 0}, got.get(-1, 0)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of these documents and labels; its networks are trained in tasks of their own."""
    sc = docs.sparkSession.sparkContext
    labelled = labelled_texts(docs, labels)
    sober = pair_counts(_unlabelled(docs, labels), typical_pairs(labelled))
    return train(labelled, plain_texts(docs, labels), sober=sober, each=lambda f, xs: sc.parallelize(xs, len(xs)).map(f).collect())


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, ``n_windows``, ``score`` (0..1, that of the worst window) and ``found``.

    Rows stay one to one. Every window of the whole text is scored; null and empty
    texts have no window and score 0. Scores are written once; the share of texts at
    0.9 or more among all of them sets the threshold.
    """
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model.net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            n, best = score_texts(scorer, batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n), pa.array(best)], names=[*keep, "n_windows", "score"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "n_windows int, score double"])
    out = written(spread(docs.select(*keep, F.col("text").cast("string"))).mapInArrow(run, schema), "scores")
    rate = out.filter("n_windows > 0").agg(F.avg((F.col("score") >= 0.9).cast("int"))).first()[0]
    return out.withColumn("found", F.col("score") >= model.threshold(rate or 0.0))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "review_labels")
    return scored(docs, trained(docs, labels), ["doc_id", "source"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).filter("found").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source (trimmed, lower case): documents, how many are found, their rate and the mean score."""
    source = F.nullif(F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")), F.lit(""))
    return p9_scores(spark, sf_dir).groupBy(source.alias("source")).agg(
        F.count("*").alias("n_docs"), F.count_if("found").alias("n_found"), F.round(F.avg(F.col("found").cast("int")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
