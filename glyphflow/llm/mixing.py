"""Mixing sources to target weights (problem 8).

Method: systematic sampling. Each document of a source has the same expected
number of copies; their prefix sum over the source's documents, in order of
size, is shifted by one random offset, and a document comes out once per integer
boundary its step crosses. The prefix sum has two levels, so no task holds a
source: bins of (source, size, hash) are counted first, their totals are summed
up, and ranks are taken inside bins.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import spread, written
from ..tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before byte pairs merge; fixed by the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that a hash bin of a size and source holds, about, and the least and most such bins; sizes are binned by octave and eighth.
PER_BIN, HASH_BINS = 50_000, (64, 4096)


def with_tokens(docs: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of the whole text; null and empty texts have 0."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            sizes = [sum(len(coder.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "n_tokens long"])
    return docs.select(*keep, text).mapInArrow(run, schema)


def _pieces(text: str, size: int = 1_000_000) -> Iterator[str]:
    """A very long text in pieces that begin at a blank before a letter, where tokens never join."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        while cut > at and not (text[cut + 1].isalpha() and not text[cut - 1].isspace()):
            cut = text.rfind(" ", at + 1, cut)
        cut = cut if cut > at else at + size
        yield text[at:cut]
        at = cut
    yield text[at:]


def plan_shares(sizes: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Expected copies of a document, per source.

    ``sizes``: source, documents, tokens; ``targets``: source, share, most uses of
    a document. Shares of sources without tokens go to the others in proportion.
    Without ``total`` the mix is the largest in which every source reaches its
    share; with it, sources that would need more than their cap stay at the cap
    and the others fill up. Sources without a target contribute nothing.
    """
    tokens = {s: t for s, _, t in sizes if t}
    live = {s: (w, m) for s, w, m in targets if s in tokens and w and w > 0 and m and m > 0}
    if not live:
        return {}
    weight = sum(w for w, _ in live.values())
    room = {s: m * tokens[s] for s, (_, m) in live.items()}
    if total is None:
        total = min(room[s] * weight / w for s, (w, _) in live.items())
    out, left, open_ = {}, total, dict(live)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [s for s, (w, _) in open_.items() if left * w / weight >= room[s]]
        if not full:
            out |= {s: left * w / weight / tokens[s] for s, (w, _) in open_.items()}
            break
        for s in full:
            out[s] = float(live[s][1])
            left -= room[s]
            del open_[s]
    return out


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixed documents (``source, doc_id, n_tokens, copies``) and the shares reached.

    ``docs``: ``doc_id, source, text``; sources are compared trimmed and in lower
    case, a null or empty source is none and its documents are not used. Of rows
    with one doc_id the least (source, n_tokens) counts. Documents of 0 tokens take
    part like others. No document has more than its source's ``max_repeats``
    copies. Of rows with one target source the largest share counts. Empty tables
    give no rows. The second table has a row per source of either input:
    ``source, target_share, max_repeats, n_docs, n_tokens, used_docs, used_tokens,
    reached_share``.
    """
    tidy = lambda c: F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))
    named = docs.select("doc_id", F.nullif(tidy("source"), F.lit("")).alias("source"), "text").filter("doc_id is not null")
    counted = with_tokens(spread(named), "text", ["doc_id", "source"], vocabulary)
    sized = written(counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("doc_id", "r.*"), "sized")
    goals = targets.select(tidy("source").alias("source"), "target_share", "max_repeats").filter("source is not null")
    goals = goals.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("r")).select("source", "r.*")
    per = sized.filter("source is not null").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sizes = per.join(F.broadcast(goals.select("source")), "source", "left_semi").collect()  # a row per target source
    copies = plan_shares([tuple(r) for r in sizes], [tuple(r) for r in goals.collect()], total)
    spark = docs.sparkSession
    offset = lambda s: int.from_bytes(hashlib.sha256(f"{seed}|{s}".encode()).digest()[:6], "big") / 2**48
    rates = spark.createDataFrame([(s, e, offset(s)) for s, e in copies.items()], "source string, rate double, shift double")
    parts = min(max(sized.count() // PER_BIN, HASH_BINS[0]), HASH_BINS[1])
    size_bin = F.floor(8 * F.log2(F.col("n_tokens") + 1)).cast("int")
    binned = sized.join(F.broadcast(rates), "source").withColumn("bin", size_bin).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)).cast("int"))
    keys = ["source", "bin", "part"]
    # a row per (source, size bin, hash bin): bounded by the parameters, not by the documents
    before = binned.groupBy(*keys).count().withColumn("before", F.sum("count").over(W.partitionBy("source").orderBy("bin", "part")) - F.col("count")).drop("count")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("n_tokens", "doc_id")) + F.col("before")
    placed = binned.join(before, keys).withColumn("rank", rank)
    # floor of the shifted prefix sum after and before the document
    step = lambda r: F.floor(r * F.col("rate") + F.col("shift"))
    drawn = placed.select("source", "doc_id", "n_tokens", (step(F.col("rank")) - step(F.col("rank") - 1)).cast("int").alias("copies")).filter("copies > 0")
    used = drawn.groupBy("source").agg(F.count("*").alias("used_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = goals.join(per, "source", "full").join(used, "source", "left").select("source", "target_share", "max_repeats", *map(zero, ("n_docs", "n_tokens", "used_docs", "used_tokens")))
    all_used = F.sum("used_tokens").over(W.partitionBy())
    return drawn, shares.withColumn("reached_share", F.round(F.when(all_used > 0, F.col("used_tokens") / all_used), 6))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: a row per document and copy."""
    drawn, _ = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return drawn.select("source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
