"""Long exact spans shared between records (problem 5).

Method: count-min prefilter. Each partition counts the hashes of its windows in
a sketch; the merged sketch overestimates how often a window occurs, so a window
it calls unique is unique. A second pass emits only windows that the sketch
calls repeated, with their content, and groups those exactly. Windows that lie
in two records or more are then joined to stretches.

Records are cut into chunks of a globally sorted order with a look-ahead of one
window, so a record of any length spreads over many tasks.

The sketch grows with the data, 8 cells per window. Up to ``WIDTHS[1]`` cells its
bitmaps are broadcast. Beyond, they stay a table of blocks: windows travel as
16 bytes to the block of their first cell, those that it calls repeated to the
block of the next, and only what is left comes back to its chunk for its content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordered import sorted_runs
from ..ranks import numbered
from ..scratch import written
from ..tables import clean_code, table

#: Events of a chunk; rows of the sketch; its least width and the greatest that is broadcast (cells, powers of two).
#: At that width its bitmaps take DEPTH * 2**28 / 8 = 64 MB.
CHUNK, DEPTH, WIDTHS = 8192, 2, (1 << 16, 1 << 28)
#: Cells whose count reaches this are listed beside the bitmap; their windows are salted by it.
HOT = 20_000
_BLOCK = 1 << 16  # cells that one merge holds

_CHUNKS = "part int, n int, offset long, last boolean, entity array<long>, pos array<long>, code array<int>"
_U = np.uint64


def _chunker(size):
    """Sorted rows entity, pos, code to chunks, each with the first events of the next; a record delivered again stands next to itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        offset = 0

        def chunk(cols, n, last):
            one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([offset], pa.int64()), pa.array([last]),
                    one(cols[0], pa.int64()), one(cols[1], pa.int64()), one(cols[2], pa.int32()),
                ],
                names=["part", "n", "offset", "last", "entity", "pos", "code"],
            )

        for b in batches:
            cols = [np.concatenate([r, b.column(i).to_numpy(zero_copy_only=False).astype(r.dtype)]) for i, r in enumerate(rest)]
            if len(cols[0]) > 1:
                new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
                cols = [c[new] for c in cols]
            while len(cols[0]) > 2 * CHUNK:
                yield chunk([c[: CHUNK + size - 1] for c in cols], CHUNK, False)
                offset += CHUNK
                cols = [c[CHUNK:] for c in cols]
            rest = cols
        if len(rest[0]):
            yield chunk(rest, len(rest[0]), True)

    return run


def _hashes(entity, code, size):
    """64-bit hash per start of a window of ``size`` events of one entity without null; and which starts have one."""
    m = len(code) - size + 1
    if m <= 0:
        return np.empty(0, _U), np.empty(0, bool)
    h = np.zeros(m, _U)
    bad = np.cumsum(np.r_[0, code == 0])
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * _U(0x9E3779B97F4A7C15) + code[k : k + m].astype(_U)
        h ^= h >> _U(31)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
    return h, (entity[:m] == entity[size - 1 :]) & (bad[size:] == bad[:-size])


def _cells(h, row, width):
    with np.errstate(over="ignore"):
        x = (h + _U(row + 1) * _U(0xD1342543DE82EF95)) * _U(0x94D049BB133111EB)
        x ^= x >> _U(32)
    return (x & _U(width - 1)).astype(np.int64)


def _sketcher(ahead, size, width):
    per = max(1, width // _BLOCK)

    def run(batches):
        h_all = []
        for b in batches:
            for entity, code in _rows(b, ahead.value):
                h, ok = _hashes(entity, code, size)
                h_all.append(h[ok])
            if sum(map(len, h_all)) > 2_000_000:
                yield from sketch(np.concatenate(h_all))
                h_all = []
        if h_all:
            yield from sketch(np.concatenate(h_all))

    def sketch(h):
        for row in range(DEPTH):
            cells, n = np.unique(_cells(h, row, width), return_counts=True)
            cut = np.searchsorted(cells, np.arange(per + 1) * (width // per))
            keep = [i for i in range(per) if cut[i + 1] > cut[i]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row * per + i for i in keep], pa.int32()),
                    pa.array([(cells[cut[i] : cut[i + 1]] - i * (width // per)).astype(np.int32).tobytes() for i in keep], pa.binary()),
                    pa.array([n[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in keep], pa.binary()),
                ],
                names=["block", "cells", "counts"],
            )

    return run


def _merger(block_cells, hot):
    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block_cells, np.int64)
        for b in batches:
            for cells, n in zip(b.column("cells").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total[np.frombuffer(cells, np.int32)] += np.frombuffer(n, np.int32)
        big = np.flatnonzero(total >= hot)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary()), pa.array([big.astype(np.int32).tobytes()], pa.binary()), pa.array([total[big].tobytes()], pa.binary())],
            names=["block", "repeated", "hot", "hot_n"],
        )

    return merge


def _hot_cells(rows, blocks, block_cells):
    """Cells and counts of the hot cells of each row of the sketch, in order."""
    out = [[(np.empty(0, np.int64), np.empty(0, np.int64))] for _ in range(DEPTH)]
    for m in sorted(rows, key=lambda m: m.block):
        row, i = divmod(m.block, blocks)
        out[row].append((np.frombuffer(bytes(m.hot), np.int32).astype(np.int64) + i * block_cells, np.frombuffer(bytes(m.hot_n), np.int64)))
    return [tuple(np.concatenate(x) for x in zip(*h, strict=True)) for h in out]


def _rows(b, ahead):
    for r in range(b.num_rows):
        a = ahead.get(b.column("part")[r].as_py()) if b.column("last")[r].as_py() else None
        cols = [b.column(c)[r].values.to_numpy() for c in ("entity", "code")]
        if a is not None:
            cols = [np.concatenate([c, a[i]]) for c, i in zip(cols, (0, 2), strict=True)]
        yield cols


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of an array as bytes, without a Python object per row."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _estimate(h, row, width, seen, hot_cells):
    """Counts of the windows' cells in a row of the sketch: that of a hot cell, else 2 where ``seen`` says repeated, else 1."""
    cell = _cells(h, row, width)
    n = np.where(seen(cell), 2, 1).astype(np.int64)
    cells, counts = hot_cells[row]
    if len(cells):
        i = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        n = np.where(cells[i] == cell, counts[i], n)
    return cell, n


def _placer(hot_cells, ahead, size, width, block_cells, blocks):
    """Every window as ``part, offset, at, est`` and its block and bit in each row; a hot cell needs no look-up and has a block of its own."""

    def run(batches):
        for b in batches:
            for r, (entity, code) in enumerate(_rows(b, ahead.value)):
                h, ok = _hashes(entity, code, size)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                est, where = np.full(len(at), np.iinfo(np.int64).max), []
                for row in range(DEPTH):
                    cell, n = _estimate(h[at], row, width, lambda c: np.ones(len(c), bool), hot_cells.value)
                    est = np.minimum(est, n)
                    where += [pa.array(np.where(n > 2, -1 - cell % 4096, row * blocks + cell // block_cells).astype(np.int32)), pa.array((cell % block_cells).astype(np.int32))]
                one = lambda c, t: pa.array(np.full(len(at), b.column(c)[r].as_py()), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one("part", pa.int32()), one("offset", pa.int64()), pa.array(at.astype(np.int32)), pa.array(est), *where], names=["part", "offset", "at", "est", *(f"{k}{row}" for row in range(DEPTH) for k in ("block", "bit"))])

    return run


def _called_repeated(chunks, sketch, hot_cells, ahead, size, width, block_cells, blocks):
    """The chunks with the places and estimates of those windows that a sketch of any width calls repeated."""
    where = "".join(f", block{row} int, bit{row} int" for row in range(DEPTH))
    left = chunks.mapInArrow(_placer(hot_cells, ahead, size, width, block_cells, blocks), f"part int, offset long, at int, est long{where}")
    for row in range(DEPTH):
        bits = sketch.select(F.col("block").alias(f"block{row}"), "repeated").hint("shuffle_hash")
        byte = F.conv(F.hex(F.substring("repeated", F.shiftright(f"bit{row}", 3) + 1, F.lit(1))), 16, 10).cast("int")
        on = F.call_function("shiftright", byte, 7 - F.col(f"bit{row}") % 8).bitwiseAND(F.lit(1)) == 1
        left = left.join(bits, f"block{row}", "left").filter((F.col(f"block{row}") < 0) | on).drop("repeated")
    places = left.groupBy("part", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "est"))).alias("found"))  # at most a chunk's windows
    return chunks.join(places, ["part", "offset"]).select(*chunks.columns, F.col("found.at").alias("at"), F.col("found.est").alias("est"))


def _emitter(sketch, ahead, base, size, width, hot, code_type):
    def run(batches):
        bits, hot_cells = (None, None) if sketch is None else sketch.value
        for b in batches:
            for r in range(b.num_rows):
                part, last, n, at = (b.column(c)[r].as_py() for c in ("part", "last", "n", "offset"))
                cols = [b.column(c)[r].values.to_numpy() for c in ("entity", "pos", "code")]
                a = ahead.value.get(part) if last else None
                if a is not None:
                    cols = [np.concatenate([c, x]) for c, x in zip(cols, a, strict=True)]
                entity, pos, code = cols
                if sketch is None:  # looked up before
                    at_rows, est = (b.column(c)[r].values.to_numpy().astype(np.int64) for c in ("at", "est"))
                else:
                    h, ok = _hashes(entity, code, size)
                    at_rows = np.flatnonzero(ok)
                    est = np.full(len(at_rows), np.iinfo(np.int64).max)
                    for row in range(DEPTH):
                        seen = lambda c, row=row: (bits[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
                        est = np.minimum(est, _estimate(h[at_rows], row, width, seen, hot_cells)[1])
                    at_rows, est = at_rows[est >= 2], est[est >= 2]
                if not len(at_rows):
                    continue
                salts = np.maximum(1, est // hot)
                g = base.value[part] + at + at_rows
                content = np.lib.stride_tricks.sliding_window_view(code.astype(code_type), size)[at_rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(entity[at_rows]), pa.array(g), pa.array(pos[at_rows]), pa.array(pos[at_rows + size - 1]),
                        _binary(content),
                        pa.array(salts.astype(np.int32)), pa.array((g % salts).astype(np.int32)),
                    ],
                    names=["entity", "g", "first_pos", "last_pos", "content", "salts", "salt"],
                )

    return run


def shared_stretches(events: DataFrame, size: int = 20, width: int | None = None, hot: int = HOT, partitions: int | None = None) -> DataFrame:
    """``entity, first_pos, last_pos, n_events``: longest stretches in which each event lies in a shared span.

    ``events``: ``entity long, pos long, event string``. A shared span is ``size``
    or more neighbours (by pos) without null event that stand in the same order in
    another entity; overlapping and touching spans form one stretch. Rows with a
    null entity or pos are left out, rows repeated for one (entity, pos) count
    once, further columns are ignored, an empty table gives no rows. ``width`` is
    that of the sketch, by default 8 cells per event; it changes how much the second
    pass groups, never the result.
    """
    spark = events.sparkSession
    rows = events.filter("entity is not null and pos is not null").select(F.col("entity").cast("long"), F.col("pos").cast("long"), F.col("event").cast("string"))
    words = rows.filter("event is not null").select("event").distinct()
    codes = numbered(words, ["event"], "code", 1).withColumn("code", F.col("code").cast("int"))
    n_codes = codes.count()
    code_type = "<u2" if n_codes < 65536 else "<i4"  # one for all chunks: windows are grouped by their bytes
    coded = rows.join(F.broadcast(codes) if n_codes <= 100_000 else codes, "event", "left").select("entity", "pos", F.coalesce("code", F.lit(0)).alias("code"))
    placed = coded.repartitionByRange(partitions, "entity", "pos") if partitions else coded.repartitionByRange("entity", "pos")
    chunks = written(placed.sortWithinPartitions("entity", "pos", F.col("code").desc()).mapInArrow(_chunker(size), _CHUNKS), "chunks")
    # a row per partition: its size and its first events, which the last chunk before it looks ahead to
    heads_of = [F.min_by(F.slice(c, 1, F.least(F.lit(size - 1), F.col("n"))), "offset").alias(c) for c in ("entity", "pos", "code")]
    parts = chunks.groupBy("part").agg(F.sum("n").alias("n"), *heads_of).orderBy("part").collect()
    if not parts:
        return spark.createDataFrame([], "entity long, first_pos long, last_pos long, n_events long")
    base, heads, total = {}, {}, 0
    for p in parts:
        base[p.part], total = total, total + p.n
    for i, p in enumerate(parts):
        got = [[], [], []]
        for q in parts[i + 1 :]:
            for have, more in zip(got, (q.entity, q.pos, q.code), strict=True):
                have += more[: size - 1 - len(have)]
            if len(got[0]) >= size - 1:
                break
        heads[p.part] = [np.array(got[0], np.int64), np.array(got[1], np.int64), np.array(got[2], np.int32)]
    width = width or max(1 << (8 * total - 1).bit_length(), WIDTHS[0])
    hot = max(hot, total // 2000)
    blocks = max(1, width // _BLOCK)
    sc = spark.sparkContext
    ahead, offsets = sc.broadcast(heads), sc.broadcast(base)
    partial = chunks.mapInArrow(_sketcher(ahead, size, width), "block int, cells binary, counts binary")
    merged = partial.groupBy("block").applyInArrow(_merger(width // blocks, hot), "block int, repeated binary, hot binary, hot_n binary")
    if width > WIDTHS[1]:
        merged = written(merged, "sketch")
        hot_cells = sc.broadcast(_hot_cells(merged.filter(F.length("hot") > 0).select("block", "hot", "hot_n").collect(), blocks, width // blocks))  # at most some thousand cells
        kept, sketch = _called_repeated(chunks, merged, hot_cells, ahead, size, width, width // blocks, blocks), None
    else:
        rows = merged.collect()
        bits, bytes_each = np.zeros((DEPTH, width // 8), np.uint8), width // blocks // 8
        for m in rows:
            row, i = divmod(m.block, blocks)
            bits[row, i * bytes_each : (i + 1) * bytes_each] = np.frombuffer(bytes(m.repeated), np.uint8)
        kept, sketch = chunks, sc.broadcast((bits, _hot_cells(rows, blocks, width // blocks)))
    schema = "entity long, g long, first_pos long, last_pos long, content binary, salts int, salt int"
    windows = written(kept.mapInArrow(_emitter(sketch, ahead, offsets, size, width, hot, code_type), schema), "windows")
    # exact: a window is shared if two entities have its content; salted where the sketch says it is frequent
    some = windows.groupBy("content", "salt").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"), F.max("salts").alias("salts"))
    shared = some.groupBy("content").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("salts").alias("salts")).filter("lo < hi")
    shared = shared.select("content", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    found = windows.join(shared, ["content", "salt"], "left_semi")
    # windows in order of their place; one stretch as long as the next begins inside or right behind the last
    runs = sorted_runs(found.select(F.lit(0).alias("kind"), "entity", F.col("g").alias("pos"), F.col("last_pos").alias("end"), F.col("first_pos").cast("string").alias("event")), max_gap=size)
    return runs.select("entity", F.col("event").cast("long").alias("first_pos"), F.col("last_end").alias("last_pos"), (F.col("last_pos") - F.col("first_pos") + size).alias("n_events"))


def sign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = table(spark, sf_dir, "signs")
    return signs.select(F.col("inscription_id").alias("entity"), F.col("sequence").alias("pos"), clean_code(F.col("bennett_id")).alias("event"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_stretches(sign_events(spark, sf_dir))
    return out.select(F.col("entity").alias("inscription_id"), F.col("first_pos").alias("first_sequence"), F.col("last_pos").alias("last_sequence"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each inscription: its signs, how many of them stand elsewhere too, and their share."""
    events = sign_events(spark, sf_dir)
    sizes = events.filter("entity is not null and pos is not null").groupBy("entity").agg(F.count_distinct("pos").alias("n_signs"))
    shared = shared_stretches(events).groupBy("entity").agg(F.sum("n_events").alias("n_shared"), F.count("*").alias("n_stretches"))
    n = F.coalesce("n_shared", F.lit(0))
    return sizes.join(shared, "entity", "left").select(
        F.col("entity").alias("inscription_id"), "n_signs", n.alias("n_shared"), F.coalesce("n_stretches", F.lit(0)).alias("n_stretches"), F.round(n / F.col("n_signs"), 6).alias("share")
    )


QUERIES = {"p5_found": p5_found, "p5_shares": p5_shares}

_SPANS = """
WITH ev AS (
  SELECT DISTINCT inscription_id, sequence,
    regexp_replace(upper(regexp_replace(bennett_id, '^\\s+|\\s+$', '', 'g')), '^([A-Z]+)\\s*(.+)$', '\\1 \\2') AS s
  FROM signs
), o AS (
  SELECT *, row_number() OVER w AS g, string_agg(s, '|') OVER x AS content, count(s) OVER x AS k, max(sequence) OVER x AS last_seq
  FROM ev WINDOW w AS (PARTITION BY inscription_id ORDER BY sequence), x AS (w ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), f AS (SELECT * FROM o WHERE k = 20),
sh AS (SELECT content FROM f GROUP BY content HAVING min(inscription_id) < max(inscription_id)),
w AS (SELECT f.* FROM f SEMI JOIN sh USING (content)),
s1 AS (SELECT *, CASE WHEN g - lag(g) OVER (PARTITION BY inscription_id ORDER BY g) <= 20 THEN 0 ELSE 1 END AS st FROM w),
s2 AS (SELECT *, sum(st) OVER (PARTITION BY inscription_id ORDER BY g) AS r FROM s1),
fin AS (SELECT inscription_id, min(sequence) AS first_sequence, max(last_seq) AS last_sequence, max(g) - min(g) + 20 AS n FROM s2 GROUP BY inscription_id, r)
"""
SQL = {
    "p5_found": _SPANS + "SELECT inscription_id, first_sequence, last_sequence FROM fin",
    "p5_shares": _SPANS
    + """SELECT a.inscription_id, n_signs, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared, coalesce(n_stretches, 0) AS n_stretches,
  round(coalesce(n_shared, 0) / n_signs, 6) AS share
FROM (SELECT inscription_id, count(DISTINCT sequence) AS n_signs FROM signs GROUP BY 1) a
LEFT JOIN (SELECT inscription_id, sum(n) AS n_shared, count(*) AS n_stretches FROM fin GROUP BY 1) b USING (inscription_id)""",
}
