"""Runs over globally sorted events, without one task per entity.

Events are range-partitioned by (entity, position), so an entity that owns a
third of all rows spreads over many partitions. Each partition is a chunk whose
runs are found from a sorted array of run starts; the first and last run of a
partition go on to a stitch of at most two rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

RUN_SCHEMA = "kind int, entity long, event string, first_pos long, last_pos long, first_end long, last_end long, n long"
_EDGE_SCHEMA = RUN_SCHEMA + ", part int, edge int"


def _links(kind, entity, event, pos, max_gap):
    """For neighbours i, i+1: whether i+1 goes on with the run of i."""
    same = (kind[1:] == kind[:-1]) & (entity[1:] == entity[:-1])
    if max_gap is None:
        return same & (event[1:] == event[:-1]) & (event[1:] >= 0)
    return same & (pos[1:] - pos[:-1] <= max_gap)


def _joins(a: dict, b: dict, max_gap) -> bool:
    if a["kind"] != b["kind"] or a["entity"] != b["entity"]:
        return False
    if max_gap is None:
        return a["event"] is not None and a["event"] == b["event"]
    return b["first_pos"] - a["last_pos"] <= max_gap


def _merge(a: dict, b: dict) -> dict:
    return a | {"last_pos": b["last_pos"], "last_end": max(a["last_end"], b["last_end"]), "n": a["n"] + b["n"]}


def _chunk_runs(max_gap, least):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict | None = None  # the run that may go on in the next batch
        first = True
        out: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            entity, pos, end = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            words = pc.dictionary_encode(batch.column(4))
            event = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False)
            names = words.dictionary.to_pylist()
            # a record delivered again stands next to itself
            new = np.ones(len(pos), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (entity[1:] != entity[:-1]) | (pos[1:] != pos[:-1])
            if held and kind[0] == held["kind"] and entity[0] == held["entity"] and pos[0] == held["last_pos"]:
                stop = np.flatnonzero(new[1:])
                new[: (stop[0] + 1) if len(stop) else len(new)] = False
            kind, entity, pos, end, event = kind[new], entity[new], pos[new], end[new], event[new]
            if not len(pos):
                continue
            starts = np.flatnonzero(np.r_[True, ~_links(kind, entity, event, pos, max_gap)])
            of = np.searchsorted(starts, np.arange(len(pos)), "right") - 1  # the run of each event
            size = np.bincount(of, minlength=len(starts))
            lasts = starts + size - 1
            far = np.maximum.reduceat(end, starts)
            row = lambda r: {
                "kind": int(kind[starts[r]]), "entity": int(entity[starts[r]]),
                "event": names[event[starts[r]]] if event[starts[r]] >= 0 else None,
                "first_pos": int(pos[starts[r]]), "last_pos": int(pos[lasts[r]]),
                "first_end": int(end[starts[r]]), "last_end": int(far[r]), "n": int(size[r]),
            }
            lo = 0
            if held is not None:
                head = row(0)
                if _joins(held, head, max_gap):
                    held, lo = _merge(held, head), 1
            if lo < len(starts):
                if held is not None:
                    if first or held["n"] >= least:
                        out.append(held | {"part": part, "edge": 1 if first else 0})
                    first = False
                inner = np.arange(lo, len(starts) - 1)
                if first and len(inner):
                    out.append(row(inner[0]) | {"part": part, "edge": 1})
                    inner, first = inner[1:], False
                keep = inner[size[inner] >= least]
                if len(keep):  # whole runs leave as columns
                    at, end_at = starts[keep], lasts[keep]
                    named = pc.take(words.dictionary, pa.array(event[at], mask=event[at] < 0)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(kind[at], pa.int32()), pa.array(entity[at]), named, pa.array(pos[at]), pa.array(pos[end_at]), pa.array(end[at]), pa.array(far[keep]), pa.array(size[keep].astype(np.int64)),
                            pa.array(np.full(len(keep), part, np.int32)), pa.array(np.zeros(len(keep), np.int32)),
                        ],
                        schema=_ARROW,
                    )
                held = row(len(starts) - 1)
        if held is not None:
            out.append(held | {"part": part, "edge": 3 if first else 2})
        if out:
            yield _as_batch(out)

    return run


_ARROW = pa.schema([("kind", pa.int32()), ("entity", pa.int64()), ("event", pa.string()), *[(c, pa.int64()) for c in ("first_pos", "last_pos", "first_end", "last_end", "n")], ("part", pa.int32()), ("edge", pa.int32())])


def _as_batch(rows: list[dict], schema=_ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _stitch(max_gap, least):
    final = pa.schema([f for f in _ARROW if f.name not in ("part", "edge")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [row for batch in batches for row in batch.to_pylist()]
        edges.sort(key=lambda r: (r["part"], r["edge"]))
        out, held, whole = [], None, False
        for e in edges:
            # only the last run of a partition can go on, and only in a first one
            if held is not None and whole and e["edge"] in (1, 3) and _joins(held, e, max_gap):
                held = _merge(held, e)
            else:
                if held is not None and held["n"] >= least:
                    out.append(held)
                held = dict(e)
            whole = e["edge"] in (2, 3)
        if held is not None and held["n"] >= least:
            out.append(held)
        if out:
            yield _as_batch([{k: r[k] for k in final.names} for r in out], final)

    return run


def sorted_runs(events: DataFrame, max_gap: int | None = None, least: int = 1, partitions: int | None = None) -> DataFrame:
    """Longest runs of neighbouring events.

    ``events`` has ``kind int, entity long, pos long, end long, event string``.
    Neighbours are adjacent in ``pos`` within (kind, entity), whatever numbers are
    missing; rows equal in (kind, entity, pos) are one event (the first in order of
    ``event``, nulls last). Without ``max_gap`` neighbours belong together if their
    non-null ``event`` is the same; with it, if ``pos`` grows by at most ``max_gap``.
    Rows whose kind, entity or pos is null have no place in an order and are left out.
    Returns runs of at least ``least`` events (columns of ``RUN_SCHEMA``); an empty
    input gives no rows.
    """
    rows = events.select(*(F.col(c).cast(t).alias(c) for c, t in (("kind", "int"), ("entity", "long"), ("pos", "long"), ("end", "long"), ("event", "string"))))
    rows = rows.filter("kind is not null and entity is not null and pos is not null and end is not null")
    by = ["kind", "entity", "pos"]
    placed = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    chunks = placed.sortWithinPartitions(*by, F.col("event").asc_nulls_last()).mapInArrow(_chunk_runs(max_gap, least), _EDGE_SCHEMA)
    rows = written(chunks, "runs")
    inner = rows.filter("edge = 0").drop("part", "edge")
    # two rows a partition are left to stitch
    return inner.unionByName(rows.filter("edge > 0").repartition(1).mapInArrow(_stitch(max_gap, least), RUN_SCHEMA))


__all__ = ["sorted_runs", "RUN_SCHEMA"]
