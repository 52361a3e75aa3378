"""References to records that do not exist (problem 2).

Method: keyed pending-orphan state, kept up incrementally. A batch brings new
references, parents that arrived and deletions. New references probe the parent
index; those that find no parent wait; arriving parents resolve waiting orphans;
deletions reopen settled references; counts are snapshot after every batch.

State is a set of written tables:

* what happened to parents and all references, as append-only runs that merge
  level by level and are then cut into buckets of keys (:class:`KeyedRuns`);
* the waiting references, which alone are rewritten;
* references whose parent came later, append-only; a deletion moves them.

A batch probes by distinct keys, combined map-side, not by references: a key that
a third of all references name costs one row. References themselves are read
where their key turned out bad, and old ones only if their parent was deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from ..skew import skew_join
from ..tables import table

#: Up to this many keys travel by broadcast (they are counted first): about 100 bytes each.
BROADCAST_KEYS = 200_000
#: Runs of one level that merge into a run of the next, its buckets, and the files of a bucket.
FAN_IN, BUCKETS, SPLIT = 16, 64, 4
REFS = ["child", "id", "parent", "key", "at", "period"]
KEY = ["parent", "key"]
EVENTS = ["parent", "key", "first", "last", "deleted"]
_TYPES = {"child": "string", "id": "long", "parent": "string", "key": "long", "at": "timestamp", "period": "string", "first": "timestamp", "last": "timestamp", "deleted": "timestamp", "status": "string", "touched": "boolean"}
_FOUND = ", ".join(f"{c} {_TYPES[c]}" for c in [*REFS, "status"])


def _typed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).cast(_TYPES[c]).alias(c) for c in columns))


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def _index(events: DataFrame) -> DataFrame:
    return events.groupBy(*KEY).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("deleted").alias("deleted"))


def _semi(left: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    keys = keys.select(*KEY)
    return left.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, KEY, "left_semi")


def _deleted() -> Column:
    return F.col("deleted").isNotNull() & ~F.coalesce(F.col("last") > F.col("deleted"), F.lit(False))


def _status() -> Column:
    """What a reference is, given its parent's index row (nulls if there is none)."""
    return (
        F.when(F.col("first").isNull(), "missing")
        .when(_deleted(), "deleted")
        .when(F.col("first") > F.col("at"), "late")
        .otherwise("ok")
    )


def parent_events(parents: DataFrame, deletions: DataFrame) -> DataFrame:
    """What happened to parents: arrivals and deletions in one shape."""
    none = F.lit(None).cast("timestamp")
    came = parents.filter("key is not null").select(*KEY, "first", F.coalesce("last", "first").alias("last"), none.alias("deleted"))
    return _typed(came.unionByName(deletions.filter("key is not null").select(*KEY, none.alias("first"), none.alias("last"), "deleted")), EVENTS)


def _counted(df: DataFrame, save: Callable, name: str, **what: Column) -> tuple[DataFrame, dict]:
    """Saves a table and takes figures of it on the way."""
    seen = Observation()
    out = save(df.observe(seen, *(c.alias(k) for k, c in what.items())), name)
    return out, seen.get


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


def _once(rows: DataFrame) -> DataFrame:
    """One row per reference, that of its first arrival."""
    rest = [c for c in rows.columns if c not in ("child", "id")]
    order = ["at", *(c for c in rest if c != "at")]
    best = rows.groupBy("child", "id").agg(F.min(F.struct(*order)).alias("r"))
    return best.select("child", "id", "r.*").select(*rows.columns)


class KeyedRuns:
    """Append-only runs of rows with a key.

    ``FAN_IN`` runs of a level merge into one of the next, which is cut into
    ``BUCKETS`` by hash of the key, so a read for few keys opens few of its files
    and a row is rewritten once per level. The rows of one key spread over
    ``SPLIT`` files of a bucket. ``save`` writes a table and names it. A run is a
    table or, with ``batch``, the part of a table that has this value there.
    """

    def __init__(self, columns: list[str], save: Callable, combine: Callable | None = None, split: str | None = None):
        self.columns, self.save, self.combine, self.split = columns, save, combine, split
        self.levels: list[list[tuple[DataFrame, int | None]]] = []

    def add(self, run: DataFrame, batch: int | None = None, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, batch))
        if len(self.levels[level]) >= FAN_IN:
            rows = _union(self._scans(level, None))
            rows = (self.combine(rows) if self.combine else rows).withColumn("bucket", _bucket())
            part = [F.pmod(F.xxhash64(self.split), F.lit(SPLIT))] if self.split else []
            self.levels[level] = []
            self.add(self.save(rows.repartition("bucket", *part), f"level{level + 1}", ["bucket"]), None, level + 1)

    def _scans(self, level: int, buckets: list[int] | None) -> list[DataFrame]:
        """One scan per table, whatever number of its batches are runs."""
        of: dict[int, tuple[DataFrame, list]] = {}
        for run, batch in self.levels[level]:
            of.setdefault(id(run), (run, []))[1].append(batch)
        scans = [run.filter(F.col("batch").isin(batches)) if batches[0] is not None else run for run, batches in of.values()]
        if level and buckets is not None:
            scans = [x.filter(F.col("bucket").isin(buckets)) for x in scans]
        return [x.select(*self.columns) for x in scans]

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows, or of bucketed runs at least those of the buckets."""
        scans = [x for level in range(len(self.levels)) for x in self._scans(level, buckets)]
        return _union(scans) if scans else None

    def pruned(self) -> bool:
        return any(self.levels[1:])


class OrphanTracker:
    """Open references per (parent, key), advanced batch by batch.

    References have ``child, id, parent, key, at, period``, parents ``parent, key,
    first, last`` (first arrival and latest row of the delivered version),
    deletions ``parent, key, deleted``. Rows with a null key or id refer to nothing
    and are left out; a reference delivered again is the same one; further columns
    are ignored; empty batches only add a snapshot; batches may come in any order
    of time. Status of a reference: ``missing`` (no row of the parent so far),
    ``deleted`` (no row later than its latest deletion), ``late`` (the parent came
    after the reference; settled, but kept for the report), or ``ok``.

    With ``root``, a folder that survives this session, every batch leaves its
    tables and a manifest there and :meth:`restore` goes on from any batch; without,
    tables live in the session's shared folder.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root.rstrip("/") if root else None
        self.batch = None
        self.reset()

    def reset(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.events = KeyedRuns(EVENTS, self._save, _index)
        self.refs = KeyedRuns(REFS, self._save, split="id")
        self.late: list[tuple[int, DataFrame]] = []  # tables with late rows, and the number of their batch
        self.moved: list[tuple[int, DataFrame]] = []  # likewise, with keys whose earlier late rows have been judged anew
        self.late_first = None
        self.seq, self.before = 0, None
        self.open: DataFrame | None = None
        self.counts: list = []

    def _save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        if self.root is None:
            return written(df, name, partition_by)
        path = f"{self.root}/batch-{self.seq}/{name}-{self.n_saved}"
        self.n_saved += 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self._load(path, df.schema)

    def _load(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def advance(self, batch: int, refs: DataFrame, parents: DataFrame, deletions: DataFrame) -> None:
        """Takes one batch in and keeps a copy of it."""
        self.seq, self.n_saved = self.seq + 1, 0
        new = _typed(refs, REFS).filter("key is not null and id is not null")
        self._judge(batch, self._save(new, "refs"), self._save(parent_events(parents, deletions), "events"), None)

    def advance_stored(self, batch: int, refs: DataFrame, events: DataFrame) -> None:
        """Takes in those rows of two tables that have this ``batch``; the tables stay, so no copy is kept."""
        self.seq, self.n_saved = self.seq + 1, 0
        self._judge(batch, refs, events, batch)

    def _judge(self, batch: int, refs: DataFrame, events_of: DataFrame, part: int | None) -> None:
        mine = lambda df: df if part is None else df.filter(F.col("batch") == part)
        new, events = mine(refs).select(*REFS), mine(events_of).select(*EVENTS)
        # keys whose settled references may change: deleted ones, and those that turn out to be older than thought
        change = F.col("deleted").isNotNull() | (F.col("first") < F.lit(self.late_first) if self.late_first else F.lit(False))
        self.events.add(events_of, part)
        # one row per key that a new or waiting reference names
        asked = [new.select(*KEY, "at", F.lit(False).alias("touched")), events.filter(change).select(*KEY, F.lit(None).cast("timestamp").alias("at"), F.lit(True).alias("touched"))]
        if self.open is not None:
            asked.append(self.open.select(*KEY, "at", F.lit(False).alias("touched")))
        asked, n = _counted(_union(asked).groupBy(*KEY).agg(F.min("at").alias("at"), F.max("touched").alias("touched")), written, "asked", n=F.count(F.lit(1)))
        index = _index(_semi(self.events.read(self._buckets(self.events, asked, n["n"])), asked, n["n"]))
        bad = asked.join(index, KEY, "left").filter(F.col("touched") | (_status() != "ok")).drop("at")
        bad, n = _counted(bad, self._save, "bad", n=F.count(F.lit(1)), touched=F.count_if("touched"))
        meets = lambda rows, keys: rows.join(F.broadcast(keys), KEY) if n["n"] <= BROADCAST_KEYS else skew_join(rows, keys, KEY, "inner")
        judged = lambda rows, keys: meets(rows.select(*REFS), keys.select(*KEY, "first", "last", "deleted")).select(*REFS, _status().alias("status"), "first").filter("status <> 'ok'")
        rows = [judged(new, bad)]
        if self.open is not None:
            rows.append(judged(self.open, bad))
        if n["touched"]:
            gone = bad.filter(F.col("touched") & _deleted())
            old, late = self.refs.read(self._buckets(self.refs, gone, n["touched"])), self._late()
            if old is not None:
                rows.append(judged(old, gone))
            if late is not None:
                rows.append(judged(late, bad.filter("touched")))
            self.moved.append((self.seq, bad))
        self.refs.add(refs, part)
        late = F.col("status") == "late"
        now, n = _counted(_once(_union(rows)), self._save, "open", late=F.count_if(late), first=F.max(F.when(late, F.col("first"))))
        self.now, self.open = now, now.filter(~late).select(*REFS, "status")
        if n["late"]:
            self.late.append((self.seq, now))
            self.late_first = max(x for x in (self.late_first, n["first"]) if x is not None)
        self.batch = batch
        now, runs = self.open, (list(self.late), list(self.moved))
        count = lambda: self._count(batch, now, self._late(*runs))
        self.counts.append(count if self.root is None else [tuple(r) for r in count().collect()])  # a row per table and reason
        if self.root is not None:
            self._store()

    @staticmethod
    def _count(batch: int, now: DataFrame, late: DataFrame | None) -> DataFrame:
        kinds = [now.select("child", "id", "status")]
        if late is not None:
            kinds.append(late.select("child", "id", F.lit("late").alias("status")).distinct())
        return _union(kinds).groupBy("child", "status").count().select(F.lit(batch).cast("int").alias("batch"), "child", "status", F.col("count").alias("n_open"))

    def _buckets(self, runs: KeyedRuns, keys: DataFrame, n: int) -> list[int] | None:
        """The buckets of few keys; None where all are likely touched or no run has any."""
        if n > 4 * BUCKETS or not runs.pruned():
            return None
        return [r.b for r in keys.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS

    def _late(self, late: list | None = None, moved: list | None = None) -> DataFrame | None:
        """Late rows that no later batch has judged anew."""
        runs, moved = (self.late, self.moved) if late is None else (late, moved)
        if not runs:
            return None
        rows = _union([df.filter("status = 'late'").select(*REFS, F.lit(seq).alias("seq")) for seq, df in runs])
        moved = [df.filter("touched").select(*KEY, F.lit(seq).alias("seq")) for seq, df in moved if seq > runs[0][0]]
        if not moved:
            return rows
        last = _union(moved).groupBy(*KEY).agg(F.max("seq").alias("moved"))
        return rows.join(last, KEY, "left").filter("moved is null or seq >= moved").select(*rows.columns)

    def orphans(self) -> DataFrame:
        """The references whose parent is missing, deleted or came later, with their status."""
        late = self._late()
        parts = [x for x in (self.open, late.select(*REFS, F.lit("late").alias("status")) if late is not None else None) if x is not None]
        return _once(_union(parts)) if parts else self.spark.createDataFrame([], _FOUND)

    def history(self) -> DataFrame:
        """Counts after every batch."""
        if self.root is None and self.counts:
            return _union([count() for count in self.counts])
        return self.spark.createDataFrame([tuple(r) for of in self.counts for r in of], "batch int, child string, status string, n_open long")

    def _file(self, batch) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state-{batch}.json")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _store(self) -> None:
        """Writes the manifest of this batch; the tables that the last two no longer name are deleted."""
        at = lambda df: self.paths[id(df)][1]
        runs = lambda r: [[at(x) for x, _ in level] for level in r.levels]
        state = {
            "batch": self.batch, "seq": self.seq, "before": self.before, "events": runs(self.events), "refs": runs(self.refs), "late": [(n, at(x)) for n, x in self.late], "moved": [(n, at(x)) for n, x in self.moved],
            "now": at(self.now), "counts": self.counts, "late_first": self.late_first.isoformat() if self.late_first else None,
        }
        fs, path = self._file(self.batch)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        older = self._manifest(self.before)
        stale = _named(self._manifest(older["before"]) if older else None) - _named(older) - _named(state)
        for p in stale:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p), True)
        self.before = self.batch

    def _manifest(self, batch) -> dict | None:
        fs, path = self._file(batch)
        if batch is None or not fs.exists(path):
            return None
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def restore(self, batch=None) -> bool:
        """The state after ``batch``, by default the last one stored; False if there is none."""
        if batch is None:
            fs, folder = self._file(0)
            folder = folder.getParent()
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
            known = [int(n[6:-5]) for n in names if n.startswith("state-") and n.endswith(".json")]
            if not known:
                return False
            batch = max(known)
        state = self._manifest(batch)
        if state is None:
            return False
        self.reset()
        schema = lambda cols, more="": ", ".join(f"{c} {_TYPES[c]}" for c in cols) + more
        for name, runs, cols in (("events", self.events, EVENTS), ("refs", self.refs, REFS)):
            runs.levels = [[(self._load(p, schema(cols, ", bucket int" if level else "")), None) for p in of] for level, of in enumerate(state[name])]
        rows = schema([*REFS, "status", "first"])
        self.late = [(seq, self._load(p, rows)) for seq, p in state["late"]]
        self.moved = [(seq, self._load(p, schema([*KEY, "touched", "first", "last", "deleted"]))) for seq, p in state["moved"]]
        self.now = self._load(state["now"], rows)
        self.open = self.now.filter("status <> 'late'").select(*REFS, "status")
        self.batch, self.seq, self.before, self.counts = state["batch"], state["seq"], state["batch"], state["counts"]
        self.late_first = datetime.fromisoformat(state["late_first"]) if state["late_first"] else None
        return True


def _named(state: dict | None) -> set[str]:
    """The tables that a manifest names."""
    if state is None:
        return set()
    return {p for runs in (state["events"], state["refs"]) for level in runs for p in level} | {p for _, p in [*state["late"], *state["moved"]]} | {state["now"]}


_LONG_AGO = "0001-01-01 00:00:00"


def track(spark: SparkSession, sf_dir: str) -> OrphanTracker:
    """Replays the corpus year by year. An unknown arrival counts as the earliest."""
    old = F.lit(_LONG_AGO).cast("timestamp")
    when = lambda c: F.coalesce(F.col(c), old)
    signs = table(spark, sf_dir, "signs").select("id", F.col("inscription_id").alias("key"), when("ingested_at").alias("t"))
    ins = table(spark, sf_dir, "inscriptions").select("id", F.col("findspot_id").alias("key"), F.col("minoan_period").alias("period"), when("created_at").alias("made"), F.greatest(when("updated_at"), when("created_at")).alias("changed"))
    ins = ins.withColumn("t", F.explode(F.array_distinct(F.array("made", "changed"))))
    sem = table(spark, sf_dir, "sign_semantics").select("id", F.col("sign_id").alias("key"), when("ingested_at").alias("t"))
    spots = table(spark, sf_dir, "findspots").select("id", when("ingested_at").alias("t"))
    gone = table(spark, sf_dir, "deletions").select(F.col("table_name").alias("parent"), F.col("record_id").alias("key"), when("deleted_at").alias("deleted"))
    month = F.date_format("t", "yyyy-MM")
    ref = lambda df, child, parent, at, period: df.select(F.lit(child).alias("child"), "id", F.lit(parent).alias("parent"), "key", F.col(at).alias("at"), period.alias("period"), F.year("t").alias("batch"))
    refs = _union([ref(signs, "signs", "inscriptions", "t", month), ref(ins, "inscriptions", "findspots", "made", F.col("period")), ref(sem, "sign_semantics", "signs", "t", month)])
    stood = lambda df, name, first: df.select(F.lit(name).alias("parent"), F.col("id").alias("key"), F.col(first).alias("first"), F.col("t").alias("last"))
    events = parent_events(_union([stood(signs, "signs", "t"), stood(ins, "inscriptions", "made"), stood(spots, "findspots", "t")]), gone)
    refs = written(refs.filter("key is not null and id is not null"), "refs", ["batch"])
    events = written(events.withColumn("batch", F.year(F.coalesce("last", "deleted"))), "events", ["batch"])
    years = sorted(r.batch for r in refs.select("batch").union(events.select("batch")).distinct().collect())
    tracker = OrphanTracker(spark)
    for y in years:
        tracker.advance_stored(y, refs, events)
    return tracker


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).orphans()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select(F.col("child").alias("table_name"), F.col("id").alias("record_id"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, period (minoan_period of inscriptions, else month of arrival) and reason."""
    return _orphans(spark, sf_dir).groupBy(F.col("child").alias("table_name"), "period", F.col("status").alias("reason")).agg(F.count("*").alias("n"))


def p2_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and late references after each year."""
    return track(spark, sf_dir).history().select(F.col("batch").alias("year"), F.col("child").alias("table_name"), F.col("status").alias("reason"), "n_open")


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_snapshots": p2_snapshots}

_ORPHANS = """
WITH del AS (SELECT table_name, record_id, max(deleted_at) AS gone FROM deletions GROUP BY ALL),
par AS (
  SELECT 'inscriptions' AS parent, id AS key, min(created_at) AS first, max(greatest(updated_at, created_at)) AS last FROM inscriptions GROUP BY id
  UNION ALL SELECT 'findspots', id, min(ingested_at), max(ingested_at) FROM findspots GROUP BY id
  UNION ALL SELECT 'signs', id, min(ingested_at), max(ingested_at) FROM signs GROUP BY id
), refs AS (
  SELECT 'signs' AS child, id, 'inscriptions' AS parent, min(inscription_id) AS key, min(ingested_at) AS arr, strftime(min(ingested_at), '%Y-%m') AS period FROM signs GROUP BY id
  UNION ALL SELECT 'inscriptions', id, 'findspots', min(findspot_id), min(created_at), min(minoan_period) FROM inscriptions GROUP BY id
  UNION ALL SELECT 'sign_semantics', id, 'signs', min(sign_id), min(ingested_at), strftime(min(ingested_at), '%Y-%m') FROM sign_semantics GROUP BY id
), st AS (
  SELECT refs.*, CASE WHEN first IS NULL THEN 'missing' WHEN gone IS NOT NULL AND NOT last > gone THEN 'deleted' WHEN first > arr THEN 'late' ELSE 'ok' END AS status
  FROM refs LEFT JOIN par USING (parent, key) LEFT JOIN del ON table_name = parent AND record_id = key WHERE key IS NOT NULL
)
"""
_SNAPSHOTS = """
WITH y AS (SELECT DISTINCT year(t) AS y FROM (
  SELECT coalesce(ingested_at, TIMESTAMP '0001-01-01') AS t FROM signs UNION ALL SELECT coalesce(ingested_at, TIMESTAMP '0001-01-01') FROM findspots UNION ALL SELECT coalesce(ingested_at, TIMESTAMP '0001-01-01') FROM sign_semantics
  UNION ALL SELECT coalesce(created_at, TIMESTAMP '0001-01-01') FROM inscriptions UNION ALL SELECT greatest(coalesce(updated_at, TIMESTAMP '0001-01-01'), coalesce(created_at, TIMESTAMP '0001-01-01')) FROM inscriptions
  UNION ALL SELECT coalesce(deleted_at, TIMESTAMP '0001-01-01') FROM deletions WHERE record_id IS NOT NULL)),
i0 AS (SELECT id, findspot_id AS key, coalesce(created_at, TIMESTAMP '0001-01-01') AS made, greatest(coalesce(updated_at, TIMESTAMP '0001-01-01'), coalesce(created_at, TIMESTAMP '0001-01-01')) AS changed FROM inscriptions),
i AS (SELECT id, key, made, made AS t FROM i0 UNION ALL SELECT id, key, made, changed FROM i0),
s AS (SELECT id, inscription_id AS key, coalesce(ingested_at, TIMESTAMP '0001-01-01') AS t FROM signs), m AS (SELECT id, sign_id AS key, coalesce(ingested_at, TIMESTAMP '0001-01-01') AS t FROM sign_semantics),
rf AS (SELECT 'signs' AS child, id, 'inscriptions' AS parent, key, t AS arr, t FROM s UNION ALL SELECT 'inscriptions', id, 'findspots', key, made, t FROM i UNION ALL SELECT 'sign_semantics', id, 'signs', key, t, t FROM m),
pr AS (SELECT 'signs' AS parent, id AS key, t AS first, t FROM s UNION ALL SELECT 'inscriptions', id, made, t FROM i UNION ALL SELECT 'findspots', id, coalesce(ingested_at, TIMESTAMP '0001-01-01'), coalesce(ingested_at, TIMESTAMP '0001-01-01') FROM findspots),
dl AS (SELECT table_name AS parent, record_id AS key, coalesce(deleted_at, TIMESTAMP '0001-01-01') AS t FROM deletions WHERE record_id IS NOT NULL),
ry AS (SELECT y, child, id, parent, min(key) AS key, min(arr) AS arr FROM rf JOIN y ON year(t) <= y WHERE key IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
py AS (SELECT y, parent, key, min(first) AS first, max(t) AS last FROM pr JOIN y ON year(t) <= y GROUP BY ALL), dy AS (SELECT y, parent, key, max(t) AS gone FROM dl JOIN y ON year(t) <= y GROUP BY ALL),
st AS (SELECT y, child, CASE WHEN first IS NULL THEN 'missing' WHEN gone IS NOT NULL AND NOT last > gone THEN 'deleted' WHEN first > arr THEN 'late' ELSE 'ok' END AS reason FROM ry LEFT JOIN py USING (y, parent, key) LEFT JOIN dy USING (y, parent, key))
SELECT CAST(y AS INT) AS year, child AS table_name, reason, count(*) AS n_open FROM st WHERE reason <> 'ok' GROUP BY ALL
"""
SQL = {
    "p2_snapshots": _SNAPSHOTS,
    "p2_found": _ORPHANS + "SELECT child AS table_name, id AS record_id FROM st WHERE status <> 'ok'",
    "p2_report": _ORPHANS + "SELECT child AS table_name, period, status AS reason, count(*) AS n FROM st WHERE status <> 'ok' GROUP BY ALL",
}
