"""Networks of symbols: degree, clustering, PageRank, components, communities, betweenness.

Edges are pairs of symbols, at most the square of the alphabet; the rows of the
corpus are aggregated away before any of these runs.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from ..sequences import TOKENS_SQL, all_tokens, neighbours, r6
from ..tables import table
from .cooc import _cooc, cooccurrence

#: Up to this many edges (counted) a graph is solved in one task.
LOCAL_EDGES = 500_000


def undirected(tokens: DataFrame, least: int = 1) -> DataFrame:
    """``src, dst, weight`` with src < dst, from co-occurrence; a symbol alone has no edge."""
    return cooccurrence(tokens).filter("a < b").filter(F.col("n") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("weight"))


def succession(tokens: DataFrame) -> DataFrame:
    """Directed edges to the next symbol, without loops."""
    step = neighbours(tokens, 0, 1, ["symbol"]).filter("symbol_p1 is not null and symbol <> symbol_p1")
    return step.groupBy(F.col("symbol").alias("src"), F.col("symbol_p1").alias("dst")).agg(F.count("*").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).dropDuplicates(["src", "dst"])


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Neighbours over n - 1; 0 where there are at most two nodes."""
    d = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", "strength", r6(F.when(F.col("n") > 2, F.col("degree") / (F.col("n") - 1)).otherwise(0.0)).alias("centrality"))


def clustering(edges: DataFrame) -> DataFrame:
    """Share of a node's pairs of neighbours that are linked."""
    e = both_ways(edges).select("src", "dst")
    d = e.groupBy("src").agg(F.count("*").alias("k"))
    corner = e.select(F.col("src").alias("u"), F.col("dst").alias("a")).join(e.select(F.col("src").alias("u"), F.col("dst").alias("b")), "u").filter("a < b")
    closed = corner.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"]).groupBy(F.col("u").alias("src")).agg(F.count("*").alias("t"))
    return d.join(closed, "src", "left").select(F.col("src").alias("node"), r6(F.when(F.col("k") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)).alias("clustering"))


def pagerank(edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float = 1e-6, local: int = LOCAL_EDGES) -> DataFrame:
    """Unweighted PageRank with dangling mass spread evenly, until ranks move by less than ``tolerance`` in all.

    A graph of up to ``local`` edges (counted) is solved in one task. Beyond, each
    round is one job and a written table: a plan over several rounds would double
    with each, as a rank is read twice.
    """
    e = written(edges.select("src", "dst").distinct(), "edges")
    if e.count() <= local:
        return e.repartition(1).mapInPandas(_ranks(rounds, alpha, tolerance), "node string, rank double").select("node", r6("rank").alias("rank"))
    out = e.groupBy("src").agg(F.count("*").alias("k"))
    v = written(nodes(e).join(out.withColumnRenamed("src", "node"), "node", "left"), "nodes")
    n = v.count()
    rank = v.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds if n else 0):
        sent = e.join(rank.select(F.col("node").alias("src"), (F.col("rank") / F.col("k")).alias("r")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("r").alias("r"))
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        fresh = (1 - alpha) / n + alpha * (F.coalesce("r", F.lit(0.0)) + F.col("loose") / n)
        both = rank.join(sent, "node", "left").crossJoin(F.broadcast(loose))  # one row
        now = written(both.select("node", "k", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("moved")), "rank")
        rank = now.drop("moved")
        if tolerance and now.agg(F.sum("moved")).first()[0] < tolerance:
            break
    return rank.select("node", r6("rank").alias("rank"))


def _ranks(rounds, alpha, tolerance):
    def run(batches):
        pairs = pd.concat([pd.DataFrame({"src": [], "dst": []}), *batches])
        names, at = np.unique(pairs[["src", "dst"]].to_numpy(str), return_inverse=True)
        src, dst = at.reshape(-1, 2).T
        n = len(names)
        k = np.bincount(src, minlength=n)
        rank = np.full(n, 1.0 / max(n, 1))
        for _ in range(rounds if n else 0):
            sent = np.bincount(dst, rank[src] / k[src], minlength=n)
            now = (1 - alpha) / n + alpha * (sent + rank[k == 0].sum() / n)
            moved, rank = np.abs(now - rank).sum(), now
            if tolerance and moved < tolerance:
                break
        yield pd.DataFrame({"node": names, "rank": rank})

    return run


def components(edges: DataFrame) -> DataFrame:
    """Least reachable node of every node, by min-label propagation with pointer jumps to the fixpoint.

    A jump halves the way to the least node, so rounds grow with the logarithm of
    the longest path; there is no bound on them.
    """
    e = written(both_ways(edges).select("src", "dst"), "edges")
    label = written(nodes(e).withColumn("label", F.col("node")), "label")
    while True:
        near = e.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("m"))
        step = label.join(near, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old")
        now = written(jump, "label")
        label = now.select("node", "label")
        if not now.filter("label <> old").limit(1).count():
            return label.withColumnRenamed("label", "component")


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Synchronous weighted label propagation; ties take the least label.

    It ends when no label changes or after ``rounds``: labels that swap between two
    sides of a graph never settle, so the number of rounds is part of the result.
    """
    e = written(both_ways(edges), "edges")
    label = written(nodes(e).withColumn("label", F.col("node")), "label")
    for _ in range(rounds):
        w = e.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("weight").alias("w"))
        best = w.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("m")).select("node", F.col("m.label").alias("label"))
        now = written(best.join(label.withColumnRenamed("label", "old"), "node"), "label")
        label = now.select("node", "label")
        if not now.filter("label <> old").limit(1).count():
            break
    return label.withColumnRenamed("label", "community")


def betweenness(edges: DataFrame, scale: float = 1.0, most_edges: int = 2_000_000) -> DataFrame:
    """Brandes' betweenness of an unweighted graph: sources are spread over tasks, each holds the edges.

    The edges of a symbol graph are broadcast after they are counted; beyond
    ``most_edges`` this raises, since all-pairs paths (nodes times edges) are not an
    operation for larger graphs. Each source is a Python walk.
    """
    e = written(both_ways(edges).select("src", "dst"), "edges")
    if e.count() > most_edges:
        raise ValueError(f"more than {most_edges} edges")
    near = defaultdict(list)
    for r in e.orderBy("src", "dst").collect():
        near[r.src].append(r.dst)
    shared = edges.sparkSession.sparkContext.broadcast(dict(near))
    n = len(near)

    def run(batches):
        adj = shared.value
        total: dict[str, float] = defaultdict(float)
        for b in batches:
            for s in b["node"]:
                seen, order, paths, dist, before = {s}, [], defaultdict(float), {s: 0}, defaultdict(list)
                paths[s] = 1.0
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in adj.get(v, ()):
                        if w not in seen:
                            seen.add(w)
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share: dict[str, float] = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        total[w] += share[w]
        yield pd.DataFrame({"node": list(total), "b": list(total.values())})

    v = nodes(edges)
    sums = v.repartition(edges.sparkSession.sparkContext.defaultParallelism, "node").mapInPandas(run, "node string, b double").groupBy("node").agg(F.sum("b").alias("b"))
    factor = scale / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return v.join(sums, "node", "left").select("node", r6(F.coalesce("b", F.lit(0.0)) * factor).alias("betweenness"))


def summary(edges: DataFrame) -> DataFrame:
    n = nodes(edges).agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    return n.crossJoin(e).select("nodes", "edges", "weight", r6(F.try_divide(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1))).alias("density"))


def by_group(tokens: DataFrame, group: str) -> DataFrame:
    """Nodes, edges, weight, density and mean degree of the co-occurrence graph of every group of sequences, in one plan."""
    sets = tokens.filter(F.col(group).isNotNull()).groupBy(group, "seq_id").agg(F.sort_array(F.collect_set("symbol")).alias("s")).groupBy(group, "s").agg(F.count("*").alias("w"))
    left = sets.select(group, "w", "s", F.posexplode("s").alias("i", "a"))
    pairs = left.select(group, "w", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s") - F.col("i"))).alias("b")).groupBy(group, "a", "b").agg(F.sum("w").alias("weight"))
    ends = pairs.select(group, F.explode(F.array("a", "b")).alias("node")).groupBy(group, "node").agg(F.count("*").alias("degree"))
    n = ends.groupBy(group).agg(F.count("*").alias("nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    e = pairs.groupBy(group).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return n.join(e, group).select(group, "nodes", "edges", "weight", r6(F.try_divide(2 * F.col("edges"), possible)).alias("density"), r6("mean_degree").alias("mean_degree"), "max_degree")


def _sites(s, d):
    from ..skew import skew_join

    ins = table(s, d, "inscriptions").groupBy(F.col("id").alias("seq_id")).agg(F.min("findspot_id").alias("findspot_id"))
    return skew_join(written(all_tokens(s, d), "tokens"), ins, ["seq_id"], "inner")


def _und(s, d):
    return undirected(all_tokens(s, d))


QUERIES = {
    "graph_cooccurrence": lambda s, d: undirected(all_tokens(s, d)),
    "graph_succession": lambda s, d: succession(all_tokens(s, d)),
    "graph_summary": lambda s, d: summary(_und(s, d)),
    "degree": lambda s, d: degree(_und(s, d)),
    "clustering_coefficient": lambda s, d: clustering(_und(s, d)),
    "pagerank_20": lambda s, d: pagerank(succession(all_tokens(s, d)), 20, tolerance=0.0),
    "components": lambda s, d: components(_und(s, d)),
    "label_propagation": lambda s, d: label_propagation(_und(s, d)),
    "betweenness": lambda s, d: betweenness(_und(s, d)),
    "graph_by_site": lambda s, d: by_group(_sites(s, d), "findspot_id"),
}

_E = TOKENS_SQL + _cooc() + ", e AS (SELECT a AS src, b AS dst, n AS weight FROM co WHERE a < b AND n >= {0}), bw AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"
_SUCC = TOKENS_SQL + ", sx AS (SELECT symbol AS src, lead(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS dst FROM tok), sc AS (SELECT src, dst, count(*) AS weight FROM sx WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)"
_PR = "".join(
    f", r{i + 1} AS MATERIALIZED (SELECT v.node, v.k, 0.15 / n + 0.85 * (coalesce(s, 0) + l / n) AS rank FROM v LEFT JOIN (SELECT f.dst AS node, sum(rank / k) AS s FROM f JOIN r{i} ON r{i}.node = f.src GROUP BY 1) USING (node), nn, (SELECT coalesce(sum(rank) FILTER (k IS NULL), 0) AS l FROM r{i}))" for i in range(20)
)
_LP = "".join(
    f", l{i + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT bw.src AS node, l.label, sum(weight) AS w FROM bw JOIN l{i} l ON l.node = bw.dst GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, label) = 1)" for i in range(20)
)
# paths level by level: every pair of this graph is at most 6 steps apart
_BFS = ", p0 AS MATERIALIZED (SELECT DISTINCT src AS s, src AS t, 0 AS d, 1.0::DOUBLE AS k FROM bw)" + "".join(
    f", p{i + 1} AS MATERIALIZED (SELECT p.s, bw.dst AS t, {i + 1} AS d, sum(k) AS k FROM p{i} p JOIN bw ON bw.src = p.t WHERE (p.s, bw.dst) NOT IN ({' UNION ALL '.join(f'SELECT (s, t) FROM p{j}' for j in range(i + 1))}) GROUP BY ALL)" for i in range(6)
) + f", ap AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM p{j}' for j in range(7))})"
SQL = {
    "graph_cooccurrence": _E.format(1) + "SELECT * FROM e",
    "graph_succession": _SUCC + "SELECT * FROM sc",
    "graph_summary": _E.format(1) + "SELECT (SELECT count(DISTINCT src) FROM bw) AS nodes, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight, round(2 * count(*) / ((SELECT count(DISTINCT src) FROM bw) * ((SELECT count(DISTINCT src) FROM bw) - 1)), 6) AS density FROM e",
    "degree": _E.format(1) + "SELECT src AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength, round(count(*) / ((SELECT count(DISTINCT src) FROM bw) - 1), 6) AS centrality FROM bw GROUP BY src",
    "clustering_coefficient": _E.format(1)
    + ", d AS (SELECT src, count(*) AS k FROM bw GROUP BY src), c AS (SELECT x.src, count(*) AS t FROM bw x JOIN bw y ON x.src = y.src AND x.dst < y.dst JOIN bw z ON z.src = x.dst AND z.dst = y.dst GROUP BY x.src) SELECT d.src AS node, round(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN c USING (src)",
    "pagerank_20": _SUCC
    + ", f AS (SELECT DISTINCT src, dst FROM sc), v AS (SELECT node, k FROM (SELECT src AS node FROM f UNION SELECT dst FROM f) LEFT JOIN (SELECT src AS node, count(*) AS k FROM f GROUP BY 1) USING (node)), nn AS (SELECT count(*) AS n FROM v), r0 AS (SELECT node, k, 1.0::DOUBLE / n AS rank FROM v, nn)"
    + _PR
    + " SELECT node, round(rank, 6) AS rank FROM r20",
    "components": _E.format(1).replace("WITH t0", "WITH RECURSIVE t0")
    + ", cl(node, label) AS (SELECT src, src FROM bw UNION SELECT bw.src, cl.label FROM bw JOIN cl ON cl.node = bw.dst) SELECT node, min(label) AS component FROM cl GROUP BY node",
    "label_propagation": _E.format(1) + ", l0 AS (SELECT DISTINCT src AS node, src AS label FROM bw)" + _LP + " SELECT node, label AS community FROM l20",
    "betweenness": _E.format(1)
    + _BFS
    + """, sums AS (SELECT x.t AS node, sum(x.k * y.k / z.k) AS b FROM ap x JOIN ap y ON x.t = y.s JOIN ap z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.s <> x.t AND y.s <> y.t GROUP BY 1),
n AS (SELECT count(DISTINCT src) AS n FROM bw) SELECT node, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM (SELECT DISTINCT src AS node FROM bw) LEFT JOIN sums USING (node), n""",
    "graph_by_site": TOKENS_SQL
    + """, i AS (SELECT id AS seq_id, min(findspot_id) AS findspot_id FROM inscriptions GROUP BY id), it AS (SELECT DISTINCT findspot_id, seq_id, symbol FROM tok JOIN i USING (seq_id) WHERE findspot_id IS NOT NULL),
e AS (SELECT x.findspot_id, x.symbol AS a, y.symbol AS b, count(*) AS w FROM it x JOIN it y ON x.seq_id = y.seq_id AND x.symbol < y.symbol GROUP BY ALL),
d AS (SELECT findspot_id, node, count(*) AS degree FROM (SELECT findspot_id, a AS node FROM e UNION ALL SELECT findspot_id, b FROM e) GROUP BY ALL),
n AS (SELECT findspot_id, count(*) AS nodes, avg(degree) AS mean_degree, max(degree) AS max_degree FROM d GROUP BY 1), g AS (SELECT findspot_id, count(*) AS edges, CAST(sum(w) AS BIGINT) AS weight FROM e GROUP BY 1)
SELECT findspot_id, nodes, edges, weight, round(2 * edges / (nodes * (nodes - 1)), 6) AS density, round(mean_degree, 6) AS mean_degree, max_degree FROM n JOIN g USING (findspot_id)""",
}
