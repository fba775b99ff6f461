"""Groups of everything linked directly or through others, by recursive low-diameter decomposition.

At each level every vertex draws an exponential shift and starts to grow a cluster at minus that shift; a vertex joins
the cluster that reaches it first. A cluster grows from hop to hop, each hop following only the vertices whose arrival became earlier in the last, until
none does. Clusters are contracted to super-vertices, and the edges between them are the next level's graph. Once the edges
left are counted to be few, one task carries the same recursion on. The levels' assignments are composed from the last one down.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.session import Saved, small_side

#: Rate of the exponential shifts: the mean shift is 1 / BETA hops, and about a share of BETA of the edges is cut.
BETA = 0.35
#: Edges that one task decomposes on its own, some 50 MB; above it a level is grown and contracted in Spark.
TASK_EDGES = 1 << 20


def decompose(a: np.ndarray, b: np.ndarray, beta: float = BETA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, roots) of the edges (a, b): the recursion in memory. A root is the smallest vertex of its component."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    n, rng, levels = len(vertices), np.random.default_rng(seed), []
    a, b = a[a != b], b[a != b]
    while len(a):
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        heads, size = target[first], np.diff(np.append(first, len(target)))
        at, cluster = -rng.exponential(1 / beta, n), np.arange(n)
        while True:
            reach = at[source] + 1
            best = np.minimum.reduceat(reach, first)
            better = best < at[heads]
            if not better.any():
                break
            hits = np.flatnonzero(reach == np.repeat(best, size))
            _, one = np.unique(np.repeat(np.arange(len(heads)), size)[hits], return_index=True)
            via = cluster[source[hits[one]]]
            at[heads[better]], cluster[heads[better]] = best[better], via[better]
        centers, label = np.unique(cluster, return_inverse=True)
        levels.append(label)
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        code = np.unique((low * len(centers) + high)[low != high])
        a, b, n = code // len(centers), code % len(centers), len(centers)
    whole = np.arange(n)
    for label in reversed(levels):
        whole = whole[label]
    _, smallest = np.unique(whole, return_index=True)
    return vertices, vertices[smallest][whole] if len(vertices) else vertices


def _start(vertex, level: int):
    """When the cluster of a vertex starts: minus an exponential draw from the vertex' hash and the level."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(level)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return F.log(u) / F.lit(BETA)


def _first(reach: DataFrame) -> DataFrame:
    """The earliest arrival (v, at, c) at each vertex."""
    return reach.groupBy("v").agg(F.min_by("c", "at").alias("c"), F.min("at").alias("at"))


def _grow(edges: DataFrame, level: int) -> tuple[Saved, int]:
    """((v, c): the cluster of each vertex of the symmetric `edges` (u, v); the hops it took). Each hop's changes are written."""
    hop = _first(edges.select("v", (_start(F.col("u"), level) + 1).alias("at"), F.col("u").alias("c")))
    hops = [Saved(hop.where(F.col("at") < _start(F.col("v"), level)), f"hop-{level}")]
    while hops[-1].count():
        known = hops[0].df
        for h in hops[1:]:
            known = known.unionByName(h.df)
        known = _first(known).select("v", F.col("at").alias("was"))
        front = small_side(hops[-1]).select(F.col("v").alias("u"), "at", "c")
        reach = _first(edges.join(front, "u").select("v", (F.col("at") + 1).alias("at"), "c"))
        sooner = reach.join(known, "v", "left").where(F.col("at") < F.coalesce("was", _start(F.col("v"), level)))
        hops.append(Saved(sooner.select("v", "c", "at"), f"hop-{level}"))
    known = hops[0].df
    for h in hops[1:]:
        known = known.unionByName(h.df)
    every = edges.select(F.col("u").alias("v")).distinct()
    labels = Saved(every.join(_first(known).select("v", "c"), "v", "left").select("v", F.coalesce("c", "v").alias("c")), f"labels-{level}")
    for h in hops:
        h.drop()
    return labels, len(hops)


def _contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between different clusters, each direction once."""
    one = edges.join(labels.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").select("cu", "v")
    two = one.join(labels.select("v", F.col("c").alias("cv")), "v").where("cu <> cv")
    return two.select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(v, root) of the vertices of a few symmetric edges (u, v)."""

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            v, root = decompose(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(root, pa.int64())], names=["v", "root"])

    return edges.where("u < v").select("u", "v").repartition(1).mapInArrow(run, "v bigint, root bigint")


def _roots(edges: DataFrame, task_edges: int) -> DataFrame:
    """(v, root) of the vertices that have an edge (a, b) to another."""
    both = edges.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
    level = Saved(both.select("e.u", "e.v").distinct(), "edges-0")
    levels: list[Saved] = []
    while level.count() > 2 * task_edges:
        labels, _ = _grow(level.df, len(levels))
        rest = Saved(_contract(level.df, labels.df), f"edges-{len(levels) + 1}")
        level.drop()
        levels.append(labels)
        level = rest
    whole = Saved(_in_one_task(level.df), "roots")
    level.drop()
    for labels in reversed(levels):
        upper = whole.df.select(F.col("v").alias("c"), F.col("root").alias("up"))
        lower = Saved(labels.df.join(upper, "c", "left").select("v", F.coalesce("up", "c").alias("root")), "roots")
        whole.drop()
        labels.drop()
        whole = lower
    return whole.df


def components(edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """(v, root) for each vertex of the edges (a, b), BIGINT: vertices have the same root exactly if they are connected.

    Edges may repeat, point both ways or to themselves; an edge with a null end is none. A vertex that only has an edge to
    itself is its own root. No edges: no rows. Each hop, level and composition is written to the shared folder, so a lost
    executor costs no more than the tasks at hand. `task_edges` is TASK_EDGES by default.
    """
    real = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    vertices = real.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    whole = _roots(real, TASK_EDGES if task_edges is None else task_edges)
    return vertices.join(whole, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def group_members(pairs: DataFrame, event: str, member: str) -> DataFrame:
    """(member, first) for each member that shares an event with another, directly or through others.

    `pairs` has one row or more for each (event, member); `first` is the smallest member of the group. Rows with a null
    event or member link nothing. An event of many members links each of them to its smallest one only, never all pairs.
    """
    known = pairs.where(F.col(event).isNotNull() & F.col(member).isNotNull()).select(F.col(event).alias("e"), F.col(member).alias("m")).distinct()
    known = Saved(known, "pairs")
    hubs = known.df.groupBy("e").agg(F.min("m").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("e", "hub")
    spokes = Saved(known.df.join(hubs, "e").where("m <> hub").select("hub", "m").distinct(), "spokes")
    known.drop()
    names = spokes.df.select(F.explode(F.array("hub", "m")).alias("m")).distinct()
    names = Saved(names.select("m", F.monotonically_increasing_id().alias("id")), "names")
    ends = names.df.select("m", F.col("id").alias("b"))
    links = spokes.df.join(ends, "m").select("hub", "b").join(names.df.select(F.col("m").alias("hub"), F.col("id").alias("a")), "hub").select("a", "b")
    roots = _roots(links, TASK_EDGES)  # no link is a loop
    found = Saved(names.df.join(roots.withColumnRenamed("v", "id"), "id").select("m", "root"), "members")
    first = found.df.groupBy("root").agg(F.min("m").alias("first"))
    return found.df.join(first, "root").select(F.col("m").alias(member), "first")
