"""Ward clustering of points along the edges of a graph, in rounds of mutually best merges.

Only clusters that an edge joins may merge. Merging u and v costs n_u n_v / (n_u + n_v) times the squared distance of
their means; a round merges every pair that is the cheapest for both of its clusters (of equal costs the one of lower
ids), so a round's merges are disjoint and independent. Clusters and edges are tables: a merge adds two rows of sums,
renames the ends of edges and drops copies, so no cluster is ever one task's work, whatever its size. Once LOCAL clusters are
left, whose graph is small whatever the cloud's size, the same rounds go on in memory.

All merges are kept with their heights, a cluster's height being at least those of its parts; the cheapest n - k of them
give k clusters. Where costs never fall by a merge (on a complete graph), this is what merging the cheapest pair again and
again gives. On a sparse graph a cost can fall, when a new cluster's mean comes close to one that only one of its parts
touches; then the order of merges matters, and rounds may differ from single merges.

A graph in parts has its parts joined by edges between means: each cluster that is left gets one to the nearest other
one, until one cluster is left. Points without edges are such parts. Copies of edges and loops do not count. Clusters are
numbered by their smallest point id. Points with a null or NaN coordinate belong to none. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.operators.knn import AXES, knn
from pointweave.sources.scratch import removed, saved

#: Clusters that are merged in memory.
LOCAL = 256


def costs(edges: DataFrame, clusters: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """(u, v, cost, height) of the edges (u, v)."""
    side = lambda i: clusters.select(F.col("c").alias(i), F.col("n").alias(f"n{i}"), F.col("h").alias(f"h{i}"), *(F.col(c).alias(f"{c}{i}") for c in axes))
    gaps = (F.col(f"{c}u") / F.col("nu") - F.col(f"{c}v") / F.col("nv") for c in axes)
    d2 = reduce(lambda s, g: s + g * g, gaps, F.lit(0.0))
    cost = F.col("nu") * F.col("nv") / (F.col("nu") + F.col("nv")) * d2
    return edges.join(side("u"), "u").join(side("v"), "v").select("u", "v", cost.alias("cost"), F.greatest(cost, "hu", "hv").alias("height"))


def mutual(weighed: DataFrame) -> DataFrame:
    """(u, v, height) of the edges that are the best one of both ends; by cost, then ids, so that equal costs have an order."""
    key = F.struct("cost", "u", "v", "height")
    ends = weighed.select(F.col("u").alias("c"), key.alias("e")).unionByName(weighed.select(F.col("v").alias("c"), key.alias("e")))
    best = ends.groupBy("c").agg(F.min("e").alias("e"))
    return best.groupBy("e").agg(F.count("*").alias("k")).where("k = 2").select("e.u", "e.v", "e.height")


def merged(clusters: DataFrame, edges: DataFrame, merges: DataFrame, axes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Clusters and edges after merging v into u; u is the smaller id."""
    to = merges.select(F.col("v").alias("c"), F.col("u").alias("to"), "height")
    sums = clusters.join(to, "c", "left").groupBy(F.coalesce("to", "c").alias("c")).agg(F.sum("n").alias("n"), F.max(F.greatest("h", "height")).alias("h"), *(F.sum(c).alias(c) for c in axes))
    renamed = edges
    for i in ("u", "v"):
        renamed = renamed.join(to.select(F.col("c").alias(i), "to"), i, "left").withColumn(i, F.coalesce("to", i)).drop("to")
    return sums, renamed.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def bridges(clusters: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """(u, v): each cluster with the one of the nearest mean."""
    means = saved(clusters.select("c", *((F.col(c) / F.col("n")).alias(c) for c in axes)))
    near = knn(means, means, 1, ("c", "c"), itself=False, axes=axes)
    return near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def in_memory(clusters: pd.DataFrame, edges: pd.DataFrame, axes: tuple[str, ...]) -> list[tuple[int, int, float]]:
    """The merges (u, v, height) of a small graph, by the same rounds."""
    h = dict(zip(clusters["c"], clusters["h"]))
    n = dict(zip(clusters["c"], clusters["n"].astype(float)))
    sums = dict(zip(clusters["c"], clusters[list(axes)].to_numpy(float)))
    near: dict[int, set] = {c: set() for c in n}
    for u, v in zip(edges["u"], edges["v"]):
        near[u].add(v)
        near[v].add(u)
    mean = lambda c: sums[c] / n[c]
    found = []
    while len(n) > 1:
        if not any(near.values()):
            ids = sorted(n)
            m = np.array([mean(c) for c in ids])
            for i, c in enumerate(ids):
                d2 = ((m - m[i]) ** 2).sum(1)
                d2[i] = np.inf
                other = ids[int(d2.argmin())]
                near[c].add(other)
                near[other].add(c)
        best = {c: min((n[c] * n[o] / (n[c] + n[o]) * float(((mean(min(c, o)) - mean(max(c, o))) ** 2).sum()), min(c, o), max(c, o)) for o in near[c]) for c in n if near[c]}
        for c, e in best.items():
            if c == e[1] and best[e[2]] == e:
                cost, u, v = e
                h[u] = max(cost, h[u], h.pop(v))
                found.append((u, v, h[u]))
                n[u] += n.pop(v)
                sums[u] = sums[u] + sums.pop(v)
                for o in near.pop(v):
                    near[o].discard(v)
                    if o != u:
                        near[o].add(u)
                        near[u].add(o)
    return found


def dendrogram(points: DataFrame, edges: DataFrame, axes: tuple[str, ...] = AXES, local: int = LOCAL) -> DataFrame:
    """All merges (u, v, height, round) of v into u, one less than there are points (pid, x, ..), along (src, dst)."""
    clusters = saved(points.select(F.col("pid").alias("c"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("h"), *(F.col(c).cast("double").alias(c) for c in axes)))
    links = saved(edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())
    made, round_, schema = [], 0, "u long, v long, height double, round int"
    while clusters.limit(local + 1).count() > local:
        merges = saved(mutual(costs(links, clusters, axes)))
        if not merges.limit(1).count():
            links = saved(bridges(clusters, axes))
            continue
        made.append(merges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "height", F.lit(round_).alias("round")))
        after, less = merged(clusters, links, merges, axes)
        after, less = saved(after), saved(less)
        removed(clusters)
        removed(links)
        clusters, links, round_ = after, less, round_ + 1
    last = in_memory(clusters.toPandas(), links.toPandas(), axes)  # `local` clusters and the edges between them
    rest = points.sparkSession.createDataFrame([(int(u), int(v), float(h), round_ + i) for i, (u, v, h) in enumerate(last)], schema)
    return reduce(DataFrame.unionByName, made, rest)


def ward(points: DataFrame, edges: DataFrame, k: int, axes: tuple[str, ...] = AXES, local: int = LOCAL) -> DataFrame:
    """(pid, cluster) with k clusters (as many as there are points, if fewer), numbered from 0 by their smallest id."""
    there = reduce(lambda s, c: s & F.col(c).isNotNull() & ~F.isnan(c), axes, F.lit(True))
    points = saved(points.select("pid", *axes).where(there))
    merges = saved(dendrogram(points, edges, axes, local))
    undone = merges.orderBy(F.desc("height"), F.desc("round"), F.desc("u")).limit(max(0, k - 1))  # one for each further cluster
    taken = merges.join(F.broadcast(undone.select("v")), "v", "left_anti")
    # from the last round to the first: a merge's loser belongs to what its winner belongs to
    pointer = taken.select(F.col("v").alias("pid"), F.col("u").alias("up"))
    while True:
        ahead = pointer.select(F.col("pid").alias("up"), F.col("up").alias("next"))
        moved = saved(pointer.join(ahead, "up", "left").select("pid", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("more")))
        pointer = moved.select("pid", "up")
        if not moved.where("more").limit(1).count():
            break
    roots = points.select("pid").join(pointer, "pid", "left").select("pid", F.coalesce("up", "pid").alias("root"))
    numbered = roots.where("pid = root").select("root", (F.row_number().over(Window.orderBy("root")) - 1).cast("int").alias("cluster"))  # k rows
    return roots.join(numbered, "root").select("pid", "cluster")
