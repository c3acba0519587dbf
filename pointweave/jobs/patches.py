"""Registered queries about patches: sizing, features, smoothing, refinement, files and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.jobs.queries import _D2, _EDGES, _PAIRS, QUERIES, SQL, WIDTH, cloud, edges, folded, original, paired, query, r, rd_points, sql, table
from pointweave.operators import curvature as curves
from pointweave.operators import graph, refine
from pointweave.operators.knn import knn, regions
from pointweave.sources import ply
from pointweave.sources.scratch import folder

#: All point-cloud queries: those of `queries`, to which this module adds its own.
__all__ = ["QUERIES", "SQL"]

#: Points of a patch, golden ratio of its lattice, and factors of the cube root of its points.
PATCH_POINTS, GOLDEN, CURVATURE_K, GRAPH_K, SMOOTHING, BEND = 65_536, 1.618, 1.6, 0.4, 2, 0.04


def rounded_root(n, factor: float):
    return F.rint(factor * F.cbrt(n)).cast("long")


@query(sql(f"SELECT patch, count(*) AS n, greatest(count(*) // {PATCH_POINTS}, 1)::BIGINT AS patches, floor(sqrt(count(*) / {GOLDEN}::DOUBLE))::BIGINT AS n1, floor({GOLDEN}::DOUBLE * sqrt(count(*) / {GOLDEN}::DOUBLE))::BIGINT AS n2, round_even({CURVATURE_K}::DOUBLE * cbrt(count(*)), 0)::BIGINT AS k FROM cloud GROUP BY patch"))
def patch_sizing(spark, d):
    n = F.col("n")
    side = F.sqrt(n / GOLDEN)
    rows = cloud(spark, d).groupBy("patch").agg(F.count("*").alias("n"))
    return rows.select("patch", "n", F.greatest(F.floor(n / PATCH_POINTS), F.lit(1)).alias("patches"), F.floor(side).alias("n1"), F.floor(GOLDEN * side).alias("n2"), rounded_root(n, CURVATURE_K).alias("k"))


@query(sql("SELECT patch, " + ", ".join(f"min({c}) AS {c}_low, max({c}) AS {c}_high" for c in "xyz") + ", round(sqrt(" + " + ".join(f"pow(max({c}) - min({c}), 2)" for c in "xyz") + "), 9) AS scale FROM cloud GROUP BY patch"))
def patch_extents(spark, d):
    ends = [f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    wide = sum((F.pow(F.max(c) - F.min(c), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    return cloud(spark, d).groupBy("patch").agg(*ends, r(F.sqrt(wide), 9).alias("scale"))


@query(sql("SELECT a, b, rank, dx, dy, dz FROM (SELECT a.pid AS a, b.pid AS b, " + ", ".join(f"round(b.{c} - a.{c}, 9) AS d{c}" for c in "xyz") + f", row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid)::INT AS rank FROM cloud a, cloud b) WHERE rank <= 9"))
def neighbour_offsets(spark, d):
    points = cloud(spark, d)
    at = lambda i: points.select(F.col("pid").alias(i), *(F.col(c).alias(f"{i}{c}") for c in "xyz"))
    near = knn(points, points, 9, ("pid", "pid")).join(at("b"), "b").join(at("a"), "a")
    return near.select("a", "b", "rank", *(r(F.col(f"b{c}") - F.col(f"a{c}"), 9).alias(f"d{c}") for c in "xyz"))


@query(sql("SELECT node, " + ", ".join(f"CASE WHEN gi IN (0, last) OR gj IN (0, {WIDTH} - 1) THEN 255.0::DOUBLE ELSE {c} END AS {c}" for c in ("red", "green", "blue")) + " FROM fold, (SELECT max(gi) AS last FROM fold)"))
def highlight_borders(spark, d):
    nodes = folded(spark, d)
    last = nodes.agg(F.max("gi").alias("last"))
    border = F.col("gi").isin(0) | (F.col("gi") == F.col("last")) | F.col("gj").isin(0, WIDTH - 1)
    return nodes.crossJoin(F.broadcast(last)).select("node", *(F.when(border, 255.0).otherwise(F.col(c)).alias(c) for c in ("red", "green", "blue")))  # one row


@query(sql("SELECT pid, round_even(255 * patch / greatest((SELECT max(patch) FROM cloud), 1)::DOUBLE, 0)::BIGINT AS grey FROM cloud"))
def segmentation_preview(spark, d):
    points = cloud(spark, d)
    top = points.agg(F.greatest(F.max("patch"), F.lit(1)).cast("double").alias("top"))
    return points.crossJoin(F.broadcast(top)).select("pid", F.rint(255 * F.col("patch") / F.col("top")).cast("long").alias("grey"))  # one row


@query(sql("SELECT node, coalesce(o.n, 0)::BIGINT AS out_degree, coalesce(i.n, 0)::BIGINT AS in_degree FROM fold LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON o.src = node LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON i.dst = node", _EDGES))
def adjacency_sums(spark, d):
    links = edges(spark, d)
    ends = links.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(links.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    ends = ends.unionByName(folded(spark, d).select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


@query(sql("SELECT node, " + ", ".join(f"round(coalesce(avg(o.{c}), 0), 6) AS {c}" for c in ("red", "green", "blue")) + " FROM fold f LEFT JOIN ori o ON o.pid % 97 = f.node GROUP BY node"))
def segment_mean(spark, d):
    """Mean colour of each node's segment of points, 0 where a segment is empty."""
    parts = original(spark, d).groupBy((F.col("pid") % 97).alias("node")).agg(*(F.avg(c).alias(c) for c in ("red", "green", "blue")))
    return folded(spark, d).select("node").join(parts, "node", "left").select("node", *(r(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("red", "green", "blue")))


@query(sql("SELECT patch, round(0.8::DOUBLE * avg(dy * dy) + 0.1::DOUBLE * avg(du * du) + 0.1::DOUBLE * avg(dv * dv), 9) AS loss FROM p GROUP BY patch", _PAIRS))
def weighted_colour_loss(spark, d):
    mse = lambda c: F.avg(F.col(c) * F.col(c))
    return paired(spark, d).join(original(spark, d).select(F.col("pid").alias("a"), "patch"), "a").groupBy("patch").agg(r(0.8 * mse("dy") + 0.1 * mse("du") + 0.1 * mse("dv"), 9).alias("loss"))


@query("SELECT event_type, count(*) AS reports, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, count(DISTINCT json_extract_string(props, '$.k')::BIGINT) AS kinds FROM events GROUP BY 1")
def parse_reports(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("reports"), F.sum(k).alias("total"), F.count_distinct(k).alias("kinds"))


@query("SELECT l_orderkey AS cloud, sum(l_partkey)::BIGINT AS size, string_agg(l_linenumber || ':' || l_partkey, ';' ORDER BY l_linenumber, l_partkey) AS data FROM lineitem GROUP BY 1")
def nested_reports(spark, d):
    """The reports of one cloud's patches, kept within the merged one; a cloud has a handful."""
    patch = F.struct("l_linenumber", "l_partkey")
    merged = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cloud")).agg(F.sum("l_partkey").alias("size"), F.sort_array(F.collect_list(patch)).alias("data"))
    text = F.transform("data", lambda p: F.concat_ws(":", p["l_linenumber"].cast("string"), p["l_partkey"].cast("string")))
    return merged.select("cloud", "size", F.array_join(text, ";").alias("data"))


@query(sql("SELECT * FROM rdp"))
def csv_reports(spark, d):
    """The rate table written as CSV and read again."""
    rows, path = rd_points(spark, d), folder(spark, "report")
    rows.write.option("header", "true").csv(path)
    return spark.read.schema(rows.schema).option("header", "true").csv(path)


@query(sql("SELECT x, y, z, red::INT AS red, green::INT AS green, blue::INT AS blue FROM cloud"))
def ply_patches(spark, d):
    """The cloud written as one PLY file for each patch and read again."""
    path = folder(spark, "ply")
    ply.write(cloud(spark, d), path)
    points = ply.read(spark, path)
    return points.select(*(F.col(c).cast("double").alias(c) for c in "xyz"), *(F.col(c).cast("int").alias(c) for c in ("red", "green", "blue")))


@query()
def curvature(spark, d):
    points = cloud(spark, d)
    k = max(1, round(CURVATURE_K * points.count() ** (1 / 3)))
    return curves.standardised(curves.curvature(points, k)).select("pid", r("curvature").alias("curvature"))


@query()
def curvature_features(spark, d):
    """Coordinates and, as a fourth, the curvature scaled by the cloud's diagonal."""
    points = cloud(spark, d)
    extent = points.agg(F.sqrt(sum((F.pow(F.max(c) - F.min(c), F.lit(2.0)) for c in "xyz"), F.lit(0.0))).alias("scale"))
    rows = points.join(curvature(spark, d), "pid").crossJoin(F.broadcast(extent))  # one row
    return rows.select("pid", "x", "y", "z", r(F.col("curvature") * F.col("scale") * BEND).alias("bend"))


@query()
def refine_rounds(spark, d):
    """All of the operator's hundred rounds of refinement."""
    out = refine.refined_often(folded(spark, d), original(spark, d), edges(spark, d))
    return out.select("node", *(r(c).alias(c) for c in "xyz"))


@query()
def label_smoothing(spark, d):
    """The patches of all points smoothed over the graph of their nearest neighbours."""
    points = cloud(spark, d)
    n = points.count()
    root = n ** (1 / 3)
    k = max(1, round(GRAPH_K * root))
    near = knn(points, points, k, ("pid", "pid"), itself=False)
    links = near.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w"))
    return graph.smoothed_labels(links, points.select("pid", F.col("patch").alias("cluster")), round(SMOOTHING * root), regions(points, graph.parts_of(n * k)))
