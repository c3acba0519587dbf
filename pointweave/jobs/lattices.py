"""Registered queries about large clouds, gradients, curves by columns, patches and lattices as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import palette
from pointweave.jobs.patches import BEND, CURVATURE_K, GRAPH_K, SMOOTHING
from pointweave.jobs.queries import _GREEDY, _NEAR, QUERIES, SQL, cloud, folded, original, query, r, rd_points, sql, table
from pointweave.jobs.reports import codec_logs
from pointweave.operators import curvature as curves
from pointweave.operators import gradient, graph, mapping, rd, ward
from pointweave.operators.knn import knn, regions
from pointweave.sources import images, logs, manifest, ply_binary, reports
from pointweave.sources.scratch import folder, saved

#: All point-cloud queries, to which this module adds its own.
__all__ = ["QUERIES", "SQL"]

_PART = "pc AS (SELECT p_partkey AS i, p_retailprice::DOUBLE AS x, p_size::DOUBLE AS y, (p_partkey % 997)::DOUBLE AS z FROM part)"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def part_cloud(spark: SparkSession, d: str) -> DataFrame:
    at = {"x": F.col("p_retailprice"), "y": F.col("p_size"), "z": F.col("p_partkey") % 997}
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), *(c.cast("double").alias(n) for n, c in at.items()))


@query(f"WITH {_PART} SELECT a, b, rank::INT AS rank, round(d2, 6) AS d2 FROM (SELECT a.i AS a, b.i AS b, {_D2} AS d2, row_number() OVER (PARTITION BY a.i ORDER BY {_D2}, b.i) AS rank FROM pc a, pc b) WHERE rank <= 9")
def knn_cells(spark, d):
    """The cell join, whatever the cloud's size."""
    points = part_cloud(spark, d)
    return knn(points, points, 9, ("i", "i"), small=0).select("a", "b", "rank", r("d2").alias("d2"))


_ORDERS = "a AS (SELECT c_custkey AS i, c_acctbal::DOUBLE / 50 AS x, (c_custkey % 499)::DOUBLE AS y, c_nationkey::DOUBLE * 8 AS z FROM customer), b AS (SELECT o_orderkey AS i, o_totalprice::DOUBLE / 1000 AS x, (o_orderkey % 499)::DOUBLE AS y, (o_custkey % 199)::DOUBLE AS z FROM orders)"


@query(f"WITH {_ORDERS} SELECT a, m.b AS b, round(m.d2, 6) AS d2 FROM (SELECT a.i AS a, min({{'d2': {_D2}, 'b': b.i}}) AS m FROM a, b GROUP BY a.i)")
def nn_large(spark, d):
    """Each customer's nearest order, of more orders than are broadcast."""
    at = lambda t, i, x, y, z: table(spark, d, t).select(F.col(i).alias("i"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))
    a = at("customer", "c_custkey", F.col("c_acctbal").cast("double") / 50, F.col("c_custkey") % 499, F.col("c_nationkey").cast("double") * 8)
    b = at("orders", "o_orderkey", F.col("o_totalprice").cast("double") / 1000, F.col("o_orderkey") % 499, F.col("o_custkey") % 199)
    return knn(a, b, 1, ("i", "i")).select("a", "b", r("d2").alias("d2"))


def _both_ways(rank: int) -> str:
    one = lambda t, me, it, sign, side, near, weight: f"SELECT {rank} AS rank, '{side}' AS side, {me}.pid AS pid, " + ", ".join(f"{sign} 2 * ({weight} % 5 + 1) / 5 * (a.{c} - b.{c}) AS {c}" for c in "xyz") + f" FROM {t} n JOIN ori a ON a.pid = {near[0]} JOIN fold b ON b.pid = {near[1]} WHERE rank = {rank}"
    out = []
    for t, near, weight in (("k", ("n.a", "n.b"), "a.pid"), ("kb", ("n.a", "n.b"), "b.pid")):
        out += [one(t, "a", "b", "", "a", near, weight), one(t, "b", "a", "-", "b", near, weight)]
    return " UNION ALL ".join(out)


@query(sql("SELECT rank, side, pid, " + ", ".join(f"round(sum({c}), 9) AS g{c}" for c in "xyz") + f" FROM ({_both_ways(1)} UNION ALL {_both_ways(2)}) GROUP BY 1, 2, 3", _NEAR))
def nn_gradient_both(spark, d):
    """Gradients of both clouds from weighted distances to nearest and second nearest neighbours, both ways."""
    weigh = lambda rows: rows.withColumn("weight", (F.col("pid") % 5 + 1) / 5)
    a, b = weigh(original(spark, d)), weigh(folded(spark, d))
    one = lambda k: gradient.both_ways(a, b, k).select(F.lit(k).alias("rank"), "side", "pid", *(r(f"g{c}", 9).alias(f"g{c}") for c in "xyz"))
    return one(1).unionByName(one(2))


#: Cubics by orthogonal polynomials, and their integrals by Simpson's rule, which is exact for them.
_FITS = """u AS (SELECT 'rate' AS kind, cloud, method, metric AS x, ln(rate) AS y FROM pts UNION ALL SELECT 'snr', cloud, method, ln(rate), metric FROM pts),
q0 AS (SELECT *, x - avg(x) OVER w AS p1, avg(x) OVER w AS a0, avg(y) OVER w AS c0, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY kind, cloud, method)),
q1 AS (SELECT *, sum(p1 * p1) OVER w AS s1, sum(x * p1 * p1) OVER w / sum(p1 * p1) OVER w AS a1, sum(y * p1) OVER w / sum(p1 * p1) OVER w AS c1 FROM q0 WINDOW w AS (PARTITION BY kind, cloud, method)),
q2 AS (SELECT *, (x - a1) * p1 - s1 / n AS p2 FROM q1),
q3 AS (SELECT *, sum(p2 * p2) OVER w AS s2, sum(x * p2 * p2) OVER w / sum(p2 * p2) OVER w AS a2, sum(y * p2) OVER w / sum(p2 * p2) OVER w AS c2 FROM q2 WINDOW w AS (PARTITION BY kind, cloud, method)),
q4 AS (SELECT *, (x - a2) * p2 - s2 / s1 * p1 AS p3 FROM q3),
fit AS (SELECT kind, cloud, method, min(x) AS lo, max(x) AS hi, any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2, any_value(s1 / n) AS b1, any_value(s2 / s1) AS b2, any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2, sum(y * p3) / sum(p3 * p3) AS c3 FROM q4 GROUP BY ALL),
ends AS (SELECT m.kind, m.cloud, m.method, b.method AS anchor, greatest(m.lo, b.lo) AS lo, least(m.hi, b.hi) AS hi FROM fit m JOIN fit b ON b.kind = m.kind AND b.cloud = m.cloud AND b.method <> m.method),
spots AS (SELECT *, unnest([lo, (lo + hi) / 2, hi]) AS t, unnest([1, 4, 1]) AS w FROM ends),
vals AS (SELECT s.kind, s.cloud, s.method, s.anchor, w, f.method = s.method AS mine, c0 + c1 * (t - a0) + c2 * ((t - a1) * (t - a0) - b1) + c3 * ((t - a2) * ((t - a1) * (t - a0) - b1) - b2 * (t - a0)) AS v FROM spots s JOIN fit f ON f.kind = s.kind AND f.cloud = s.cloud AND f.method IN (s.method, s.anchor)),
gap AS (SELECT kind, cloud, method, anchor, sum(CASE WHEN mine THEN w * v ELSE -w * v END) / 6 AS g FROM vals GROUP BY ALL),
bd AS (SELECT a.cloud, a.method, a.anchor, round((exp(least(a.g, 200)) - 1) * 100, 6) AS bd_rate, round(b.g, 6) AS bd_snr FROM gap a JOIN gap b USING (cloud, method, anchor) WHERE a.kind = 'rate' AND b.kind = 'snr')"""


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: r(c) for c in ("bd_rate", "bd_snr")})


@query(sql("SELECT cloud, method, bd_rate, bd_snr FROM bd WHERE anchor = 'A'", f"pts AS (SELECT * FROM rdp), {_FITS}"))
def bd_rate(spark, d):
    return shown(rd.compared(rd_points(spark, d), "A"))


@query(sql("SELECT anchor, cloud, method, bd_rate, bd_snr FROM bd WHERE anchor IN ('A', 'N')", f"pts AS (SELECT * FROM rdp), {_FITS}"))
def rd_two_anchors(spark, d):
    """Every method against two anchors, by rate and by metric."""
    points = rd_points(spark, d)
    one = lambda a: shown(rd.compared(points, a)).select(F.lit(a).alias("anchor"), "*")
    return one("A").unionByName(one("N"))


#: Folders of the compared methods below that of the results, and the metrics of the comparison.
METHODS, MEASURES = {"A": "anchor", "N": "merged", "R": "refined_merged"}, ("y_psnr", "y_mse")
_MEASURED = "pts AS (SELECT cloud || '/' || m AS cloud, method, rate, CASE m WHEN 'y_psnr' THEN metric ELSE round(pow(10, (60 - metric) / 10), 6) END AS metric FROM rdp, unnest(['y_psnr', 'y_mse']) AS t(m))"


@query(sql("SELECT split_part(cloud, '/', 1) AS cloud, split_part(cloud, '/', 2) AS measure, CASE method WHEN 'N' THEN 'merged' ELSE 'refined_merged' END AS method, bd_rate, bd_snr FROM bd WHERE anchor = 'A'", f"{_MEASURED}, {_FITS}"))
def rd_compare(spark, d):
    """Trees of reports, one for each method, found by their folders and compared by both measures; what the comparison
    says is also written as a log."""
    rows = rd_points(spark, d).withColumns({"y_psnr": F.col("metric"), "y_mse": F.round(F.pow(F.lit(10.0), (60 - F.col("metric")) / 10), 6)})
    name = F.create_map(*(F.lit(x) for kv in METHODS.items() for x in kv))
    tree = reports.write(spark, rows.select(name[F.col("method")].alias("method"), "cloud", F.concat(F.lit("qp_"), "qp").alias("step"), F.col("rate").alias("color_bits_per_input_point"), *MEASURES), ["method", "cloud", "step"])
    found = reports.compared(spark, tree, "anchor", list(METHODS.values())[1:], list(MEASURES))
    return found.select("cloud", "measure", "method", r("bd_rate").alias("bd_rate"), r("bd_snr").alias("bd_snr"))


_WHOLE = "whole AS (SELECT * REPLACE (0 AS patch) FROM ori), " + _GREEDY.replace("FROM ori", "FROM whole") + ", o AS (SELECT fold.node, gi, gj, count(s.pid) AS n FROM fold LEFT JOIN s ON s.node = fold.node GROUP BY ALL)"
_LINES = "SELECT {0} AS axis, {1} AS line, sum(n)::BIGINT AS total, round(sum(n) / greatest(count(*) FILTER (n <> 0), 1), 6) AS mean FROM o GROUP BY {1}"


def edges_of(lattice: DataFrame) -> DataFrame:
    return saved(graph.lattice_edges(lattice))


def one_cloud(spark, d) -> DataFrame:
    return original(spark, d).withColumn("patch", F.lit(0))


@query(sql(_LINES.format(0, "gi") + " UNION ALL " + _LINES.format(1, "gj") + " UNION ALL SELECT -1, -1, sum(n)::BIGINT, round(sum(n) / greatest(count(*) FILTER (n <> 0), 1), 6) FROM o", _WHOLE, True))
def lattice_occupancy(spark, d):
    """Points of the balanced assignment over occupied nodes, for each line of both axes and (-1) for the whole lattice."""
    counts = saved(mapping.occupancy(one_cloud(spark, d), folded(spark, d)))
    line = lambda k, c: mapping.axis_occupancy(counts, c).select(F.lit(k).alias("axis"), F.col("line").cast("long").alias("line"), "total", r("mean").alias("mean"))
    whole = mapping.axis_occupancy(counts.withColumn("all", F.lit(-1)), "all").select(F.lit(-1).alias("axis"), F.col("line").cast("long").alias("line"), "total", r("mean").alias("mean"))
    return line(0, "gi").unionByName(line(1, "gj")).unionByName(whole)


@query()
def densify_loop(spark, d):
    """The lattice of one cloud, split at its worst line again and again until that no longer lowers the occupancy."""
    lattice, _ = mapping.optimised(one_cloud(spark, d), mapping.full(folded(spark, d)))
    return lattice.select("node", "gi", "gj", *(r(c).alias(c) for c in "xyz"))


def features(spark, d) -> DataFrame:
    """pid, x, y, z, the curvature's share of the cloud's diagonal as `bend`, and the curvature itself."""
    points = cloud(spark, d)
    k = max(1, round(CURVATURE_K * points.count() ** (1 / 3)))
    bent = curves.standardised(curves.curvature(points, k))
    extent = points.agg(F.sqrt(sum((F.pow(F.max(c) - F.min(c), F.lit(2.0)) for c in "xyz"), F.lit(0.0))).alias("scale"))
    rows = points.join(bent, "pid").crossJoin(F.broadcast(extent))  # one row
    return saved(rows.select("pid", *"xyz", (F.col("curvature") * F.col("scale") * BEND).alias("bend"), "curvature"))


#: The coordinates by which patches are cut.
FEATURES = ("x", "y", "z", "bend")


def cut(points: DataFrame, patches: int) -> tuple[DataFrame, DataFrame]:
    """(pid, cluster) by Ward's clustering of four coordinates along the graph of nearest neighbours, and that graph."""
    k = max(1, round(GRAPH_K * points.count() ** (1 / 3)))
    near = knn(points, points, k, ("pid", "pid"), itself=False, axes=FEATURES)
    links = saved(near.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")))
    return saved(ward.ward(points, links, patches, FEATURES)), links


#: Patches of the sample cloud.
PATCHES = 9


def ramp_sql(value: str, stops: palette.Stops) -> str:
    out = []
    for c, name in enumerate("rgb"):
        pieces = " ".join(f"WHEN {value} < {high} THEN {a[c]} + (greatest({value}, {low}) - {low}) / ({high} - {low})::DOUBLE * ({b[c] - a[c]})" for (low, a), (high, b) in zip(stops, stops[1:]))
        out.append(f"round_even(CASE {pieces} WHEN {value} IS NOT NULL THEN {stops[-1][1][c]} END::DOUBLE, 0)::INT AS {name}")
    return ", ".join(out)


@query(sql(f"SELECT pid, {ramp_sql('v', palette.SEGMENTS)} FROM (SELECT pid, patch / greatest((SELECT max(patch) FROM cloud), 1)::DOUBLE AS v FROM cloud)"))
def palette_map(spark, d):
    """The colours of the labels, evenly along a ramp."""
    points = cloud(spark, d)
    last = points.agg((F.max("patch") + 1).alias("count"))
    rows = points.crossJoin(F.broadcast(last))  # one row
    return rows.select("pid", *(c.alias(n) for c, n in zip(palette.labels(F.col("patch"), F.col("count")), "rgb")))


@query(sql(f"SELECT pid, {ramp_sql('v', palette.HEAT)} FROM (SELECT pid, red / 255 AS v FROM cloud)"))
def heat_map(spark, d):
    """A number of [0, 1] for each point as a colour from dark to light."""
    return cloud(spark, d).select("pid", *(c.alias(n) for c, n in zip(palette.ramp(F.col("red") / 255, palette.HEAT), "rgb")))


@query()
def ward_patches(spark, d):
    return cut(features(spark, d), PATCHES)[0]


@query()
def patch_cut(spark, d):
    """Patches from end to end: features, clustering and smoothing, written as one binary PLY source with the colours of
    the patches and of the curvature, and read again."""
    points = features(spark, d)
    label, links = cut(points, PATCHES)
    parts = regions(points, graph.parts_of(links.count()), axes=FEATURES)
    smooth = graph.smoothed_labels(links, label, round(SMOOTHING * points.count() ** (1 / 3)), parts)
    rows = points.join(smooth, "pid").withColumnRenamed("cluster", "patch")
    colours = [c.alias(n) for n, c in zip(("red", "green", "blue"), palette.labels(F.col("patch"), PATCHES))]
    heat = [c.alias(f"{n}_bend") for n, c in zip(("red", "green", "blue"), palette.ramp(F.col("curvature"), palette.HEAT))]
    path = folder(spark, "patches")
    spark.dataSource.register(ply_binary.PlySource)
    rows.select(F.col("pid").cast("int").alias("pid"), F.col("patch").cast("int").alias("patch"), *"xyz", *colours, *heat).write.format("ply").mode("append").save(path)
    return spark.read.format("ply").load(path).drop("file")


@query(sql("SELECT pid::INT AS pid, x, y, z, red::SMALLINT AS red, green::SMALLINT AS green, blue::SMALLINT AS blue FROM cloud"))
def ply_records(spark, d):
    """The cloud as binary PLY files, written by its tasks and read by byte ranges."""
    path = folder(spark, "records")
    spark.dataSource.register(ply_binary.PlySource)
    rows = cloud(spark, d).select(F.col("pid").cast("int").alias("pid"), *"xyz", *(F.col(c).cast("smallint").alias(c) for c in ("red", "green", "blue")))
    rows.write.format("ply").mode("append").save(path)
    return spark.read.format("ply").option("split", 1 << 16).load(path).drop("file")


@query(sql("SELECT 'fold' AS image, gi::INT AS gi, gj::INT AS gj, red::INT AS red, green::INT AS green, blue::INT AS blue FROM fold"))
def lattice_image(spark, d):
    """The colours of the lattice's nodes as a PNG file, and as rows again."""
    nodes = folded(spark, d)
    files = saved(images.pictures(nodes.select(F.lit("fold").alias("image"), "gi", "gj", "red", "green", "blue")))
    there = nodes.select(F.col("gi").cast("int").alias("gi"), F.col("gj").cast("int").alias("gj"))
    return images.pixels(files).join(there, ["gi", "gj"]).select("image", "gi", "gj", "red", "green", "blue")


@query(SQL["codec_report"].replace("FROM part", "FROM (SELECT s_suppkey AS p_partkey, s_suppkey % 50 + 1 AS p_size FROM supplier)"))
def codec_folders(spark, d):
    """codec_report of the suppliers, from a tree with one file for each log."""
    size = (F.col("s_suppkey") % 50 + 1).cast("int").alias("p_size")
    rows = codec_logs(table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), size)).where("points > 0")
    tree = logs.to_folders(spark, rows, "p_partkey", ["encoder", "metric"])
    read = logs.from_folders(spark, tree, r"/p_partkey=(-?\d+)/", {k: f"/kind={k}/" for k in ("encoder", "metric")})
    all_ = read.withColumn("p_partkey", F.col("folder").cast(rows.schema["p_partkey"].dataType)).join(rows.select("p_partkey", "points"), "p_partkey")
    rate = lambda c: r(F.col(f"{c}_bytes") * 8.0 / F.col("points"), 9).alias(f"{c}_bits_per_input_point")
    values = all_.select("p_partkey", *logs.encoder_values(F.col("encoder")), *logs.metric_values(F.col("metric")), "points")
    return values.select("*", rate("position"), rate("color"))


@query(sql("SELECT cloud || '/' || method AS item, count(*) AS points, min(rate) AS lowest, 0::BIGINT AS again FROM rdp GROUP BY 1"))
def resumed_outputs(spark, d):
    """One output for each curve, by a manifest; `again` is what a second run makes."""
    rows = rd_points(spark, d).withColumn("item", F.concat_ws("/", "cloud", "method"))
    path = folder(spark, "job")
    work = lambda todo: todo.join(rows, "item").groupBy("item").agg(F.count("*").alias("points"), F.min("rate").alias("lowest"))
    items = rows.select("item").distinct()
    manifest.resumed(items, path, work)
    again = manifest.resumed(items, path, work)
    return manifest.outputs(spark, path, "points long, lowest double").withColumn("again", F.lit(again).cast("long"))
