"""The registered queries of the point-cloud operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointweave.functions import color
from pointweave.operators import graph, mapping, rd
from pointweave.operators.knn import knn, nearest
from pointweave.sources.scratch import saved
from pointweave.sources.views import WIDTH, cloud, folded, original, rd_points, table, voxel_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E = "embedding[{0}]::DOUBLE"
_COLOUR = "greatest(0.0, least(255.0, round_even((embedding[{0}]::DOUBLE + 1) * 127.5, 0)))::DOUBLE AS {1}"
VIEWS = f"""cloud AS (SELECT vec_id AS pid, label AS patch, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  {_COLOUR.format(4, "red")}, {_COLOUR.format(5, "green")}, {_COLOUR.format(6, "blue")} FROM embeddings),
ori AS (SELECT * FROM cloud WHERE pid % 2 = 0),
fold AS (SELECT *, pid // 2 AS node, (pid // 2) // {WIDTH} AS gi, (pid // 2) % {WIDTH} AS gj FROM cloud WHERE pid % 2 = 1),
box AS (SELECT min(least(x, y, z)) AS low, max(greatest(x, y, z)) AS high FROM cloud),
vox AS (SELECT l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_extendedprice AS value FROM lineitem),
rdp AS (SELECT l_linestatus AS cloud, l_returnflag AS method, l_linenumber AS qp,
  round((8 - l_linenumber) * 0.25::DOUBLE + count(*) / 100.0::DOUBLE / 1000000.0::DOUBLE + avg(l_discount) / 10, 6) AS rate,
  round(50 - 2.5::DOUBLE * l_linenumber - 0.1::DOUBLE * l_linenumber * l_linenumber + avg(l_discount), 6) AS metric
  FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1, 2, 3)"""
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{VIEWS}{', ' + more if more else ''} {body}"


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


def share(c, low, high):
    """The place of c between low and high as a share; 0 where these are one."""
    return F.when(F.col(high) > F.col(low), (F.col(c) - F.col(low)) / (F.col(high) - F.col(low))).otherwise(0.0)


def box(points: DataFrame) -> DataFrame:
    return points.agg(F.min(F.least("x", "y", "z")).alias("low"), F.max(F.greatest("x", "y", "z")).alias("high"))


@query(sql("SELECT pid, round((x - low) / (high - low), 9) AS x, round((y - low) / (high - low), 9) AS y, round((z - low) / (high - low), 9) AS z FROM cloud, box"))
def normalize_points(spark, d):
    rows = cloud(spark, d)
    scaled = rows.crossJoin(F.broadcast(box(rows)))  # one row
    return scaled.select("pid", *(r(share(c, "low", "high"), 9).alias(c) for c in "xyz"))


@query(sql("SELECT pid, round((x - low) / (high - low) * (high - low) + low, 9) AS x, round((y - low) / (high - low) * (high - low) + low, 9) AS y, round((z - low) / (high - low) * (high - low) + low, 9) AS z FROM cloud, box"))
def denormalize_points(spark, d):
    rows = cloud(spark, d)
    scaled = rows.crossJoin(F.broadcast(box(rows)))  # one row
    width = F.col("high") - F.col("low")
    return scaled.select("pid", *(r(share(c, "low", "high") * width + F.col("low"), 9).alias(c) for c in "xyz"))


def voxels(spark, d, size: int = 32) -> DataFrame:
    rows = voxel_source(spark, d)
    low = rows.agg(F.min(F.least("x", "y", "z")).alias("low"), F.max(F.greatest("x", "y", "z")).alias("high"))
    rows = rows.crossJoin(F.broadcast(low))  # one row
    return rows.select("value", *(F.rint(share(c, "low", "high") * (size - 1)).cast("long").alias(c) for c in "xyz"))


_VOXELS = "low AS (SELECT min(least(x, y, z)) AS low, max(greatest(x, y, z)) AS high FROM vox), v AS (SELECT value, " + ", ".join(f"round_even(({c} - low) / (high - low) * 31, 0)::BIGINT AS {c}" for c in "xyz") + " FROM vox, low)"


@query(sql("SELECT x, y, z, sum(round_even(value * 100, 0)::BIGINT)::BIGINT / (100.0::DOUBLE * count(*)) AS value, floor(sum(round_even(value * 100, 0)::BIGINT)::BIGINT / (100.0::DOUBLE * count(*)))::BIGINT AS stored, count(*) AS n FROM v GROUP BY x, y, z", _VOXELS))
def voxelize_mean(spark, d):
    # prices are whole cents, so the sum is exact in any order
    mean = F.sum(F.rint(F.col("value") * 100).cast("long")) / (100.0 * F.count("*"))
    return voxels(spark, d).groupBy("x", "y", "z").agg(mean.alias("value"), F.floor(mean).alias("stored"), F.count("*").alias("n"))


@query(sql("SELECT DISTINCT x, y, z FROM v", _VOXELS))
def voxelize_distinct(spark, d):
    return voxels(spark, d).select("x", "y", "z").distinct()


def yuv_sql(mode: str) -> str:
    row = lambda m, add: f"greatest(0, least(255, {m[0]}::DOUBLE * red + {m[1]}::DOUBLE * green + {m[2]}::DOUBLE * blue + {add}))"
    return ", ".join(f"round({row(m, a)}, 6) AS {n}" for m, a, n in zip(color.MATRICES[mode], (0, 128, 128), "yuv"))


def yuv(rows: DataFrame, mode: str) -> DataFrame:
    return rows.select("pid", *(r(c).alias(n) for c, n in zip(color.rgb_to_yuv(F.col("red"), F.col("green"), F.col("blue"), mode), "yuv")))


@query(sql(f"SELECT pid, {yuv_sql('bt709')} FROM cloud"))
def rgb_to_yuv(spark, d):
    return yuv(cloud(spark, d), "bt709")


@query(sql(f"SELECT pid, {yuv_sql('bt601')} FROM cloud"))
def rgb_to_yuv_bt601(spark, d):
    return yuv(cloud(spark, d), "bt601")


def _rgb_sql() -> str:
    m = color.inverse(color.BT709)
    return ", ".join(f"round(greatest(0, least(255, {a!r}::DOUBLE * red + {b!r}::DOUBLE * (green - 128) + {c!r}::DOUBLE * (blue - 128))), 6) AS {n}" for (a, b, c), n in zip(m, ("r", "g", "b")))


@query(sql(f"SELECT pid, {_rgb_sql()} FROM cloud"))
def yuv_to_rgb(spark, d):
    return cloud(spark, d).select("pid", *(r(c).alias(n) for c, n in zip(color.yuv_to_rgb(F.col("red"), F.col("green"), F.col("blue")), "rgb")))


# colour error between each even point and the odd one behind it
_PAIRS = "p AS (SELECT a.pid, a.patch, " + ", ".join(
    f"(greatest(0, least(255, {m[0]}::DOUBLE * a.red + {m[1]}::DOUBLE * a.green + {m[2]}::DOUBLE * a.blue + {k})) - greatest(0, least(255, {m[0]}::DOUBLE * b.red + {m[1]}::DOUBLE * b.green + {m[2]}::DOUBLE * b.blue + {k}))) / 255 AS d{n}"
    for m, k, n in zip(color.BT709, (0, 128, 128), "yuv")
) + " FROM ori a JOIN fold b ON b.pid = a.pid + 1)"


def colour_differences(a: DataFrame, b: DataFrame, on: DataFrame) -> DataFrame:
    """YUV differences on the scale of 255 for each (a, b) of `on`."""
    left = a.select(F.col("pid").alias("a"), *(c.alias(f"{n}0") for c, n in zip(color.rgb_to_yuv(F.col("red"), F.col("green"), F.col("blue")), "yuv")))
    right = b.select(F.col("pid").alias("b"), *(c.alias(f"{n}1") for c, n in zip(color.rgb_to_yuv(F.col("red"), F.col("green"), F.col("blue")), "yuv")))
    return on.join(left, "a").join(right, "b").select("a", "b", *(((F.col(f"{n}0") - F.col(f"{n}1")) / 255).alias(f"d{n}") for n in "yuv"))


def paired(spark, d) -> DataFrame:
    a, b = original(spark, d), folded(spark, d)
    on = a.select(F.col("pid").alias("a"), (F.col("pid") + 1).alias("b"))
    return colour_differences(a, b, on)


def metrics(prefix: str = ""):
    out = []
    for n in "yuv":
        mse = F.avg(F.col(f"d{n}") * F.col(f"d{n}"))
        out += [r(mse, 9).alias(f"{prefix}{n}_mse"), r(F.avg(F.abs(f"d{n}")), 9).alias(f"{prefix}{n}_mae"), r(color.psnr(mse), 6).alias(f"{prefix}{n}_psnr")]
    return out


def metrics_sql(prefix: str = "") -> str:
    mse = lambda n: f"avg(d{n} * d{n})"
    return ", ".join(f"round({mse(n)}, 9) AS {prefix}{n}_mse, round(avg(abs(d{n})), 9) AS {prefix}{n}_mae, round(CASE WHEN {mse(n)} = 0 THEN 'inf'::DOUBLE ELSE -10 * log10({mse(n)}) END, 6) AS {prefix}{n}_psnr" for n in "yuv")


@query(sql(f"SELECT patch, {metrics_sql()} FROM p GROUP BY patch", _PAIRS))
def color_metrics(spark, d):
    return paired(spark, d).join(original(spark, d).select(F.col("pid").alias("a"), "patch"), "a").groupBy("patch").agg(*metrics())


@query(sql("SELECT pid, round(-10 * log10(greatest(dy * dy, 1e-8)), 6) AS psnr FROM p", _PAIRS))
def psnr_clamped(spark, d):
    return paired(spark, d).select(F.col("a").alias("pid"), r(color.clamped_psnr(F.col("dy") * F.col("dy"))).alias("psnr"))


@query(sql("SELECT least(floor((v - low) / (high - low) * 100), 99)::BIGINT AS bin, count(*) AS n FROM e, (SELECT min(v) AS low, max(v) AS high FROM e) GROUP BY 1", _PAIRS + ", e AS (SELECT round(abs(dy), 9) AS v FROM p WHERE dy <> 0)"))
def error_histogram(spark, d):
    e = paired(spark, d).where("dy <> 0").select(r(F.abs("dy"), 9).alias("v"))
    ends = e.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.least(F.floor(share("v", "low", "high") * 100), F.lit(99)).cast("long")
    return e.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row of ends


@query("SELECT o_orderstatus AS cloud, sum(o_orderkey)::BIGINT AS size, count(*) AS points, round(sum(o_orderkey)::BIGINT * 8.0::DOUBLE / count(*), 6) AS bpp FROM orders GROUP BY 1")
def bits_per_point(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("cloud")).agg(F.sum("o_orderkey").alias("size"), F.count("*").alias("points"))
    return g.select("*", r(color.bits_per_point(F.col("size"), F.col("points"))).alias("bpp"))


@query("SELECT l_returnflag AS variant, l_linenumber AS qp, sum(l_partkey)::BIGINT AS size, count(*) AS patches, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1, 2")
def merge_reports(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("qp")).agg(F.sum("l_partkey").alias("size"), F.count("*").alias("patches"), F.count_distinct("l_suppkey").alias("sources"))


@query(sql("SELECT pid, patch, 'ori' AS part FROM ori UNION ALL SELECT pid, patch, 'fold' FROM fold"))
def merge_clouds(spark, d):
    part = lambda rows, name: rows.select("pid", "patch", F.lit(name).alias("part"))
    return part(original(spark, d), "ori").unionByName(part(folded(spark, d), "fold"))


_NEAR = f"k AS (SELECT a.pid AS a, b.pid AS b, {_D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS rank FROM ori a, fold b), kb AS (SELECT b.pid AS b, a.pid AS a, {_D2} AS d2, row_number() OVER (PARTITION BY b.pid ORDER BY {_D2}, a.pid) AS rank FROM ori a, fold b)"


def pairs_of(found: DataFrame) -> DataFrame:
    return found.select("a", "b", r("d2", 9).alias("d2"))


@query(sql("SELECT a, b, round(d2, 9) AS d2 FROM k WHERE rank = 1", _NEAR))
def nn1(spark, d):
    return pairs_of(nearest(original(spark, d), folded(spark, d), ("pid", "pid")))


@query(sql("SELECT a, b, round(d2, 9) AS d2 FROM k WHERE rank = 2", _NEAR))
def nn2(spark, d):
    return pairs_of(nearest(original(spark, d), folded(spark, d), ("pid", "pid"), rank=2))


@query(sql("SELECT a, b, rank::INT AS rank, round(d2, 9) AS d2 FROM k WHERE rank <= 9", _NEAR))
def knn9(spark, d):
    return knn(original(spark, d), folded(spark, d), 9, ("pid", "pid")).select("a", "b", "rank", r("d2", 9).alias("d2"))


@query(sql(f"SELECT a, b, rank::INT AS rank FROM (SELECT a.pid AS a, b.pid AS b, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS rank FROM cloud a, cloud b WHERE a.pid <> b.pid) WHERE rank <= 5"))
def knn_self(spark, d):
    rows = cloud(spark, d)
    return knn(rows, rows, 5, ("pid", "pid"), itself=False).select("a", "b", "rank")


@query(sql("SELECT round((SELECT avg(d2) FROM k WHERE rank = 1) + (SELECT avg(d2) FROM kb WHERE rank = 1), 9) AS chamfer", _NEAR))
def chamfer(spark, d):
    a, b = original(spark, d), folded(spark, d)
    both = nearest(a, b, ("pid", "pid")).select(F.lit(0).alias("way"), "d2").unionByName(nearest(b, a, ("pid", "pid")).select(F.lit(1).alias("way"), "d2"))
    return both.groupBy("way").agg(F.avg("d2").alias("m")).agg(r(F.sum("m"), 9).alias("chamfer"))


@query(sql(f"SELECT round(var_pop(d2), 9) AS repulsion FROM (SELECT {_D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS rank FROM fold a, fold b) WHERE rank = 2"))
def repulsion(spark, d):
    rows = folded(spark, d)
    return nearest(rows, rows, ("pid", "pid"), rank=2).agg(r(F.var_pop("d2"), 9).alias("repulsion"))


def _directed(near: str, prefix: str, x: str, y: str) -> str:
    diff = ", ".join(f"(greatest(0, least(255, {m[0]}::DOUBLE * {x}.red + {m[1]}::DOUBLE * {x}.green + {m[2]}::DOUBLE * {x}.blue + {k})) - greatest(0, least(255, {m[0]}::DOUBLE * {y}.red + {m[1]}::DOUBLE * {y}.green + {m[2]}::DOUBLE * {y}.blue + {k}))) / 255 AS d{n}" for m, k, n in zip(color.BT709, (0, 128, 128), "yuv"))
    return f"SELECT {metrics_sql(prefix)} FROM (SELECT {diff} FROM {near} JOIN ori ON ori.pid = a JOIN fold ON fold.pid = b WHERE rank = 1)"


_NAMES = [f"{n}_{m}" for n in "yuv" for m in ("mse", "mae", "psnr")]


@query(sql("SELECT ab.*, ba.*, " + ", ".join(f"least(AB_{c}, BA_{c}) AS {c}" for c in _NAMES) + " FROM ab, ba", _NEAR + f", ab AS ({_directed('k', 'AB_', 'ori', 'fold')}), ba AS ({_directed('kb', 'BA_', 'fold', 'ori')})"))
def color_symmetric(spark, d):
    a, b = original(spark, d), folded(spark, d)
    ways = colour_differences(a, b, nearest(a, b, ("pid", "pid")).select("a", "b")).agg(*metrics("AB_"))
    back = colour_differences(b, a, nearest(b, a, ("pid", "pid")).select("a", "b")).agg(*metrics("BA_"))
    both = ways.crossJoin(back)  # one row each
    return both.select("*", *(F.least(f"AB_{c}", f"BA_{c}").alias(c) for c in _NAMES))


@query(sql("SELECT node, round(coalesce(avg(ori.red), 0), 6) AS red, count(ori.pid) AS n FROM fold LEFT JOIN k ON k.b = fold.pid AND rank = 1 LEFT JOIN ori ON ori.pid = k.a GROUP BY node", _NEAR))
def color_map_nn(spark, d):
    a, b = original(spark, d), folded(spark, d)
    near = nearest(a, b, ("pid", "node")).select("a", F.col("b").alias("node")).join(a.select(F.col("pid").alias("a"), "red"), "a")
    mean = near.groupBy("node").agg(F.avg("red").alias("red"), F.count("*").alias("n"))
    return b.select("node").join(mean, "node", "left").select("node", r(F.coalesce("red", F.lit(0.0))).alias("red"), F.coalesce("n", F.lit(0)).alias("n"))


_GREEDY = f"""kk AS (SELECT a, list({{'nd': b, 'd': sqrt(d2)}} ORDER BY d2, b) AS near, row_number() OVER (PARTITION BY patch ORDER BY a) - 1 AS i, patch
  FROM (SELECT a.pid AS a, a.patch, b.node AS b, {_D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.node) AS rk FROM ori a, fold b) WHERE rk <= 9 GROUP BY a, patch),
s AS (SELECT DISTINCT patch, -1::BIGINT AS i, NULL::BIGINT AS pid, NULL::BIGINT AS node, list_transform(range((SELECT max(node) + 1 FROM fold)), lambda q: 0::BIGINT) AS cnt FROM ori
  UNION ALL SELECT patch, i, pid, node, list_transform(cnt, lambda v, ix: v + (ix - 1 = node)::BIGINT) FROM (
    SELECT kk.patch, kk.i, kk.a AS pid, s.cnt, list_sort(list_transform(near, lambda e, ix: {{'c': s.cnt[e.nd + 1] * e.d, 'ix': ix, 'nd': e.nd}}))[1].nd::BIGINT AS node
    FROM s JOIN kk ON kk.patch = s.patch AND kk.i = s.i + 1))"""


def mapped(spark, d) -> DataFrame:
    return mapping.assigned(original(spark, d), folded(spark, d))


@query(sql("SELECT patch, pid, node FROM s WHERE i >= 0", _GREEDY, True))
def greedy_assign(spark, d):
    return mapped(spark, d)


@query(sql("SELECT fold.node, count(s.pid) AS n FROM fold LEFT JOIN s ON s.node = fold.node GROUP BY 1", _GREEDY, True))
def occupancy(spark, d):
    counts = mapped(spark, d).groupBy("node").agg(F.count("*").alias("n"))
    return folded(spark, d).select("node").join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


_FORWARD = _GREEDY + """, mean AS (SELECT s.node, round_even(avg(red), 0) AS red, round_even(avg(green), 0) AS green, round_even(avg(blue), 0) AS blue FROM s JOIN ori USING (pid) GROUP BY 1)"""


@query(sql(f"SELECT f.node, coalesce(m.red, o.red) AS red, coalesce(m.green, o.green) AS green, coalesce(m.blue, o.blue) AS blue FROM fold f LEFT JOIN mean m USING (node) JOIN (SELECT b.node, a.red, a.green, a.blue, row_number() OVER (PARTITION BY b.node ORDER BY {_D2}, a.pid) AS rk FROM ori a, fold b) o ON o.node = f.node AND rk = 1", _FORWARD, True))
def color_map_fwd(spark, d):
    a, b = original(spark, d), folded(spark, d)
    return mapping.forward(a, b, mapped(spark, d))


@query(sql("SELECT f.node, coalesce(m.red, 0) AS red, coalesce(m.green, 0) AS green, coalesce(m.blue, 0) AS blue FROM fold f LEFT JOIN mean m USING (node)", _FORWARD, True))
def color_map_fwd_nofill(spark, d):
    a, b = original(spark, d), folded(spark, d)
    return mapping.forward(a, b, mapped(spark, d), fill=False)


@query(sql("SELECT s.pid, m.red, m.green, m.blue FROM s JOIN mean m USING (node)", _FORWARD, True))
def color_map_bwd(spark, d):
    a, b, m = original(spark, d), folded(spark, d), saved(mapped(spark, d))
    return m.join(mapping.forward(a, b, m, fill=False), "node").select("pid", "red", "green", "blue")


_AXES = _NEAR + ", c AS (SELECT node, gi, gj, count(k.a) AS n FROM fold LEFT JOIN k ON k.b = fold.pid AND rank = 1 GROUP BY ALL)"
_AXIS = "SELECT {0} AS axis, {1} AS line, sum(n)::BIGINT AS total, round(sum(n) / greatest(count(*) FILTER (n <> 0), 1), 6) AS mean FROM c GROUP BY {1}"


@query(sql(_AXIS.format(0, "gi") + " UNION ALL " + _AXIS.format(1, "gj"), _AXES))
def occupancy_axis(spark, d):
    return axis_lines(spark, d)


def axis_lines(spark, d) -> DataFrame:
    a, b = original(spark, d), folded(spark, d)
    near = nearest(a, b, ("pid", "node")).groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))
    counts = b.select("node", "gi", "gj").join(near, "node", "left").select("gi", "gj", F.coalesce("n", F.lit(0)).alias("n"))
    one = lambda k, c: mapping.axis_occupancy(counts, c).select(F.lit(k).alias("axis"), "line", "total", r("mean").alias("mean"))
    return one(0, "gi").unionByName(one(1, "gj"))


@query(sql(f"SELECT node, gi, gj, round(gi / (n1 - 1), 9) AS u, round(gj / ({WIDTH} - 1), 9) AS v, gi IN (0, n1 - 1) OR gj IN (0, {WIDTH} - 1) AS border FROM fold, (SELECT max(gi) + 1 AS n1 FROM fold)"))
def lattice_borders(spark, d):
    rows = folded(spark, d)
    rows = rows.crossJoin(F.broadcast(rows.agg((F.max("gi") + 1).alias("n1"))))  # one row
    edge = F.col("gi").isin(0) | (F.col("gi") == F.col("n1") - 1) | F.col("gj").isin(0, WIDTH - 1)
    return rows.select("node", "gi", "gj", r(F.when(F.col("n1") > 1, F.col("gi") / (F.col("n1") - 1)).otherwise(0.0), 9).alias("u"), r(F.col("gj") / (WIDTH - 1), 9).alias("v"), edge.alias("border"))


_NEW_LINES = ", ".join("round(CASE WHEN before{0} IS NULL AND after{0} IS NULL THEN {0} WHEN {1}{0} IS NULL THEN 2 * {0} - {2}{0} ELSE ({1}{0} + {0}) / 2 END, 9) AS {0}".format(c, "{0}", "{1}") for c in "xyz")
_WORST_LINE = _AXES + ", worst AS (SELECT gi AS line FROM c GROUP BY gi ORDER BY sum(n) / greatest(count(*) FILTER (n <> 0), 1) DESC, gi LIMIT 1), l AS (SELECT gj, gi, " + ", ".join(f"{c}, lag({c}) OVER (PARTITION BY gj ORDER BY gi) AS before{c}, lead({c}) OVER (PARTITION BY gj ORDER BY gi) AS after{c}" for c in "xyz") + " FROM fold)"


@query(sql(f"SELECT gj, gi - 0.5::DOUBLE AS at, {_NEW_LINES.format('before', 'after')} FROM l, worst WHERE gi = line UNION ALL SELECT gj, gi + 0.5::DOUBLE, {_NEW_LINES.format('after', 'before')} FROM l, worst WHERE gi = line UNION ALL SELECT gj, gi::DOUBLE, round(x, 9), round(y, 9), round(z, 9) FROM l", _WORST_LINE))
def densify_step(spark, d):
    """The lattice line with the most points for each occupied cell gets a new line on each side."""
    worst = axis_lines(spark, d).where("axis = 0").orderBy(F.desc("mean"), "line").limit(1).select(F.col("line").alias("gi"))
    return mapping.densified(folded(spark, d), worst).select("gj", "at", *(r(c, 9).alias(c) for c in "xyz"))


_EDGES = "e AS (SELECT a.node AS src, b.node AS dst, 1.0::DOUBLE AS w FROM fold a JOIN fold b ON abs(a.gi - b.gi) + abs(a.gj - b.gj) = 1)"
_DENSITY = _EDGES + f", d AS (SELECT src, dst, ({_D2}) / sum(w) OVER (PARTITION BY src) AS w FROM e JOIN fold a ON a.node = src JOIN fold b ON b.node = dst), v AS (SELECT dst, sum(w) AS v FROM d GROUP BY 1), v2 AS (SELECT dst, (v - (SELECT min(v) FROM v)) / ((SELECT max(v) - min(v) FROM v)) AS v FROM v), dens AS (SELECT src, dst, w * v AS w FROM d JOIN v2 USING (dst))"


def edges(spark, d) -> DataFrame:
    return graph.lattice_edges(folded(spark, d))


@query(sql("SELECT src, dst, w FROM e", _EDGES))
def lattice_edges(spark, d):
    return edges(spark, d)


@query(sql("SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS w FROM e", _EDGES))
def adj_row_norm(spark, d):
    return graph.normalised_rows(edges(spark, d)).select("src", "dst", r("w", 9).alias("w"))


@query(sql("SELECT src, dst, round(w, 9) AS w FROM dens", _DENSITY))
def inverse_density(spark, d):
    return graph.inverse_density(edges(spark, d), folded(spark, d)).select("src", "dst", r("w", 9).alias("w"))


_CROSS = _NEAR + ", x AS (SELECT node, p AS pid, sum(w) AS w FROM (SELECT f.node, k.a AS p, sqrt(d2) AS w FROM k JOIN fold f ON f.pid = k.b WHERE rank = 1 UNION ALL SELECT f.node, kb.a, sqrt(d2) FROM kb JOIN fold f ON f.pid = kb.b WHERE rank = 1) GROUP BY 1, 2)"


@query(sql("SELECT node, pid, round(w, 9) AS w FROM x", _CROSS))
def adjacency_cross(spark, d):
    return graph.cross_adjacency(folded(spark, d), original(spark, d)).select("node", "pid", r("w", 9).alias("w"))


_NORM = "CASE WHEN abs(sum(w) OVER (PARTITION BY src)) > 1e-16 THEN w / sum(w) OVER (PARTITION BY src) ELSE 0 END AS w"


@query(sql("SELECT src AS node, " + ", ".join(f"round(CASE WHEN abs(sum(w)) > 1e-16 THEN sum(w * {c}) / sum(w) ELSE 0 END, 6) AS {c}" for c in "xyz") + " FROM (SELECT src, w, x, y, z FROM inner_ JOIN fold ON node = dst UNION ALL SELECT src, 2 * w, x, y, z FROM outer_ JOIN ori ON ori.pid = dst) GROUP BY 1", _DENSITY + ", " + _CROSS + f", inner_ AS (SELECT src, dst, {_NORM} FROM dens), x2 AS (SELECT node AS src, pid AS dst, (w - (SELECT min(w) FROM x)) / (SELECT max(w) - min(w) FROM x) AS w FROM x), outer_ AS (SELECT src, dst, {_NORM} FROM x2)"))
def refine_step(spark, d):
    return graph.refined(folded(spark, d), original(spark, d), edges(spark, d)).select("node", *(r(c).alias(c) for c in "xyz"))


_SMOOTH = _EDGES + ", lab AS (SELECT node AS pid, patch AS cluster, 1.0::DOUBLE AS w FROM fold), walk AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM (SELECT * FROM e UNION ALL SELECT node, node, 1.0 FROM fold)), sp AS (SELECT src AS pid, cluster, sum(walk.w) AS w FROM walk JOIN lab ON lab.pid = dst GROUP BY 1, 2), sm AS (SELECT pid, cluster, w / sqrt(sum(w * w) OVER (PARTITION BY pid)) AS w FROM sp)"


def smoothed(spark, d) -> DataFrame:
    rows = folded(spark, d)
    return graph.smoothed(edges(spark, d), rows.select(F.col("node").alias("pid"), F.col("patch").alias("cluster")))


@query(sql("SELECT pid, cluster, round(w, 9) AS w FROM sm", _SMOOTH))
def label_smooth_step(spark, d):
    return smoothed(spark, d).select("pid", "cluster", r("w", 9).alias("w"))


@query(sql("SELECT pid, cluster FROM (SELECT pid, cluster, row_number() OVER (PARTITION BY pid ORDER BY round(w, 9) DESC, cluster) AS k FROM sm) WHERE k = 1", _SMOOTH))
def label_argmax(spark, d):
    best = smoothed(spark, d).groupBy("pid").agg(F.max(F.struct(r("w", 9).alias("w"), (-F.col("cluster")).alias("c"))).alias("b"))
    return best.select("pid", (-F.col("b.c")).alias("cluster"))


@query(sql(f"SELECT k.a, k.b, round(2 * (a.x - b.x), 9) AS gx, round(2 * (a.y - b.y), 9) AS gy, round(2 * (a.z - b.z), 9) AS gz FROM k JOIN ori a ON a.pid = k.a JOIN fold b ON b.pid = k.b WHERE rank = 1", _NEAR))
def nn_gradient(spark, d):
    a, b = original(spark, d), folded(spark, d)
    near = nearest(a, b, ("pid", "pid"))
    p, q = (t.select(F.col("pid").alias(n), *(F.col(c).alias(n + c) for c in "xyz")) for t, n in ((a, "a"), (b, "b")))
    return near.join(p, "a").join(q, "b").select("a", "b", *(r(2 * (F.col(f"a{c}") - F.col(f"b{c}")), 9).alias(f"g{c}") for c in "xyz"))


@query("SELECT p_partkey, regexp_replace('cloud_vox10_' || p_name || '_vox11', 'vox\\d\\d', 'vox' || lpad((p_size % 10)::VARCHAR, 2, '0'), 'g') AS path, 'r' || lpad((p_size % 6 + 1)::VARCHAR, 2, '0') AS rate FROM part")
def rewrite_vox(spark, d):
    size = F.lpad((F.col("p_size") % 10).cast("string"), 2, "0")
    path = F.regexp_replace(F.concat(F.lit("cloud_vox10_"), "p_name", F.lit("_vox11")), F.lit(r"vox\d\d"), F.concat(F.lit("vox"), size))
    return table(spark, d, "part").select("p_partkey", path.alias("path"), F.format_string("r%02d", F.col("p_size") % 6 + 1).alias("rate"))


@query(sql("SELECT * FROM rdp"))
def rd_curve(spark, d):
    return rd_points(spark, d)


@query(sql("SELECT cloud, method, min(rate) FILTER (qp >= 5) AS lossless_rate, (count(*) FILTER (qp < 5))::BIGINT AS finite FROM rdp GROUP BY 1, 2"))
def lossless_rate(spark, d):
    """Points from qp 5 on count as lossless: their metric is infinite."""
    rows = rd_points(spark, d).withColumn("metric", F.when(F.col("qp") >= 5, F.lit(float("inf"))).otherwise(F.col("metric")))
    return rd.lossless(rows)
