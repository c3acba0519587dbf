"""Point-cloud views of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of the lattice that the odd points of the sample cloud form.
WIDTH = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, patch, x, y, z, red, green, blue."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    colour = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint((e(i) + 1) * 127.5)))
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("pid"), F.col("label").alias("patch"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), colour(3).alias("red"), colour(4).alias("green"), colour(5).alias("blue"))


def original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).where("pid % 2 = 0")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd points, which double as a lattice: node, gi, gj."""
    node = F.expr("pid div 2")
    rows = cloud(spark, sf_dir).where("pid % 2 = 1")
    return rows.withColumns({"node": node, "gi": F.floor(node / WIDTH), "gj": node % WIDTH})


def voxel_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), F.col("l_extendedprice").alias("value"))


def rd_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cloud, method, qp, rate, metric: rates fall and metrics fall with qp for each of three methods."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 7")
    size = F.count("*") / 100.0
    grouped = rows.groupBy(F.col("l_linestatus").alias("cloud"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("qp")).agg(size.alias("size"), F.avg("l_discount").alias("shift"))
    rate = F.round((8 - F.col("qp")) * 0.25 + F.col("size") / 1000000.0 + F.col("shift") / 10, 6)
    metric = F.round(50 - 2.5 * F.col("qp") - 0.1 * F.col("qp") * F.col("qp") + F.col("shift"), 6)
    return grouped.select("cloud", "method", "qp", rate.alias("rate"), metric.alias("metric"))


def squared(a: str, b: str) -> Column:
    """Squared distance of columns a.x.. and b.x.."""
    d = [F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y"), F.col(f"{a}z") - F.col(f"{b}z")]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
