"""Reports as JSON files in trees of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pointweave.operators import rd
from pointweave.sources.scratch import folder


def write(spark: SparkSession, rows: DataFrame, names: list[str]) -> str:
    """One folder for each value of the columns `names`, one below the other, keys in order. Returns the top folder."""
    path = folder(spark, "reports")
    rest = sorted(c for c in rows.columns if c not in names)
    rows.select(*names, *rest).write.partitionBy(*names).json(path)
    return path


def discovered(spark: SparkSession, path: str, schema: str, names: list[str], like: StructType) -> DataFrame:
    """All reports below the folder with `names` from their paths. An empty tree is an error."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).select("*", F.col("_metadata.file_path").alias("file"))
    if not rows.limit(1).count():
        raise ValueError(f"no reports below {path}")
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # escaped once as a folder's name and once as a part of a path
    part = lambda n: plain(plain(F.regexp_extract("file", f"/{n}=([^/]*)/", 1))).cast(like[n].dataType).alias(n)
    return rows.select(*(part(n) for n in names), *(c for c in rows.columns if c != "file"))


def compared(spark: SparkSession, tree: str, anchor: str, methods: list[str], measures: list[str], rate: str = "color_bits_per_input_point") -> DataFrame:
    """(cloud, measure, method, bd_rate, bd_snr) of reports in folders method=../cloud=.., against the anchor, by each
    measure. A method without a report is an error. Values that are not finite are left out of curves. The rows are also
    written as lines of an eval.log folder in the tree."""
    names = StructType([StructField(n, StringType()) for n in ("method", "cloud")])
    found = discovered(spark, tree, ", ".join(f"{c} double" for c in (rate, *measures)), ["method", "cloud"], names)
    there = {r[0] for r in found.select("method").distinct().collect()}  # one for each method
    if missing := {anchor, *methods} - there:
        raise ValueError(f"no reports of {sorted(missing)} below {tree}")
    rows = found.where(F.col("method").isin(anchor, *methods)).select("cloud", "method", F.col(rate).alias("rate"), F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("metric")) for m in measures))).alias("m"))
    out = rd.compared(rows.select("cloud", "method", "rate", "m.*"), anchor, ["cloud", "measure"])
    text = F.concat_ws(" ", "cloud", "method", F.lit("bdrate"), F.concat("measure", F.lit(":")), F.coalesce(F.col("bd_rate").cast("string"), F.lit("none")))
    out.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(f"{tree}/eval.log")  # a line for each curve
    return out.select("cloud", "measure", "method", "bd_rate", "bd_snr")

