"""Jobs that can be resumed: a manifest of items against the outputs that are there.

Each item's output is a folder item=<name> of JSON files below the job's folder. A run joins the manifest against a
listing of these files and makes only what is absent. Spark shows the files of a run when all of it is done, so an item
either has its whole output or none; a run that fails leaves nothing, and the next one makes the same items again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def named() -> Column:
    """A file's item; its folder's name is escaped, and as part of a path once more."""
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return plain(plain(F.regexp_extract(F.col("_metadata.file_path"), "/item=([^/]*)/", 1))).alias("item")


def there(spark: SparkSession, folder: str) -> DataFrame:
    """(item): the items that have an output; files are listed and not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    return files.select(named()).where("item <> ''").distinct()


def absent(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest's rows without an output. Items are texts, none of them null or empty."""
    return manifest.join(there(manifest.sparkSession, folder), "item", "left_anti")


def resumed(manifest: DataFrame, folder: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Make the outputs of absent items: `work` gets their rows and returns rows with `item`. Returns how many were made;
    items for which work returns no row are tried again by the next run."""
    todo = absent(manifest, folder)
    names = [r[0] for r in todo.limit(1).select("item").collect()]
    if not names:
        return 0
    before = there(manifest.sparkSession, folder).count()
    work(todo).write.mode("append").partitionBy("item").json(folder)
    return there(manifest.sparkSession, folder).count() - before


def outputs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All outputs with their items; `schema` names the other columns."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.select(named(), "*")
