"""Text PLY files of coloured points as a source and a sink.

Files are read as lines, so a large one is split between tasks. Header lines start with a word and points with a number.
Each file's points are read by that file's header: properties are found by name, whatever their order, and one that a
file lacks is null. A property that files give different types is a double. Files hold points alone; `counts` tells
which hold other numbers of points than their header says. Binary files: see `ply_binary`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: PLY's scalar types, both spellings.
TYPES = {
    "char": "tinyint", "uchar": "smallint", "short": "smallint", "ushort": "int", "int": "int", "uint": "bigint", "float": "float", "double": "double",
    "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "float32": "float", "float64": "double",
}
CANONICAL = [("float", "x"), ("float", "y"), ("float", "z"), ("uchar", "red"), ("uchar", "green"), ("uchar", "blue")]
NUMBER = r"^\s*[-+.0-9]"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, types, names) of each file's vertex properties in order; a header has a few dozen lines."""
    # rows of one file are numbered in the order of its lines
    top = lines(spark, path).select("file", F.monotonically_increasing_id().alias("i"), F.split(F.trim("value"), r"\s+").alias("w")).where(F.get("w", F.lit(0)).isin("element", "property"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"])
    grouped = top.groupBy("file").agg(words.alias("top"))
    start = F.struct(F.lit(True).alias("on"), F.array().cast("array<struct<type:string,name:string>>").alias("p"))

    def step(acc: Column, w: Column) -> Column:
        """Properties behind another element than the vertices are not theirs."""
        more = F.array_append(acc["p"], F.struct(F.get(w, F.lit(1)).alias("type"), F.get(w, F.lit(2)).alias("name")))
        element = F.get(w, F.lit(0)) == "element"
        return F.struct(F.when(element, F.get(w, F.lit(1)) == "vertex").otherwise(acc["on"]).alias("on"), F.when(~element & acc["on"], more).otherwise(acc["p"]).alias("p"))

    p = F.aggregate("top", start, step)["p"]
    return grouped.select("file", p["type"].alias("types"), p["name"].alias("names"))


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file and the properties of each point; an unreadable number is null."""
    tops = headers(spark, path)
    layouts = [(r["types"], r["names"]) for r in tops.groupBy("types", "names").agg(F.min("file").alias("f")).orderBy("f").collect()]  # kinds of headers
    if not layouts:
        raise ValueError(f"no header below {path}")
    kinds: dict[str, str] = {}
    for types, names in layouts:
        for t, n in zip(types, names):
            if t not in TYPES:
                raise ValueError(f"property {n} of unknown type {t}")
            kinds[n] = TYPES[t] if kinds.get(n, TYPES[t]) == TYPES[t] else "double"
    rows = lines(spark, path).where(F.col("value").rlike(NUMBER)).select("file", F.split(F.trim("value"), r"\s+").alias("_cells"))
    if len(layouts) == 1:
        at = {n: F.lit(i) for i, n in enumerate(layouts[0][1])}
    else:
        rows = rows.join(tops.select("file", F.col("names").alias("_names")), "file")
        at = {n: F.when(F.array_contains("_names", n), F.array_position("_names", n).cast("int") - 1) for n in kinds}
    return rows.select("file", *(F.get("_cells", at[n]).try_cast(t).alias(n) for n, t in kinds.items()))


def counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, declared, n): the points that a file's header names and those it holds."""
    declared = F.max(F.regexp_extract("value", r"^element vertex (\d+)", 1).try_cast("long"))
    return lines(spark, path).groupBy("file").agg(declared.alias("declared"), F.count_if(F.col("value").rlike(NUMBER)).alias("n"))


def cell(kind: str, name: str) -> Column:
    return F.col(name).cast(TYPES[kind]).cast("string")


def write(points: DataFrame, path: str, patch: str = "patch", order: str = "pid", properties: list[tuple[str, str]] = CANONICAL) -> None:
    """One file for each patch, in folders patch=..., points by `order`. A patch is one task's, its size bounded by the
    patching; colours are cut to whole numbers."""
    rows = points.select(patch, F.lit(1).alias("_part"), F.col(order).alias("_order"), F.concat_ws(" ", *(cell(t, n) for t, n in properties)).alias("value"))
    top = ["ply", "format ascii 1.0"], [f"property {t} {n}" for t, n in properties] + ["end_header"]
    size = F.concat(F.lit("element vertex "), F.count("*").cast("string"))
    heads = points.groupBy(patch).agg(F.concat_ws("\n", F.lit("\n".join(top[0])), size, F.lit("\n".join(top[1]))).alias("value"))
    heads = heads.select(patch, F.lit(0).alias("_part"), F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"), "value")
    both = heads.unionByName(rows).repartition(patch).sortWithinPartitions(patch, "_part", "_order")
    both.select(patch, "value").write.partitionBy(patch).text(path)
