"""Logs of a point-cloud codec and of its metric tool: texts of five and ten values.

`from_folders` reads trees with one file of each kind in a cloud's folder; `to_files` and `from_files` keep many logs in
few files, one on a line.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.sources.scratch import folder

#: The lines that hold a value, and the order of the metrics.
SIZE_LINE = r"{0}s bitstream size (\d+) B \(([-+.0-9Ee]+) bpp\)"
SOURCE_LINE = r'uncompressedDataPath\s*:\s*"([^"]*)"'
METRICS = {
    "d1_mse": "mseF      (p2point)", "d1_psnr": "mseF,PSNR (p2point)", "d2_mse": "mseF      (p2plane)", "d2_psnr": "mseF,PSNR (p2plane)",
    "y_mse": "c[0],    F         ", "u_mse": "c[1],    F         ", "v_mse": "c[2],    F         ",
    "y_psnr": "c[0],PSNRF         ", "u_psnr": "c[1],PSNRF         ", "v_psnr": "c[2],PSNRF         ",
}


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match; a text without one is an error."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).otherwise(F.raise_error(F.lit(f"no match of {pattern}")))


def encoder_values(text: Column) -> list[Column]:
    size = lambda what, group: found(text, SIZE_LINE.format(what), group)
    parts = [(w, f"{w}_{n}", g, t) for w in ("position", "color") for n, g, t in (("bytes", 1, "long"), ("bpp", 2, "double"))]
    return [found(text, SOURCE_LINE).alias("source"), *(size(w, g).cast(t).alias(n) for w, n, g, t in parts)]


def metric_values(text: Column) -> list[Column]:
    literal = lambda s: r"\s*".join("".join("\\" + c if c in "()[]" else c for c in w) for w in s.split())
    return [found(text, literal(line) + r"\s*:\s*(\S+)").cast("double").alias(name) for name, line in METRICS.items()]


def encoder_text(source: Column, position: Column, position_bpp: Column, color: Column, color_bpp: Column) -> Column:
    line = lambda what, size, bpp: F.concat(F.lit(f"{what}s bitstream size "), size.cast("string"), F.lit(" B ("), bpp.cast("string"), F.lit(" bpp)"))
    return F.concat_ws("\n", F.concat(F.lit('uncompressedDataPath : "'), source, F.lit('"')), line("position", position, position_bpp), line("color", color, color_bpp))


def metric_text(values: dict[str, Column]) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"   {line}: "), values[name]) for name, line in METRICS.items()))


def to_files(spark: SparkSession, rows: DataFrame, key: str, kinds: list[str]) -> str:
    """Each log as one line behind its key, its line ends escaped, in a folder for each kind: sets of logs share files.
    Returns the folder."""
    path = folder(spark, "logs")
    one = lambda kind: rows.select(F.col(key).cast("string").alias("key"), F.lit(kind).alias("kind"), escaped(F.col(kind)).alias("log")).where("log is not null")
    lines = one(kinds[0])
    for kind in kinds[1:]:
        lines = lines.unionByName(one(kind))
    lines.select("kind", F.concat_ws("\t", "key", "log").alias("value")).write.partitionBy("kind").text(path)
    return path


def escaped(text: Column, back: bool = False) -> Column:
    """A text without line ends, and back. The backslash is the first to be escaped and the last to come back."""
    pairs = [("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r")]
    for plain, code in reversed(pairs) if back else pairs:
        text = F.replace(text, F.lit(code if back else plain), F.lit(plain if back else code))
    return text


def of_kind(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """key and the whole text of one kind, a log a row: nothing is grouped."""
    part = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.col("kind") == kind).select(part[0].cast("long").alias(key), escaped(part[1], back=True).alias(kind))


def from_files(spark: SparkSession, path: str, key: str, kinds: list[str]) -> DataFrame:
    """key and the whole text of each kind, null where there is none."""
    out = of_kind(spark, path, key, kinds[0])
    for kind in kinds[1:]:
        out = out.join(of_kind(spark, path, key, kind), key, "full")
    return out


#: The option by which tasks move their files themselves, and how many tasks list a tree's folders at most.
COMMITTER, LISTING = "mapreduce.fileoutputcommitter.algorithm.version", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Schemes of paths that all machines mount.
MOUNTED = ("", "file")
#: A cloud's folder, and the names of its logs.
FOLDER, KINDS = r"^(.*)/[^/]+$", {"encoder": r"\.bin\.log$", "metric": r"\.pc_error$"}


def tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def below(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files of a tree. Its folders are listed by a few tasks for each core: by default there is one
    for each of up to 10,000 folders, which takes longer to start than to run."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(tasks(spark)))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    finally:
        spark.conf.set(LISTING, before)
    return files.select(F.col("_metadata.file_path").alias("path"), "content")


def from_folders(spark: SparkSession, root: str, folder: str = FOLDER, kinds: dict[str, str] = KINDS) -> DataFrame:
    """folder and the whole text of each kind, from all folders of a tree that hold a log of any kind; `folder` is a
    pattern whose group is the folder's name, `kinds` has one for the paths of each kind. Another number of logs of a kind
    than one in a folder is an error, and so is a tree without logs. A log is one row, and has a few lines."""
    path = F.col("path")
    kind = F.coalesce(*(F.when(path.rlike(p), F.lit(k)) for k, p in kinds.items()))
    logs = below(spark, root).select(F.regexp_extract(path, folder, 1).alias("folder"), kind.alias("kind"), F.col("content").cast("string").alias("value"))
    logs = logs.where("kind is not null")
    if not logs.select("kind").take(1):
        raise ValueError(f"no logs below {root}")
    of = lambda k: F.col("kind") == k
    counted = logs.groupBy("folder").agg(*(F.count_if(of(k)).alias(f"n_{k}") for k in kinds), *(F.min(F.when(of(k), F.col("value"))).alias(k) for k in kinds))
    wrong = lambda k: F.raise_error(F.concat(F.lit(f"{k} logs in "), "folder", F.lit(": "), F.col(f"n_{k}").cast("string"))).cast("string")
    return counted.select("folder", *(F.when(F.col(f"n_{k}") == 1, F.col(k)).otherwise(wrong(k)).alias(k) for k in kinds))


def to_folders(spark: SparkSession, rows: DataFrame, key: str, kinds: list[str]) -> str:
    """A folder <key>=.. for each key, with a folder kind=.. and one file for each log that is not null. Returns the tree's
    folder. Keys are whole numbers. In a folder that all machines mount, tasks write the files themselves: each by another
    name first, so that none is ever seen in part, then by one that follows from its text, so that a task which is tried
    again, or a key's second row, adds no file unless its text differs. Elsewhere Spark writes them."""
    path = folder(spark, "logtree")
    where = urlsplit(path)
    rows = rows.select(F.col(key).cast("long").alias(key), *kinds)
    if where.scheme not in MOUNTED:
        one = lambda kind: rows.select(key, F.lit(kind).alias("kind"), F.col(kind).alias("value")).where("value is not null")
        logs = reduce(DataFrame.unionByName, map(one, kinds))
        logs.repartition(tasks(spark), key, "kind").write.partitionBy(key, "kind").option("lineSep", "\n").option(COMMITTER, "2").text(path)
        return path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(k).to_pylist() for k in kinds]
            for name, *logs in zip(batch.column(key).to_pylist(), *texts):
                for kind, log in zip(kinds, logs):
                    if log is not None:
                        put(os.path.join(where.path, f"{key}={name}", f"kind={kind}"), log.encode())
            yield batch.slice(0, 0)

    os.makedirs(where.path, exist_ok=True)
    # AQE leaves a given number of tasks alone: few rows are many files
    rows.repartition(tasks(spark), key).mapInArrow(run, rows.schema).write.format("noop").mode("overwrite").save()
    return path


def put(place: str, data: bytes) -> None:
    """One file in a folder."""
    os.makedirs(place, exist_ok=True)
    new = os.path.join(place, f".{uuid.uuid4().hex}")
    with open(new, "wb") as f:
        f.write(data)
    os.replace(new, os.path.join(place, f"{hashlib.md5(data).hexdigest()}.log"))
