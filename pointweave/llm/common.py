"""Helpers shared by the text operators: tables, scratch storage, word tables of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes; Python's bytes.split() has the same rule.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64
BATCH = "4m"
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def by_bytes(docs: DataFrame) -> DataFrame:
    """docs. Texts are long, so the session hands rows to Python in Arrow batches of BATCH bytes, unless it has a limit of
    its own."""
    conf, name = session(docs).conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "64MB") in ("67108864b", "64MB"):
        conf.set(name, BATCH)
    return docs


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with numbers as names of all columns but those used, so that none clashes with an operator's own;
    toDF(*docs.columns) gives the names back."""
    return docs.toDF(*(c if c in used else f"_column{i}" for i, c in enumerate(docs.columns)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A session of one machine that names none gets one of its own, which lasts as
    long as the session's process; any other has to name it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once as a table in the shared folder and read them from there."""
    path = f"{shared_dir(session(df))}/pointweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session(df).read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a stored() table that no later plan reads."""
    spark = session(df)
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/pointweave-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, doc_id, text): key is doc_id where that is unique and never null. Otherwise rows are numbered in the
    order of doc_id (nulls first), then text, so that repeated rows count as later documents. Other columns go."""
    rows = by_bytes(docs).select("doc_id", F.col(text).alias("text"))
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text")
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return stored(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))


def key_filter(df: DataFrame, key: str, keys: DataFrame, bits: int = 18, keep: bool = True) -> DataFrame:
    """Rows whose key's bucket holds one of keys (or, without keep, none): a lossless pre-filter for a join. At most
    2**bits bucket numbers are broadcast, however many keys there are."""
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits)).cast("int")
    full = keys.select(bucket(keys.columns[0]).alias("_bucket")).distinct()
    return df.withColumn("_bucket", bucket(key)).join(F.broadcast(full), "_bucket", "left_semi" if keep else "left_anti").drop("_bucket")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(int(_RNG.integers(1 << 40, 1 << 60)) * 8 + 5)
_POWERS = np.ones(1, U64)
_INVERSE = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers modulo 2**64, and their inverses."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, _BASE, U64), dtype=U64)])
            _INVERSE = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, inverse, U64), dtype=U64)])
    return _POWERS[:n], _INVERSE[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers of the base: the hash of any run of bytes is a difference times an inverse."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings (null: none) end to end, and n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about `most` bytes; one longer text makes a slice of its own."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (n + 1 entries)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    last = solid.copy()
    last[:-1] &= space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def gram_hash(items: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours in a row, for each place that has n - 1 more behind it."""
    size = max(0, len(items) - n + 1)
    out = np.zeros(size, U64)
    for i in range(n):
        out = out * U64(0xD6E8FEB86659FD93) + items[i : i + size]
    return mix(out)
