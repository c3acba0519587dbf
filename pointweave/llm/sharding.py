"""Sharding by proportional stratified interleaving (operator 5), with DataFrame functions alone.

Within each source, rows are ranked in a seeded hash order; a row's fractional rank is (rank + 1/2) / rows of its source.
All rows are placed by fractional rank and cut into shards whose row counts differ by one at most (law `rows`), so every
shard has each source in its share. Ranks come from counts of hash ranges, added up over the small table of ranges, plus
a row number inside one range, so that neither a hot source nor the whole table is ever one task's work.

Null sources form a stratum of their own. Null texts have size 8 and the checksum of no bytes. Repeated rows are rows of
their own; rows equal in all of source, id and text may swap places without a visible difference. An empty table gives
no rows. Columns of the input other than doc_id, text and source are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges of each source and of the interleaved order: rows of a range are numbered by one task.
RANGES = 2048


def numbered(rows: DataFrame, group: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """rows with a gapless number from 0 in the order of bucket, then order, within each group; bucket rises with order."""
    rows = rows.withColumn("_b", bucket)
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1)
    on = [inside[g].eqNullSafe(starts[g]) for g in [*group, "_b"]]
    joined = inside.join(F.broadcast(starts) if not group else starts, on, "inner")
    return joined.select(*(inside[c] for c in rows.columns if c != "_b"), (F.col("_start") + F.col("_i")).cast("long").alias(name))


def sharded(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", size.alias("size"), crc.alias("text_crc32"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    # the top bits of the hash name its range, so ranges are in the order of the hash
    place = F.shiftright("_h", 64 - (RANGES.bit_length() - 1)).cast("int")
    ranked = numbered(rows, ["source"], place, ["_h", "doc_id", "text_crc32"], "_rank")
    totals = rows.groupBy("source").agg(F.count("*").alias("_of"))
    ranked = ranked.alias("r").join(totals.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "_of")
    fraction = (2 * F.col("_rank") + 1) / (2.0 * F.col("_of"))
    ranked = ranked.withColumn("_f", fraction)
    order = ["_f", F.col("source").asc_nulls_first(), "_h", "doc_id", "text_crc32"]
    placed = numbered(ranked, [], F.least(F.floor(F.col("_f") * RANGES), F.lit(RANGES - 1)).cast("int"), order, "_at")
    everything = rows.agg(F.count("*").alias("_all"))
    placed = placed.crossJoin(F.broadcast(everything))  # one row: the number of rows
    shard = F.expr(f"_at * {shards} div _all")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_at") - first).cast("long"))
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
