"""Repeats of a fixed length found from winnowed anchors: the part that substring dedup over words and over bytes share.

A window is `length` units of one text. Its anchor is the least hash of the grams in it, so equal windows have equal
anchors. Consecutive windows with the same anchor place make a block. Blocks meet by anchor: a later copy of a whole block
is a repeat throughout; the windows of an anchor's different blocks may still be equal in part and are `mixed`.
Each task first collapses the copies among its own rows, so a frequent block sends at most one row for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, key_filter, mix, texts

#: Rows that a task collapses at a time.
HELD = 600_000
SEEN, REPEAT, MIXED = 0, 1, 2
ROW = "kind byte, anchor long, block long, key long, at int, n int"
NAMES = ["kind", "anchor", "block", "key", "at", "n"]


def least_places(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams, the place of the least one (the first of equals)."""
    bits = U64(max(1, int(len(grams)).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & ((U64(1) << bits) - U64(1))).astype(np.int64)


def blocks(grams: np.ndarray, gram: int, length: int, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, start, number of windows, anchor) of all blocks; bounds has the first unit of each text and the end."""
    width = length - gram + 1
    if len(grams) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    place = least_places(grams, width)
    sizes = np.maximum(0, np.diff(bounds) - length + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[text]
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], start[first], np.diff(np.append(first, len(start))), grams[place[first]]


def collapsed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The earliest row of each (anchor, block) as SEEN; the others as REPEAT, spread by key."""
    anchor, block, key, at, n = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((at, key))
    anchor, block, key, at, n = (c[order] for c in (anchor, block, key, at, n))
    order = np.argsort(anchor ^ mix(block), kind="stable")
    anchor, block, key, at, n = (c[order] for c in (anchor, block, key, at, n))
    later = np.zeros(len(at), bool)
    later[1:] = (anchor[1:] == anchor[:-1]) & (block[1:] == block[:-1])
    # rows of one place are one row: those of a text that stands twice under one key cannot occur here
    anchor = np.where(later, mix(key.astype(U64)), anchor)
    block = np.where(later, U64(0), block)
    yield packed(np.where(later, REPEAT, SEEN), anchor, block, key, at, n)


def packed(kind, anchor, block, key, at, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), pa.array(key.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], NAMES)


def anchored(docs: DataFrame, cut: Callable) -> DataFrame:
    """ROW for each block of docs (key, text). cut(data, offsets) gives (text number, start in the text, windows, anchor, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chunks(batches):
            keys = batch.column("key").to_numpy()
            text, at, count, anchor, block = cut(*texts(batch.column("text")))
            held.append((anchor, block, keys[text], at, count))
            n += len(at)
            if n > HELD:
                yield from collapsed(held)
                held, n = [], 0
        if held:
            yield from collapsed(held)

    return docs.select("key", "text").mapInArrow(run, ROW)


def met(rows: DataFrame) -> DataFrame:
    """ROWs brought together by anchor: REPEAT for later copies of blocks and those known before, MIXED for the first
    block of each kind where an anchor has several. Rows of an anchor stream by in order; one row of it is held."""
    together = rows.repartition("anchor").sortWithinPartitions("anchor", "block", "key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the open anchor, if it may turn out mixed
        last_anchor = last_block = None
        for batch in batches:
            if not len(batch):
                continue
            kind, anchor, block, key, at, n = (batch.column(i).to_numpy() for i in range(6))
            new_anchor = np.ones(len(at), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_anchor[0] = anchor[0] != last_anchor
            new_block = new_anchor.copy()
            new_block[1:] |= block[1:] != block[:-1]
            new_block[0] |= block[0] != last_block
            repeat = (kind == REPEAT) | ~new_block
            # an anchor is mixed if a block after its first one begins
            group = np.cumsum(new_anchor)  # 0: the anchor that was open before this batch
            several = np.zeros(group[-1] + 1, bool)
            fresh = new_block & (kind == SEEN)
            several[group[fresh & ~new_anchor]] = True
            mixed = fresh & several[group]
            if held is not None:
                if several[0]:
                    yield held_row(held)
                    held = None if group[-1] else "out"
                elif group[-1]:
                    held = None
            if held == "out" and not group[-1]:
                mixed |= fresh & (group == 0)
            keep = repeat | mixed
            if keep.any():
                yield packed(np.where(repeat, REPEAT, MIXED)[keep], anchor[keep].view(U64), block[keep].view(U64), key[keep], at[keep], n[keep])
            if group[-1]:
                i = int(np.flatnonzero(new_anchor)[-1])
                if kind[i] == SEEN:
                    held = "out" if mixed[i] else (anchor[i], block[i], key[i], at[i], n[i])
                else:
                    held = None
            last_anchor, last_block = anchor[-1], block[-1]

    def held_row(held: tuple | str) -> pa.RecordBatch:
        if held == "out":
            return packed(*(np.zeros(0, d) for d in (np.int8, U64, U64, np.int64, np.int32, np.int32)))
        a, b, k, at, n = (np.array([x]) for x in held)
        return packed(np.array([MIXED]), a.view(U64), b.view(U64), k, at, n)

    return together.mapInArrow(run, ROW)


def by_text(rows: DataFrame) -> DataFrame:
    """(key, cuts): the (at, n) of each text together; a text's rows are no more than its length."""
    return rows.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("cuts"))


def finished(docs: DataFrame, repeats: DataFrame, run: Callable, schema) -> DataFrame:
    """run over docs (key, doc_id, text) with `cuts`; texts without any skip the shuffle."""
    cuts = by_text(repeats)
    touched = repeats.select("key")
    some = key_filter(docs, "key", touched).join(cuts, "key", "left")
    none = key_filter(docs, "key", touched, keep=False).withColumn("cuts", F.lit(None).cast("array<struct<at: int, n: int>>"))
    names = ["doc_id", "text", "cuts"]
    return some.select(names).mapInArrow(run, schema).unionByName(none.select(names).mapInArrow(run, schema))


def covered(size: int, cuts: list | None, length: int) -> np.ndarray:
    """Which of `size` units lie in a repeated window."""
    if not cuts:
        return np.zeros(size, bool)
    edge = np.zeros(size + 1, np.int64)
    at = np.array([c["at"] for c in cuts])
    n = np.array([c["n"] for c in cuts])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0
