"""Suffix-array dedup over bytes (operator 2).

Equal strings of LENGTH bytes hold equal winnowed anchors, which bring the strings that may repeat to one task; copies of
a whole block are collapsed beforehand. There a suffix array is built by two-stage sorting: only suffixes smaller than
their successors are sorted directly, the others are induced by one scan over the buckets of first bytes; neighbours with
a common prefix of LENGTH bytes or more are equal strings, of which all but the earliest are removed.

Anchors with more than HOT different blocks are split into single strings. Each task collapses its equal ones, of which
only the earliest goes on, and deals them by the whole string: a group has no more strings than there are tasks. Texts are UTF-8 bytes, null texts have none; matches never cross texts. See
common.identified for repeated rows and missing ids. Only doc_id and text are read; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import MIXED, REPEAT, anchored, blocks, covered, finished, met
from .common import U64, chunks, identified, key_filter, mix, prefix_hash, run_hash, stored, texts

LENGTH, GRAM = 100, 16
#: Blocks of one anchor that one task takes, and bytes that are sorted at a time.
HOT, SORTED = 2000, 1 << 20
#: Single strings of hot anchors that a task collapses at a time.
HELD = 200_000
ROW = ["anchor", "key", "at", "n", "bytes"]


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of `gram` bytes (a multiple of 8) from each place."""
    n = max(0, len(data) - gram + 1)
    if not n:
        return np.zeros(0, U64)
    padded = np.ascontiguousarray(data)
    out = np.zeros(n, U64)
    for i in range(0, gram, 8):
        out = out * U64(0xD6E8FEB86659FD93) + np.ndarray((n,), "<u8", padded, i, (1,))
    return mix(out)


def cutter(length: int, gram: int):
    def cut(data: np.ndarray, offsets: np.ndarray) -> tuple:
        text, start, n, anchor = blocks(byte_grams(data, gram), gram, length, offsets)
        return text, start - offsets[text], n, anchor, run_hash(prefix_hash(data), start, start + n + length - 1)

    return cut


def suffix_order(data: np.ndarray, ends: np.ndarray, first: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes first[i], .., first[i] + count[i] - 1 of each string i in the order of their next `depth` bytes.
    data has `depth` + 8 zeros behind each string, which ends at ends[i]."""
    size = len(data)
    # Types: a suffix is small if it is less than its successor. The last one of a string, before its end, is not.
    following = np.zeros(size, np.int16)
    following[:-1] = data[1:]
    following[ends - 1] = -1
    step = np.sign(following - data)
    places = np.arange(size)
    decided = np.minimum.accumulate(np.where(step != 0, places, size - 1)[::-1])[::-1]
    small = step[decided] > 0
    # Asked for: the given suffixes, and those up to the next small one, from which they are induced.
    next_small = np.minimum.accumulate(np.where(small, places, size)[::-1])[::-1]
    last = np.minimum(next_small[first + count - 1], ends - 1)
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    asked = np.cumsum(edge[:-1]) > 0
    # Stage one: sort the small suffixes directly, eight bytes at a time, while ties last.
    word = lambda at: np.ndarray((size - 7,), ">u8", data, 0, (1,))[at].astype(U64)
    order = np.flatnonzero(asked & small)
    order = order[np.argsort(word(order), kind="stable")]
    keys = word(order)
    group = np.cumsum(np.append(False, keys[1:] != keys[:-1])) if len(order) else np.zeros(0, int)
    for done in range(8, depth, 8):
        sizes = np.bincount(group) if len(group) else np.zeros(0, int)
        open_ = np.flatnonzero(sizes[group] > 1) if len(group) else group
        if not len(open_):
            break
        sub, g = order[open_], group[open_]
        k = word(sub + done)
        by = np.lexsort((k, g))
        sub, g, k = sub[by], g[by], k[by]
        order[open_] = sub
        new = np.zeros(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        inner = np.zeros(len(sub), bool)
        inner[1:] = (g[1:] == g[:-1]) & (k[1:] != k[:-1])
        new[open_] |= inner
        group = np.cumsum(new)
    # Stage two: scan the buckets of first bytes upwards; each suffix puts its predecessor, if that is not small, behind
    # those already in its bucket.
    heads = data[order] if len(order) else np.zeros(0, np.uint8)
    cuts = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    large = asked & ~small
    final = (ends - 1)[large[ends - 1]]  # induced by the end of the string, which is less than any byte
    spread(final, data[final], waiting)
    out = []
    for byte in range(256):
        if not waiting[byte] and cuts[byte] == cuts[byte + 1]:
            continue
        parts, i = waiting[byte], 0
        while i < len(parts):  # a run of one byte induces into its own bucket
            before = parts[i] - 1
            before = before[(before >= 0)]
            before = before[large[before]]
            spread(before, data[before], waiting)
            i += 1
        own = order[cuts[byte] : cuts[byte + 1]]
        out += [*parts, own]
        before = own - 1
        before = before[before >= 0]
        before = before[large[before]]
        spread(before, data[before], waiting)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def spread(items: np.ndarray, byte: np.ndarray, waiting: list[list[np.ndarray]]) -> None:
    if not len(items):
        return
    by = np.argsort(byte, kind="stable")
    items, byte = items[by], byte[by]
    at = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
    for a, b in zip(at, np.append(at[1:], len(items))):
        waiting[byte[a]].append(items[a:b])


def repeated_strings(strings: list[bytes], key: np.ndarray, at: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which of the count.sum() windows of the strings (in order) start earlier, by (key, place), in another one."""
    sizes = np.array([len(s) for s in strings])
    pad = bytes(length + 8)
    data = np.frombuffer(b"".join([x for s in strings for x in (s, pad)]) + b"\0" * 8, np.uint8)
    first = np.cumsum(sizes + len(pad)) - sizes - len(pad)
    order = suffix_order(data, first + sizes, first, count, length)
    owner = np.full(len(data), -1, np.int64)
    number = np.zeros(len(data), np.int64)
    flat = np.repeat(first, count) + within(count)
    owner[flat] = np.repeat(np.arange(len(strings)), count)
    number[flat] = np.arange(len(flat))
    order = order[owner[order] >= 0]
    # common prefixes of neighbours, as far as `length`
    same = np.arange(1, len(order))
    for done in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        same = same[word[order[same] + done] == word[order[same - 1] + done]]
    new = np.ones(len(order), bool)
    new[same] = False
    group = np.cumsum(new) - 1
    o = owner[order]
    place = at[o] + order - first[o]
    by = np.lexsort((place, key[o], group))
    later = np.zeros(len(order), bool)
    later[by[1:]] = group[by[1:]] == group[by[:-1]]
    out = np.zeros(len(flat), bool)
    out[number[order[later]]] = True
    return out


def collapsed(single: dict[tuple[int, bytes], tuple[int, int]], later: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The earliest of equal strings, dealt by anchor and string, and without bytes the runs of the others, dealt by key."""
    if later:
        key, at = np.array(sorted(later), np.int64).T
        new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(mix(key[first].astype(U64)).view(np.int64)), pa.array(key[first]), pa.array(at[first].astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(first), pa.binary())], ROW)
    if single:
        anchor = [a ^ int.from_bytes(sha256(s).digest()[:7], "big") for a, s in single]
        key, at = zip(*single.values())
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(np.ones(len(at), np.int32)), pa.array([s for _, s in single], pa.binary())], ROW)


def within(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, at, n): strings at, .., at + n - 1 of the text start earlier too."""
    rows = stored(met(anchored(docs, cutter(length, gram))))
    mixed = rows.where(F.col("kind") == MIXED).select("anchor", "key", "at", "n")
    hot = mixed.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    cuts = mixed.join(hot, "anchor", "left").groupBy("key").agg(F.collect_list(F.struct("anchor", "at", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("cuts"))
    some = key_filter(docs.select("key", "text"), "key", mixed.select("key")).join(cuts, "key")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single: dict[tuple[int, bytes], tuple[int, int]] = {}
        later: list[tuple[int, int]] = []
        for batch in chunks(batches):
            anchor, key, at, n, out = [], [], [], [], []
            for k, text, cuts in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                raw = text.encode()
                for c in cuts:
                    if not c["hot"]:
                        anchor.append(c["anchor"])
                        key.append(k)
                        at.append(c["at"])
                        n.append(c["n"])
                        out.append(raw[c["at"] : c["at"] + c["n"] + length - 1])
                        continue
                    for a in range(c["at"], c["at"] + c["n"]):
                        name, here = (c["anchor"], raw[a : a + length]), (k, a)
                        first = single.setdefault(name, here)
                        if first != here:
                            single[name] = min(first, here)
                            later.append(max(first, here))
                if len(single) + len(later) > HELD:
                    yield from collapsed(single, later)
                    single, later = {}, []
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(out, pa.binary())], ROW)
        yield from collapsed(single, later)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            known = pc.is_null(batch.column("bytes"))
            yield batch.filter(known).select(["key", "at", "n"])
            for part in chunks([batch.filter(pc.invert(known))], "bytes", SORTED // 4):
                held.append(part)
                size += part.column("bytes").nbytes
                if size > SORTED:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    anchor = whole["anchor"].to_numpy()
                    cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                    if cut:
                        yield from flagged(whole.slice(0, cut))
                        rest = whole.slice(cut)
                        held = rest.to_batches()
                        size = rest["bytes"].nbytes
        if held:
            yield from flagged(pa.Table.from_batches(held))

    def flagged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, at, n = (t[c].to_numpy() for c in ("key", "at", "n"))
        gone = repeated_strings(t["bytes"].to_pylist(), key, at, n, length)
        # runs of flagged windows inside a string
        string = np.repeat(np.arange(len(n)), n)
        new = gone.copy()
        new[1:] &= ~gone[:-1] | (string[1:] != string[:-1])
        first = np.flatnonzero(new)
        run = np.cumsum(new)[gone] - 1
        yield pa.RecordBatch.from_arrays([pa.array(key[string[first]]), pa.array((at[string] + within(n))[first].astype(np.int32)), pa.array(np.bincount(run, minlength=len(first)).astype(np.int32))], ["key", "at", "n"])

    dealt = some.mapInArrow(strings, "anchor long, key long, at int, n int, bytes binary").repartition("anchor").sortWithinPartitions("anchor")
    found = dealt.mapInArrow(sort, "key long, at int, n int")
    return stored(rows.where(F.col("kind") == REPEAT).select("key", "at", "n").unionByName(found))


def deduplicated(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked."""
    known = identified(docs)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                raw = (text or "").encode()
                if not cuts:
                    rows.append((len(raw), 0, 0, sha256(raw).hexdigest(), raw))
                    continue
                gone = covered(len(raw), cuts, length)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(raw), int(gone.sum()), spans, sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names) - 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return finished(known, repeats(known, length), run, schema)
